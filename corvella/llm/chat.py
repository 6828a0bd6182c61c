"""Chat formatting from an event log.

A log has conv_id, seq, kind, message, role, text. Kinds: `message` opens a
message (its text may be a first part), `delta` appends to it, `edit` replaces
its text, `regenerate` empties it and drops all that the conversation said
from it on. Logs are partitioned by conversation and folded in the order of
seq into final messages, which are rendered as turns:

    ### <role>:
    <text>
    </turn>

In roles and texts a backslash is doubled, # becomes \\# and </turn> becomes
<\\/turn>, so neither ### nor </turn> occurs inside; dropping each backslash
that stands before a character gives the text back. The loss mask covers the
escaped texts of one role.

What a regeneration drops is found from narrow rows, one a message, by a running
maximum over range blocks. Messages are folded one by one, so a conversation
that holds a third of a log is spread over all tasks, and memory is bounded by
the longest message. Only reading back, whose digest is one hash over all turns,
streams a whole conversation through one task, keeping running digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import partitions, shared

END = "\n</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*)\n</turn>\n", re.S)


OPENS = ("message", "edit", "regenerate")
PIECE = 64  # least characters of a streamed delta
MOST_PIECES = 16


def conversation_log(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as the log of a streamed session that ends with them.

    By a hash of its place, a turn is streamed in deltas; or drafted and then
    edited; or drafted, regenerated and streamed again; or followed by a message
    that the turn's regeneration drops. Turns of one number come in the order of
    (role, text). Null texts and roles are empty, null turns come first, null
    conv_ids are one conversation, repeated rows are turns of their own; a very
    long text is cut into MOST_PIECES deltas at most; an empty table gives no
    rows; other columns are ignored.
    """
    rows = conversations.select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "at").orderBy("role", "text")))
    n = F.least(F.lit(MOST_PIECES), F.floor(F.length("text") / PIECE) + 1)
    step = F.ceil(F.length("text") / n)
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.substring(F.col("text"), (k * step + 1).cast("int"), step.cast("int")))
    own, beyond = (F.struct("at.known", "at.turn", (F.col("nth") + k).alias("nth")) for k in (0, 1))
    draft = F.reverse("text")

    def event(kind: str, text: Column, message: Column = own, role: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    role, none = F.col("role"), F.lit(None).cast("string")
    streamed = F.transform(pieces, lambda p: event("delta", p))
    opened = F.concat(F.array(event("message", F.lit(""), role=role)), streamed)
    again = F.concat(F.array(event("regenerate", none, role=role)), streamed)
    events = (
        F.when(F.col("kind") == 0, opened)
        .when(F.col("kind") == 1, F.array(event("message", draft, role=role), event("delta", F.lit(" ...")), event("edit", F.col("text"))))
        .when(F.col("kind") == 2, F.concat(F.array(event("message", F.lit("draft: "), role=role), event("delta", draft)), again))
        .otherwise(F.concat(opened, F.array(event("message", draft, beyond, F.lit("user")), event("delta", F.lit("?"), beyond)), again))
    )
    log = rows.withColumn("kind", F.pmod(F.xxhash64("conv_id", "at", "nth"), F.lit(4))).select("conv_id", "at", "nth", F.posexplode(events).alias("i", "e"))
    return log.select("conv_id", F.struct("at.known", "at.turn", "nth", "i").alias("seq"), "e.kind", "e.message", "e.role", "e.text")


def _running_max(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with value replaced by its maximum over the rows of the key up to each one, by range blocks, so that no key is one task's."""
    blocks = shared(rows.repartitionByRange(partitions(rows.sparkSession), key, order).withColumn("block", F.spark_partition_id()))
    ends = blocks.groupBy(key, "block").agg(F.max(value).alias("end"))  # a row a key and block
    before = ends.select(F.col(key).alias("of"), F.col("block").alias("in"), F.max("end").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inner = F.max(value).over(Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = blocks.withColumn("inner", inner).join(before, (F.col(key) == F.col("of")) & (F.col("block") == F.col("in")))
    return joined.select(key, order, F.greatest("inner", "before").alias(value))


def reconstruct(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the messages that a log ends with.

    seq and message may be of any type with an order. Null texts are empty, a
    null conv_id is a conversation like any other. Deltas without an opening
    event still append. Events of equal seq count in the order of kind, then of
    text. The role is the first one given since the message was last opened
    anew; without any it is ''. Repeated events count each. An empty log gives
    no messages; other columns are ignored.
    """
    log = log.select(F.struct("conv_id").alias("conv"), F.struct("seq", "kind").alias("at"), "message", "role", F.coalesce("text", F.lit("")).alias("text"))
    redone = log.groupBy("conv", "message").agg(F.max(F.when(F.col("at.kind") == "regenerate", F.col("at"))).alias("redone"))
    redone = _running_max(redone, "conv", "message", "redone").withColumnsRenamed({"conv": "of", "message": "m"})
    kept = log.join(redone, (F.col("conv") == F.col("of")) & (F.col("message") == F.col("m"))).where("redone IS NULL OR at >= redone")
    events = F.array_sort(F.collect_list(F.struct("at", "text", "role")))
    folded = kept.groupBy("conv", "message").agg(events.alias("events"))
    last = F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e["at"]["kind"].isin(*OPENS), i + 1))), F.lit(1))
    live = F.slice("events", last, F.size("events"))
    role = F.element_at(F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull()), 1)
    return folded.select("conv.conv_id", "message", F.coalesce(F.when(F.size(F.filter("events", lambda e: e["role"].isNotNull())) > 0, role), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, message, turn_text, loss_from, loss_to.

    A conversation's output is its turn_texts in the order of message;
    loss_from : loss_to are the code points of a turn_text under the loss mask
    (null: none). A projection: any number of repeated messages, null conv_ids
    and empty tables are fine; role and text are not null.
    """
    role, text = F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), escaped(F.col("text"))
    head = F.concat(F.lit("### "), role, F.lit(":\n"))
    trained = F.col("role") == loss_role
    return messages.select("conv_id", "message", F.concat(head, text, F.lit(END)).alias("turn_text"), F.when(trained, F.length(head)).alias("loss_from"), F.when(trained, F.length(head) + F.length(text)).alias("loss_to"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the output and its mask.

    A conversation is read by one task in the order of its messages; a null
    conv_id is one conversation; an empty output gives no rows.
    """
    schema = rendered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, total = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch({k: pa.array([d[i] for d in done], pa.string() if "sha" in k else None if k == "conv_id" else pa.int64()) for i, k in enumerate(names)})

        for batch in batches:
            for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_text", "loss_from", "loss_to"))):
                if state is None or conv != state[0]:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = map(unescaped, _TURN.fullmatch(piece).groups())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    trained = unescaped(piece[start:end])
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                state[5] += len(piece)
            if len(done) > 5000:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    turns = rendered.repartition(partitions(rendered.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message")
    return turns.drop("message").mapInArrow(run, f"conv_id {schema}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The rendered turns of conversations (conv_id, turn, role, text), by way of their log.

    Null texts and roles are empty, null conv_ids are one conversation, null
    turns come first, repeated rows are turns of their own, an empty table
    gives no rows, other columns are ignored. Very long texts are rendered whole.
    """
    return render(reconstruct(conversation_log(conversations)))
