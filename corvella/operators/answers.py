"""Parsing of model answers: typed blocks, sources, ruling clauses, chips, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T


@dataclass(frozen=True)
class Labels:
    """How an answer labels its lines, and the words that make it a source, a lead and so on."""

    source: tuple[str, ...]
    lead: tuple[str, ...]
    side: str
    note: str
    route_out: str
    route_miss: str
    clause: tuple[str, str]


# The labels of Hebrew answers, the words for a clause and for clauses, and how a sentence opens that says what the orders leave open.
HEBREW_LABELS = Labels(("מקור", "מקורות"), ("פסיקה", "תשובה"), "התנהלות", "הערה", 'לא נקבע בפקודות מטכ"ל', "טרם במאגר", ("סעיף", "סעיפים"))
OPEN_NOTE = r"הפקודות\s+(?:שסופקו\s+)?(?:אינן|לא)\s+(?:קובעות|נוקבות|מפרטות|מגדירות|מתייחסות|מסדירות)"
NOTE_WITHIN = 45
# Fixed value: a label in bold with its colon inside or after, of 28 characters at most.
LABEL = r"(?U)^\s*\*\*\s*([^*\n]{1,28}?)\s*(?::\s*\*\*|\*\*\s*:)\s*(.*)$"


def kind_of(label: Column, names: Labels) -> Column:
    """side, src, lead, route_out, route_miss, note or field."""
    return (
        F.when(F.startswith(label, F.lit(names.side)), "side").when(label.isin(*names.source), "src").when(label.isin(*names.lead), "lead")
        .when(label == names.route_out, "route_out").when(label == names.route_miss, "route_miss").when(F.startswith(label, F.lit(names.note)), "note").otherwise("field")
    )


def blocks(answers: DataFrame, names: Labels = HEBREW_LABELS, open_note: str = OPEN_NOTE) -> DataFrame:
    """id, pos, kind, label, value: the labelled lines, notes and runs of prose of each answer (id, body), in order.

    A labelled line is a block of its own, and so is a line that begins a
    paragraph and opens with what the orders leave open: a note, which has no
    label. A source line without a source is a field. What lies between is one
    block of kind md, blank lines inside kept, blank runs dropped.
    """
    lines = answers.select("id", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).withColumn("bare", T.stripped(F.col("line")))
    # A label begins with its stars and is never empty, so other lines need not be matched, nor any line twice for it.
    lines = lines.withColumn("label", F.when(F.startswith("bare", F.lit("**")), F.regexp_extract("line", LABEL, 1)).otherwise(""))
    labelled = F.col("label") != ""
    open_ = F.left("bare", F.lit(NOTE_WITHIN)).rlike("(?U)" + open_note)
    sort = F.when(F.col("bare") == "", "blank").when(labelled, "label").when(open_, "open").otherwise("prose")
    value = F.when(labelled, T.clean(F.regexp_extract("line", LABEL, 2))).otherwise("")
    lines = lines.withColumns({"sort": sort, "value": value, "label": F.when(labelled, T.clean(F.col("label"))).otherwise("")})
    order = Window.partitionBy("id").orderBy("line_no")
    # Such a line is a note unless prose stands right before it or before others like it.
    last = F.last(F.when(F.col("sort") != "open", F.col("sort")), ignorenulls=True).over(order)
    lines = lines.withColumn("sort", F.when(F.col("sort") == "open", F.when(last == "prose", "prose").otherwise("note")).otherwise(F.col("sort")))
    alone = F.col("sort").isin("label", "note")
    lines = lines.withColumn("run", F.sum((alone | F.coalesce(F.lag(alone).over(order), F.lit(False))).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.when(~F.col("sort").isin("label", "note"), F.struct("line_no", "line"))))
    runs = lines.groupBy("id", "run").agg(
        F.min("line_no").alias("first"), F.max("sort").alias("sort"), F.max("label").alias("label"), F.max("value").alias("value"), F.max("bare").alias("bare"),
        F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("prose"),
    )
    prose = F.regexp_replace("prose", r"^\n+|\n+$", "")
    runs = runs.withColumn("prose", prose).where(F.col("sort").isin("label", "note") | (T.stripped(F.col("prose")) != ""))
    named = kind_of(F.col("label"), names)
    named = F.when((named == "src") & (F.size(sources(F.col("value"), names)) == 0), "field").otherwise(named)
    kind = F.when(F.col("sort") == "label", named).when(F.col("sort") == "note", "note").otherwise("md")
    pos = F.row_number().over(Window.partitionBy("id").orderBy("first"))
    value = F.when(F.col("sort") == "label", F.col("value")).when(F.col("sort") == "note", F.col("bare")).otherwise(F.col("prose"))
    return runs.select("id", pos.alias("pos"), kind.alias("kind"), F.when((F.col("sort") == "label") & (kind != "note"), F.col("label")).alias("label"), value.alias("value"))


def sources(value: Column, names: Labels = HEBREW_LABELS) -> Column:
    """array of struct(title, clause) of a source line. Only ; parts sources, as titles hold commas; the first dash of a title becomes a middle dot."""
    one, many = names.clause
    pattern = rf"(?U)[\s,—–\-·]*(?<!\S)((?:{one}|{many})\s+\S.*)$"
    parts = F.filter(F.transform(F.split(value, ";"), T.clean), lambda p: p != "")

    # Each step is an array of its own, as what a lambda names twice is worked out twice. Patterns are tried only where their words stand.
    def cut(part: Column) -> Column:
        named = F.contains(part, F.lit(one)) | F.contains(part, F.lit(many))
        title, clause = F.when(named, F.regexp_replace(part, pattern, "")).otherwise(part), F.when(named, T.clean(F.regexp_extract(part, pattern, 1))).otherwise("")
        return F.struct(T.clean(title).alias("title"), clause.alias("clause"))

    def dotted(s: Column) -> Column:
        dashed = F.contains(s["title"], F.lit("—")) | F.contains(s["title"], F.lit("–")) | F.contains(s["title"], F.lit("-"))
        title = F.when(dashed, F.regexp_replace(s["title"], r"(?s)^(.*?)\s*[—–-]\s*", "$1 · ")).otherwise(s["title"])
        return F.struct(title.alias("title"), s["clause"].alias("clause"))

    return F.filter(F.transform(F.transform(parts, cut), dotted), lambda s: (s["title"] != "") | (s["clause"] != ""))


# Fixed value: the label of a ruling.
RULING = "פסיקה"


def ruling_line(answer: Column, label: str = RULING) -> Column:
    """What follows the label on an answer's first ruling line, without bold marks and without direction marks at its ends; null if there is none."""
    found = F.regexp_extract(answer, rf"(?mdU)^\s*[{T.INVISIBLE}]*(?:\*\*)?\s*{label}:\s*\*{{0,2}}\s*(.+?)[^\S\n]*$", 1)
    return F.when(found != "", F.btrim(F.replace(found, F.lit("**"), F.lit("")), F.lit("* " + T.INVISIBLE)))


def ruling_clauses(line: Column, v: T.Verdicts = T.HEBREW_VERDICTS) -> Column:
    """array of struct(text, cls): a ruling line (see ruling_line) split at ;, each clause with its class."""
    parts = F.filter(F.transform(F.split(line, ";"), T.stripped), lambda p: p != "")
    return F.coalesce(F.transform(parts, lambda p: F.struct(p.alias("text"), T.verdict_class(p, v).alias("cls"))), F.array().cast("array<struct<text:string,cls:string>>"))


@dataclass(frozen=True)
class Chips:
    """What keeps a clause from standing alone as a chip."""

    conflicts: str
    modal: tuple[str, ...]
    modal_start: str
    bare: tuple[str, ...]
    longest: int = 50
    longest_none: int = 60


# Words that make a qualifier a ruling of its own, verbs that need an object, terms that say nothing alone.
HEBREW_CHIPS = Chips(r"מותר|אסור|אוסר|מתיר|מוסמך|רשאי|זכאי|פטור|חייב|ניתן|אפשר|מגיע|(?:^|\s)[ושכב]?(?:לא|אין)(?=\s|$)", ("ניתן", "אפשר"), "ל", ("מוסמך", "רשאי", "ניתן", "אפשר"))


def chip(clause: Column, v: T.Verdicts = T.HEBREW_VERDICTS, c: Chips = HEBREW_CHIPS) -> Column:
    """cls of a clause short and plain enough to be shown as a badge: yes, no, cond, none; else null."""
    s = F.btrim(clause, F.lit("* ." + T.INVISIBLE))
    pattern = rf"^((?:{v.negations})\s+)?({v.terms})(\s+[^;*]{{1,{c.longest}}})?$"
    negated, term, qualifier = F.regexp_extract(s, pattern, 1) != "", F.regexp_extract(s, pattern, 2), F.trim(F.regexp_extract(s, pattern, 3))
    partly = F.lit(False)
    for word in v.partial:
        partly = partly | F.startswith(qualifier, F.lit(word))
    unfit = (
        (term == "") | qualifier.rlike(c.conflicts) | (negated & (term == v.forbidding))
        | ((qualifier != "") & term.isin(*c.modal) & ~F.startswith(qualifier, F.lit(c.modal_start))) | ((qualifier == "") & term.isin(*c.bare))
    )
    none = F.startswith(s, F.lit(v.missing))
    return (
        F.when(none & (F.length(s) <= c.longest_none), "none").when(none | unfit, F.lit(None).cast("string")).when(partly, "cond")
        .when(negated | (term == v.forbidding), "no").when((qualifier != "") & qualifier.rlike(v.conditions), "cond").otherwise("yes")
    )


def out_of_scope_ok(answer: Column, mandated: str, markers: list[str], citation: str) -> Column:
    """Whether an answer to a question without scope holds: the mandated refusal, or a refusing word and no source."""
    soft = F.lit(False)
    for m in markers:
        soft = soft | F.contains(answer, F.lit(m))
    return F.contains(answer, F.lit(mandated)) | (soft & ~F.contains(answer, F.lit(citation)))


def facts_hold(answer: Column, top_docs: Column, expected: Column, groups: Column, refusal: str, k: int = 3, head: int = 160) -> Column:
    """Whether an answer doesn't open with the refusal, has an expected document among its first k sources and names a fact of each group."""
    bare = F.contains(F.left(T.normal_space(answer), F.lit(head)), F.lit(refusal))
    return ~bare & F.arrays_overlap(F.slice(top_docs, 1, k), expected) & T.all_groups(answer, groups)


def user_turn(question: Column, context: Column, profile: Column, header: str, opening: str, closing: str) -> Column:
    """The text of a user's turn; a non-empty profile (array) adds one line in brackets between question and context."""
    plain = F.concat(question, F.lit("\n\n"))
    about = F.concat(F.lit(f"({opening}"), F.array_join(profile, ", "), F.lit(f"{closing})\n\n"))
    return F.concat(plain, F.when(F.coalesce(F.size(profile), F.lit(0)) > 0, about).otherwise(""), F.lit(f"{header}\n"), context)


def context_of(chunks: DataFrame, empty: str) -> DataFrame:
    """query_id, context of ranked chunks (query_id, rank, doc_id, title, clause, text; null doc_id: none found)."""
    part = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" | "), "title", F.lit(" | "), "clause", F.lit("]\n"), "text"))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("rank", part.alias("part")))))
    joined = F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n---\n\n")
    return chunks.groupBy("query_id").agg(F.when(F.size(parts) > 0, joined).otherwise(empty).alias("context"))


def preview(text: Column, most: int, more: str = "…") -> Column:
    """The first characters of a text, with a mark where something is cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(more))).otherwise(text)


def letter_query(base: Column, fields: list[Column], most: int = 120) -> Column:
    """The search text of a letter: its base and its filled content fields, cut at `most` characters."""
    return F.left(F.concat_ws(" ", base, *[F.nullif(F.trim(f), F.lit("")) for f in fields]), F.lit(most))


def suggestion_ok(question: Column, deixis: str, longest: int = 95, least: int = 12) -> Column:
    """Whether a question can stand alone as a suggestion: neither pointing at something unseen nor too long or short."""
    return ~question.rlike(deixis) & F.length(question).between(least, longest)


def escalates(topic: Column, question: Column, always: list[str], triggers: str) -> Column:
    """Whether the escalation strip is shown: topics that always have it, or a trigger in the question."""
    return F.coalesce(topic.isin(*always), F.lit(False)) | F.coalesce(question, F.lit("")).rlike(triggers)


def picked(answer: Column, existing: Column) -> Column:
    """The ids that a router named and that exist, in its order, once each."""
    return F.array_intersect(answer, existing)


def clamped(value: Column, least: float, most: float, default: float) -> Column:
    """An untrusted value as a number within bounds; the default where it is none."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(least)), F.lit(most))).otherwise(F.lit(default))
