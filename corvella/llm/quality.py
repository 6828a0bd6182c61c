"""Quality rules: thresholds from mergeable quantile sketches per language and source.

A fixed base rule drops very short and very repetitive texts. All other cutoffs
come from the documents' own distribution: for each language and source, and
each measure, a sketch counts the documents by bucket of the measure's value.
A bucket keeps the BITS leading bits of the value, so that a quantile read off
a sketch is at most 1/32 below the true one. Sketches merge by adding counts,
in any order and with one result: partial sketches of tasks into those of a
source, sources into a language, languages into one of all. Groups of fewer
than LEAST documents are judged by the next wider sketch.

A measure is out of bounds beyond its quartiles by more than REACH times the
distance between them, or times LEAST_SPREAD where they lie closer together.

Only DataFrame functions run. Texts are read once and never shuffled: what is
shuffled are sketches, which tasks sum up first, and a row of numbers a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import shared

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
REPEAT = 5  # words of a window
LEAST_WORDS = 10
MOST_REPEATED = 20  # of 100 words
BITS = 6
LEAST = 100  # documents that a sketch must hold to set bounds
REACH = 3
#: Measures, all a thousandth: characters a word, symbols a word, repeated lines a line. The spread is the least that quartiles count as apart.
LEAST_SPREAD = {"word_length": 1500, "symbols": 50, "dup_lines": 120}


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], text.alias("_text"), F.array_remove(F.split(text, BLANK), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    last = F.size("_words") - REPEAT

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get("_words", i + k) for k in range(REPEAT)])

    none = F.array().cast("array<bigint>")
    rows = rows.select(*carry, "_text", "_words", lines.alias("_lines"), F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window_hash)).otherwise(none).alias("_hashes"))

    def same(rows: str, k: Column, field: str) -> Column:
        here = F.get(rows, k)[field]
        return F.coalesce(F.get(rows, k - 1)[field] == here, F.lit(False)) | F.coalesce(F.get(rows, k + 1)[field] == here, F.lit(False))

    # Windows whose hash occurs once are unlike all others. Those left, in few texts only, are compared word by word.
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(again, placed))
    alike = F.filter("_placed", lambda x, k: same("_placed", k, "h"))
    told = F.sort_array(F.transform(alike, lambda x: F.struct(F.array_join(F.slice("_words", x["i"] + 1, REPEAT), " ").alias("g"), x["i"].alias("i"))))
    rows = rows.withColumn("_told", told)
    starts = F.sort_array(F.transform(F.filter("_told", lambda x, k: same("_told", k, "g")), lambda x: x["i"]))
    rows = rows.withColumn("_starts", starts)
    covered = F.aggregate(F.transform("_starts", lambda p, k: F.least(F.lit(REPEAT), F.coalesce(F.get("_starts", k + 1) - p, F.lit(REPEAT)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        *carry,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def bucket(value: Column) -> Column:
    """The smallest value that shares the BITS leading bits."""
    return value - F.pmod(value, F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(value)) - BITS)))


def sketches(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """keys, measure, bucket, held: one sketch for each key and measure. Null values are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.cast("long").alias("value")) for n, v in measures.items()]))
    flat = rows.select(*keys, each.alias("m")).where("m.value IS NOT NULL")
    return flat.groupBy(*keys, "m.measure", bucket(F.col("m.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("held"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("held").alias("held"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, held, q1, q3. A sketch has a few hundred buckets at most, whatever it counts."""
    by = Window.partitionBy(*keys, "measure")
    upto = sketch.withColumns({"upto": F.sum("held").over(by.orderBy("bucket")), "all": F.sum("held").over(by)})
    at = {f"q{k}": F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket"))).alias(f"q{k}") for k in (1, 3)}
    return upto.groupBy(*keys, "measure").agg(F.max("all").alias("held"), at["q1"], at["q3"])


def bounds(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, and low and high of each measure as <measure>_low, <measure>_high. sketch: of (lang, source)."""
    own = quartiles(sketch, ["lang", "source"])
    langs = merged(sketch, ["lang"])
    wider = quartiles(langs, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("lm"), *[F.col(c).alias(f"l_{c}") for c in ("held", "q1", "q3")])
    whole = quartiles(merged(langs, []), []).select(F.col("measure").alias("am"), *[F.col(c).alias(f"a_{c}") for c in ("held", "q1", "q3")])
    rows = own.join(wider, own.lang.eqNullSafe(wider.l) & (own.measure == wider.lm)).join(whole, F.col("measure") == F.col("am"))

    def chosen(q: str) -> Column:
        return F.when(F.col("held") >= least, F.col(q)).when(F.col("l_held") >= least, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))

    spread = reduce(lambda c, m: c.when(F.col("measure") == m, LEAST_SPREAD[m]), LEAST_SPREAD, F).otherwise(0)
    rows = rows.select("lang", "source", "measure", chosen("q1").alias("q1"), chosen("q3").alias("q3")).withColumn("reach", REACH * F.greatest(F.col("q3") - F.col("q1"), spread))
    low_high = [f.alias(f"{m}_{n}") for m in LEAST_SPREAD for n, f in (("low", F.max(F.when(F.col("measure") == m, F.col("q1") - F.col("reach")))), ("high", F.max(F.when(F.col("measure") == m, F.col("q3") + F.col("reach")))))]
    return rows.groupBy("lang", "source").agg(*low_high)


def judge(docs: DataFrame, carry: list[str] = ["doc_id"], least: int = LEAST) -> DataFrame:  # noqa: B006
    """carry and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs.

    Null texts count as empty: no words, base_failed. Null languages and
    sources are groups like any other. Repeated rows are judged and counted
    each. Very long texts are taken whole, as one row's arrays of words and
    hashes, some 100 bytes a word. An empty table gives no rows. Columns of
    docs may have any names; only doc_id, text, lang, source and carry are read.
    """
    names = {c: f"_c{i}" for i, c in enumerate(carry)}
    told = docs.select("text", "lang", "source", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = shared(measured(told, ["lang", "source", *names.values()]))
    thousandth = {"word_length": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines"}
    of = {"word_length": "n_words", "symbols": "n_words", "dup_lines": "n_lines"}
    measures = {m: F.expr(f"CASE WHEN {of[m]} > 0 THEN 1000 * {thousandth[m]} DIV {of[m]} END") for m in thousandth}
    limits = bounds(shared(sketches(rows, ["lang", "source"], measures)), least).withColumnsRenamed({"lang": "at_lang", "source": "at_source"})
    joined = rows.join(limits, rows.lang.eqNullSafe(limits.at_lang) & rows.source.eqNullSafe(limits.at_source), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = reduce(Column.__and__, [v.between(F.col(f"{m}_low"), F.col(f"{m}_high")) for m, v in measures.items()])
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], *counts, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs that judge keeps, all columns unchanged. Null and empty texts go; repeated rows stay or go together."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang", "source")
    return judge(whole, ["row"], least).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
