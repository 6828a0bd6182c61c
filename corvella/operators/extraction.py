"""Numbers, citations, dates, pages and headings in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import dates
from corvella.functions import text as T

DATE = r"[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})"


def numbers(text: Column) -> Column:
    """Distinct runs of digits in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))))


def cited(text: Column, word: str = "clause") -> Column:
    """Distinct numbers cited after a word: single ones, both ends of ranges and comma lists; sorted."""
    stretches = F.regexp_extract_all(text, F.lit(rf"{word}s? ([0-9]+(?:(?:-|, ?)[0-9]+)*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(stretches, lambda s: F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))))))


def harvested_dates(docs: DataFrame, today: Column, pivot: int = 27) -> DataFrame:
    """doc_id, iso of each distinct dotted date in a text that is a real day from 1948 up to today."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(DATE), F.lit(0)))).alias("raw"))
    iso = F.try_to_timestamp(dates.dotted_date(F.col("raw"), pivot), F.lit("yyyy-MM-dd")).cast("date")
    return found.select("doc_id", iso.alias("date")).where((F.col("date") >= "1948-01-01") & (F.col("date") <= today)).distinct()


def latest_date(candidates: DataFrame) -> DataFrame:
    """doc_id, date, precision of the latest candidate (doc_id, date, day_known, garbage): day precision first at one date, garbage only if there is nothing else."""
    pool = F.struct((~F.col("garbage")).alias("clean"), "date", "day_known")
    return candidates.groupBy("doc_id").agg(F.max(pool).alias("m")).select("doc_id", F.col("m.date").alias("date"), F.when(F.col("m.day_known"), "day").otherwise("month").alias("precision"))


def pages_of_windows(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, pos, page: the last page (doc_id, page, n_words) that begins at or before a window (doc_id, pos, start)."""
    start = F.coalesce(F.sum("n_words").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = pages.where("n_words > 0").withColumn("start", start).select("doc_id", "start", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.col("page").cast("long").alias("page"))
    asked = windows.select("doc_id", F.col("start").cast("long").alias("start"), F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast("long").alias("page"))
    sweep = Window.partitionBy("doc_id").orderBy("start", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(sweep)).where("kind = 1").select("doc_id", "pos", "page")


def _sequence(rows: DataFrame, words: Column, start: Column) -> DataFrame:
    """doc_id, n, x, s: the number of words, and xor and sum of hashes of each word with its place. start: the place of a row's first word."""
    hashes = F.transform(words, lambda w, i: F.shiftrightunsigned(F.xxhash64(w, start + i), 16))
    told = rows.select("doc_id", F.size(words).cast("long").alias("n"), F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h)).alias("x"), F.aggregate(hashes, F.lit(0).cast("decimal(38,0)"), lambda a, h: (a + h).cast("decimal(38,0)")).alias("s"))
    return told.groupBy("doc_id").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


def matching_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id of the documents whose pages (doc_id, page, text) hold the words of the stored text (doc_id, text), all of them in order.

    Words are compared by hashes of word and place, so no document's text is
    gathered: a page is hashed where it lies. Two different texts pass for
    equal with a chance of about 2^-96.
    """
    words = T.words(F.col("text"))
    sized = pages.select("doc_id", "page", words.alias("words")).withColumn("n", F.size("words").cast("long"))
    # Places need the number of words before each page; only numbers are ordered, not texts.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sized.select("doc_id", "page", "n").withColumn("start", before).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "start")
    placed = sized.join(starts, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")))
    a = _sequence(placed, F.col("words"), F.col("start"))
    b = _sequence(docs.select("doc_id", "text"), words, F.lit(0).cast("long"))
    return a.join(b, ["doc_id", "n", "x", "s"], "left_semi").select("doc_id")


def guarded_pages(windows: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """pages_of_windows, with null pages for documents whose pages hold other words than the stored text. pages: doc_id, page, text."""
    sized = pages.select("doc_id", "page", F.size(T.words(F.col("text"))).alias("n_words"))
    fine = matching_pages(pages, docs).withColumn("_ok", F.lit(True))
    found = pages_of_windows(windows, sized).join(fine, "doc_id", "left")
    return found.select("doc_id", "pos", F.when(F.col("_ok"), F.col("page")).alias("page"))


def heading_pages(headings: DataFrame) -> DataFrame:
    """doc_id, clause, page: clauses in ascending order take their first candidate page not before the running floor.

    headings: doc_id, clause, candidates (array of pages). A clause without
    such a page gets none and leaves the floor. An ordered fold over one
    document's clauses.
    """
    zero = F.struct(F.lit(0).alias("floor"), F.array().cast("array<struct<clause:int,page:int>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        fits = F.array_min(F.filter(row["candidates"], lambda p: p >= state["floor"]))
        taken = F.struct(row["clause"].alias("clause"), fits.alias("page"))
        return F.struct(F.coalesce(fits, state["floor"]).alias("floor"), F.concat(state["out"], F.array(taken)).alias("out"))

    typed = headings.select("doc_id", F.struct(F.col("clause").cast("int").alias("clause"), F.col("candidates").cast("array<int>").alias("candidates")).alias("r"))
    rows = typed.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select("doc_id", F.explode(F.aggregate("rows", zero, step)["out"]).alias("o")).select("doc_id", "o.clause", "o.page")


def accepted_anchors(proposed: DataFrame, existing: DataFrame, least: int = 12, close: float = 0.8, most: int = 14) -> DataFrame:
    """doc_id, pos, question: proposals kept one after another, unless short or as close as `close` in words to an existing or an already kept one; at most `most` a document."""
    none = F.array().cast("array<array<string>>")
    have = existing.groupBy("doc_id").agg(F.collect_list(_stems("question")).alias("have"))
    rows = proposed.where(F.length("question") >= least).select("doc_id", F.struct("pos", "question", _stems("question").alias("stems")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()
    start = F.struct(F.coalesce("have", none).alias("seen"), F.array().cast(kind).alias("kept"))

    def step(state: Column, row: Column) -> Column:
        alike = F.exists(state["seen"], lambda s: F.size(F.array_intersect(s, row["stems"])) >= close * F.size(F.array_union(s, row["stems"])))
        skip = alike | (F.size(state["kept"]) >= most)
        return F.struct(F.when(skip, state["seen"]).otherwise(F.concat(state["seen"], F.array(row["stems"]))).alias("seen"), F.when(skip, state["kept"]).otherwise(F.concat(state["kept"], F.array(row))).alias("kept"))

    folded = rows.join(have, "doc_id", "left").select("doc_id", F.explode(F.aggregate("rows", start, step)["kept"]).alias("k"))
    return folded.select("doc_id", "k.pos", "k.question")


def _stems(column: str) -> Column:
    return F.array_distinct(F.filter(F.transform(T.words(F.col(column)), lambda w: F.lower(T.bare(w))), lambda w: F.length(w) >= 3))


def list_from_text(text: Column) -> Column:
    """Items of a list kept as text: JSON, or else quoted items between commas."""
    loose = F.filter(F.transform(F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), r"['\"]\s*,\s*['\"]"), lambda s: F.trim(F.regexp_replace(s, r"^\s*['\"]|['\"]\s*$", ""))), lambda s: s != "")
    return F.coalesce(F.from_json(text, "array<string>"), loose)


def settled_part(stream: Column) -> Column:
    """The part of a streamed text up to its last line end; it won't change any more."""
    at = F.length(stream) - F.coalesce(F.nullif(F.instr(F.reverse(stream), "\n"), F.lit(0)), F.length(stream) + 1) + 1
    return F.left(stream, at)
