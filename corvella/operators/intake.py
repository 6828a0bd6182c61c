"""Intake of documents: order numbers, suspicious ids, log schemas, carried fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_number(file_name: Column) -> Column:
    """The order number that a file name carries, as N.NNNN without leading zeros, or null.

    Of the runs of digits in the name (less .pdf) the first counts if it has
    five or six digits; or the first two together, if they have two at most and
    four.
    """
    runs = F.regexp_extract_all(F.regexp_replace(file_name, r"(?i)\.pdf$", ""), F.lit("[0-9]+"), F.lit(0))
    one, two = F.get(runs, F.lit(0)), F.get(runs, F.lit(1))
    digits = F.when(F.length(one).isin(5, 6), one).when((F.length(one) <= 2) & (F.length(two) == 4), F.concat(one, two))
    head = F.ltrim(F.left(digits, F.length(digits) - 4), F.lit("0"))
    return F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), F.right(digits, F.lit(4)))


def suspicious_id(document_id: Column, file_name: Column, prefix: str = "PM-") -> Column:
    """Whether a document's id is another number than its file's; files without a number can't tell."""
    own, want = F.ltrim(F.replace(document_id, F.lit(prefix), F.lit("")), F.lit("0")), file_number(file_name)
    return F.coalesce((own != want) & (own != F.replace(want, F.lit("."), F.lit(""))), F.lit(False))


def new_ids(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys that came with the last intake."""
    return after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti")


def previous_document(new: DataFrame, old: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """new with the fields that the first earlier version of the same key (by `order`) has already."""
    first = old.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(order).alias("_o"), *fields)).alias("_f"))
    joined = new.join(first, new[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col("_f")[c], F.col(c)).alias(c) if c in fields else new[c] for c in new.columns])


def numbered(docs: DataFrame, order: str = "file_name") -> DataFrame:
    """docs with doc_ord, 0 .. n-1 in the order of a column, from counts by range blocks: no task sees all rows."""
    from .stored import stored

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(docs.repartitionByRange(n, order).withColumn("_block", F.spark_partition_id()))
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("held"))  # a row a block
    before = sizes.select(F.col("_block").alias("_b"), (F.sum("held").over(Window.orderBy("_block")) - F.col("held")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return blocks.withColumn("_nth", nth).join(before, F.col("_block") == F.col("_b")).withColumn("doc_ord", (F.col("_nth") + F.col("_before")).cast("long")).drop("_block", "_nth", "_b", "_before")


def with_columns_of(rows: DataFrame, header: list[str]) -> tuple[DataFrame, list[str]]:
    """rows laid out under a log's header, and the header repaired: columns that it lacks are added at its right, those that rows lack are null."""
    full = header + [c for c in rows.columns if c not in header]
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in full]), full


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, line of page texts (doc_id, page, text), without blank lines; pos counts them all."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''")


def heading_numbers(lines: DataFrame) -> DataFrame:
    """doc_id, clause, page, pos: where a clause number heads a page's line; of one number the first on a page.

    lines: doc_id, page, pos, line. A heading is a line '.n' or 'n.', or a bare
    'n' before a line with a dot alone.
    """
    after = F.lead("line").over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    marked = F.regexp_extract("line", r"^(?:\.([0-9]{1,3})|([0-9]{1,3})\.)$", 0)
    bare = F.col("line").rlike(r"^[0-9]{1,3}$") & (F.col("after") == ".")
    found = lines.withColumn("after", after).where((marked != "") | bare)
    clause = F.regexp_extract("line", r"[0-9]+", 0).cast("int")
    return found.select("doc_id", "page", clause.alias("clause"), "pos").groupBy("doc_id", "page", "clause").agg(F.min("pos").alias("pos"))


def clause_reference(label: Column) -> Column:
    """struct(number, sub): '12', '12.3' or 'clause 12(b)' as its number and what follows it; null without a number."""
    number = F.regexp_extract(label, r"([0-9]{1,3})(?:\.([0-9]{1,3})|\(([^)]{1,3})\))?", 1)
    sub = F.coalesce(*[F.nullif(F.regexp_extract(label, r"([0-9]{1,3})(?:\.([0-9]{1,3})|\(([^)]{1,3})\))?", i), F.lit("")) for i in (2, 3)])
    return F.when(number != "", F.struct(number.cast("int").alias("number"), sub.alias("sub")))


def snapshot_status(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, status of each baseline page (digest), the first that holds in the current snapshot (digest, page_status, n_errors).

    error: it had errors. page-error: it isn't there or its status isn't 200.
    changed: another digest. ok: else.
    """
    b = baseline.select(F.col(key), F.col("digest").alias("_old"))
    c = current.select(F.col(key).alias("_c"), F.col("digest").alias("_new"), "page_status", "n_errors")
    status = F.when(F.col("n_errors") > 0, "error").when(~F.col("page_status").eqNullSafe(F.lit(200)), "page-error").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("ok")
    return b.join(c, F.col(key) == F.col("_c"), "left").select(key, status.alias("status"))


def file_status(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, status, gone, added, failed, changed of each baseline order: its files compared path by path.

    baseline: key, path, digest. current: key, path, digest, error. The four
    are sorted lists of paths. An order with a file that is gone, new or of
    another digest is changed; else one with a file that failed is an error;
    else it is ok. A failed file is not compared further.
    """
    # Both sides meet in one grouping, without joins: sides that are partitioned by the key already are not shuffled again.
    b = baseline.select(F.col(key), "path", F.lit(True).alias("_base"), F.col("digest").alias("_digest"), F.lit(None).cast("string").alias("_error"))
    c = current.where("path IS NOT NULL").select(F.col(key), "path", F.lit(False).alias("_base"), F.col("digest").alias("_digest"), F.col("error").cast("string").alias("_error"))
    held = {"_old": F.when(F.col("_base"), F.struct("_digest")), "_new": F.when(~F.col("_base"), F.struct("_digest", "_error"))}
    files = b.unionByName(c).groupBy(key, "path").agg(*[F.collect_list(v).alias(k) for k, v in held.items()])

    def compared(old: Column, new: Column) -> Column:
        return F.when(F.coalesce(new["_error"], F.lit("")) != "", "failed").when(~old["_digest"].eqNullSafe(new["_digest"]), "changed")

    pairs = F.flatten(F.transform("_old", lambda o: F.transform("_new", lambda n: compared(o, n))))
    kinds = F.when(F.size("_new") == 0, F.transform("_old", lambda o: F.lit("gone"))).when(F.size("_old") == 0, F.transform("_new", lambda n: F.lit("added"))).otherwise(pairs)
    told = files.select(key, "path", (F.size("_old") > 0).alias("_base"), F.explode_outer(F.when(F.col(key).isNotNull() & F.col("path").isNotNull(), kinds)).alias("_kind"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col("path")))).alias(k) for k in ("gone", "added", "failed", "changed")]
    per = told.groupBy(key).agg(F.bool_or("_base").alias("_base"), *lists).where("_base").drop("_base")
    other = F.size("gone") + F.size("added") + F.size("changed")
    return per.withColumn("status", F.when(other > 0, "changed").when(F.size("failed") > 0, "error").otherwise("ok"))


def owned(links: DataFrame, held: DataFrame, digits: str) -> DataFrame:
    """links with owned: whether their order digits are among the held ones."""
    mine = held.select(F.col(digits).alias("_d")).where("_d IS NOT NULL").distinct().withColumn("_m", F.lit(True))
    return links.join(mine, F.col(digits) == F.col("_d"), "left").withColumn("owned", F.coalesce("_m", F.lit(False))).drop("_d", "_m")


def storage_status(configured: Column, last: Column) -> Column:
    """not_configured, ok or error as the last write went, or configured where nothing was written yet."""
    return F.when(~configured, "not_configured").when(last.isin("ok", "error"), last).otherwise("configured")
