"""Queries of versions, memo keys, files of orders and guarded pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.operators import chunking, extraction, intake, versions

from .inputs import WINDOWS_SQL, table


def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of pages: all but every ninth; then pages that answer, with their addresses' digests; then the rest again. All pairs compared."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    first = p.where(k % 9 > 0).select("page_id", F.sha1("html").alias("digest"), F.lit(1).cast("long").alias("version"))
    second = first.unionByName(versions.accepted(first, p.select("page_id", F.sha1("url").alias("digest"), (k % 3).alias("status")), "status = 0"))
    third = second.unionByName(versions.accepted(second, p.select("page_id", F.when(k % 2 == 0, F.sha1("html")).otherwise(F.sha1("url")).alias("digest"), (k % 5).alias("status")), "status < 2"))
    pairs = [versions.version_diff(third, "page_id", "digest", a, b).withColumns({"before": F.lit(a), "after": F.lit(b)}) for a, b in ((1, 2), (2, 3), (1, 3))]
    return reduce(DataFrame.unionByName, pairs)


def route_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items asked in every language. The cache was filled for two items of three, before one title of the German documents was changed."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat_ws(":", "source", F.left("text", F.lit(40))).alias("title"))
    older = docs.withColumn("title", F.when((F.col("lang") == "de") & (F.col("doc_id") % 50 == 0), F.concat("title", F.lit("?"))).otherwise(F.col("title")))
    langs = sorted(r.lang for r in docs.select("lang").distinct().where("lang IS NOT NULL").collect())  # few
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, langs))).alias("lang"))
    then, now = (versions.catalogue_digest(d, ["lang"], ["doc_id", "title"]) for d in (older, docs))
    cache = versions.memo_keys(asked.where("item_id % 3 > 0"), then, "lang", "text").select("memo_key", F.lit("x").alias("answer")).distinct()
    return versions.memo_misses(versions.memo_keys(asked, now, "lang", "text"), cache).select("lang", "memo_key")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of orders as the files of an order, some gone, new, changed or failed since."""
    # Dealt out by order once, as numbers: what follows stays in its partition.
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    k = F.col("l_partkey") * 7 + F.col("l_suppkey")
    rows = l.select(F.col("l_orderkey").alias("order_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("path"), k.alias("k")).distinct()
    base = rows.where("k % 11 > 0").select("order_id", "path", F.sha1("path").alias("digest"))
    now = rows.where("k % 13 > 0").select("order_id", "path", F.when(F.col("k") % 17 == 0, "other").otherwise(F.sha1("path")).alias("digest"), F.when(F.col("k") % 19 == 0, "timeout").alias("error"))
    found = intake.file_status(base, now, "order_id")
    return found.select("order_id", "status", *[F.array_join(c, ";").alias(c) for c in ("gone", "added", "failed", "changed")])


def guarded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages; every seventh document's pages have two words swapped, every eleventh's lack the last page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"), F.size(F.split("text", "\n")).alias("pages"))
    swapped = F.regexp_replace("line", r"^([^\s]+) ([^\s]+)", "$2 $1")
    line = F.when((F.col("doc_id") % 7 == 0) & (F.col("page") == 0), swapped).otherwise(F.col("line"))
    pages = lines.where("doc_id % 11 > 0 OR page < pages - 1").select("doc_id", "page", line.alias("text"))
    windows = chunking.chunk_windows(table(spark, sf_dir, "documents")).select("doc_id", F.col("chunk_ord").alias("pos"), (F.col("chunk_ord") * chunking.STEP).alias("start"))
    return extraction.guarded_pages(windows, pages, docs)


QUERIES = {f.__name__: f for f in (version_changes, route_misses, file_changes, guarded_pages)}

_HASH = "('0x' || left(md5({}), 13))::BIGINT"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x09-\x0D\x20]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "version_changes": """
WITH v1 AS (SELECT page_id, sha1(html) AS d FROM pages WHERE page_id % 9 > 0),
v2 AS (SELECT page_id, sha1(url) AS d FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT * FROM v1 WHERE page_id % 3 > 0),
v3 AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN sha1(html) ELSE sha1(url) END AS d FROM pages WHERE page_id % 5 < 2 UNION ALL SELECT * FROM v2 WHERE page_id % 5 >= 2),
p AS (SELECT 1 AS before, 2 AS after, coalesce(a.page_id, b.page_id) AS page_id, a.d AS old, b.d AS new FROM v1 a FULL JOIN v2 b ON a.page_id = b.page_id
  UNION ALL SELECT 2, 3, coalesce(a.page_id, b.page_id), a.d, b.d FROM v2 a FULL JOIN v3 b ON a.page_id = b.page_id UNION ALL SELECT 1, 3, coalesce(a.page_id, b.page_id), a.d, b.d FROM v1 a FULL JOIN v3 b ON a.page_id = b.page_id)
SELECT page_id, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'gone' WHEN old <> new THEN 'changed' ELSE 'ok' END AS status, before, after FROM p""",
    "route_misses": f"""
WITH d AS (SELECT lang, doc_id, source || ':' || left(text, 40) AS title FROM documents), o AS (SELECT lang, doc_id, CASE WHEN lang = 'de' AND doc_id % 50 = 0 THEN title || '?' ELSE title END AS title FROM d),
h AS (SELECT 1 AS v, lang, {_HASH.format("'=' || doc_id || '|=' || title")} AS h FROM d UNION ALL SELECT 0, lang, {_HASH.format("'=' || doc_id || '|=' || title")} FROM o),
g AS (SELECT v, lang, left(sha1(count(*) || '/' || sum(h) || '/' || bit_xor(h)), 12) AS digest FROM h GROUP BY 1, 2),
k AS (SELECT v, lang, item_id, lang || '|' || digest || '|' || left(sha1(text), 16) AS memo_key FROM g, benchmark)
SELECT DISTINCT lang, memo_key FROM k WHERE v = 1 AND memo_key NOT IN (SELECT memo_key FROM k WHERE v = 0 AND item_id % 3 > 0)""",
    "file_changes": """
WITH r AS (SELECT DISTINCT l_orderkey AS order_id, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path, l_partkey * 7 + l_suppkey AS k FROM lineitem), o AS (SELECT DISTINCT order_id FROM r WHERE k % 11 > 0),
s AS (SELECT order_id, path, CASE WHEN k % 11 > 0 AND k % 13 = 0 THEN 'gone' WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'added' WHEN k % 19 = 0 THEN 'failed' WHEN k % 17 = 0 THEN 'changed' END AS kind FROM r SEMI JOIN o USING (order_id)),
l AS (SELECT order_id, coalesce(string_agg(path, ';' ORDER BY path) FILTER (kind = 'gone'), '') AS gone, coalesce(string_agg(path, ';' ORDER BY path) FILTER (kind = 'added'), '') AS added,
  coalesce(string_agg(path, ';' ORDER BY path) FILTER (kind = 'failed'), '') AS failed, coalesce(string_agg(path, ';' ORDER BY path) FILTER (kind = 'changed'), '') AS changed FROM s GROUP BY 1)
SELECT order_id, CASE WHEN gone || added || changed <> '' THEN 'changed' WHEN failed <> '' THEN 'error' ELSE 'ok' END AS status, gone, added, failed, changed FROM l""",
    "guarded_pages": rf"""
WITH {WINDOWS_SQL}, l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page, len(string_split(text, chr(10))) AS pages FROM documents),
m AS (SELECT doc_id, page, CASE WHEN doc_id % 7 = 0 AND page = 0 THEN regexp_replace(line, '^(\S+) (\S+)', '\2 \1') ELSE line END AS line FROM l WHERE doc_id % 11 > 0 OR page < pages - 1),
j AS (SELECT doc_id, array_to_string({_WORDS.format("string_agg(line, chr(10) ORDER BY page)")}, ' ') AS joined FROM m GROUP BY 1),
ok AS (SELECT doc_id FROM documents JOIN j USING (doc_id) WHERE joined = array_to_string({_WORDS.format("text")}, ' ')),
p AS (SELECT doc_id, page, len({_WORDS.format("line")}) AS n FROM m),
s AS (SELECT doc_id, page, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p WHERE n > 0)
SELECT w.doc_id, chunk_ord AS pos, CASE WHEN w.doc_id IN (SELECT doc_id FROM ok) THEN s.page END AS page FROM windows w ASOF LEFT JOIN s ON w.doc_id = s.doc_id AND w.chunk_ord * 140 >= s.start""",
}
