"""Queries of extraction, sampling, rendering and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.functions import dates
from corvella.functions import text as T
from corvella.operators import chunking, extraction, gates, sampling
from corvella.operators.stored import quantiles

from .inputs import WINDOWS_SQL, table


def titles_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation lines of each region as one text."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_nationkey", F.concat(F.lit("- "), "n_name").alias("line"))
    parts = F.array_sort(F.collect_list(F.struct("n_nationkey", "line")))
    return lines.groupBy("r_name").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("block"))


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extraction.numbers(F.col("text"))).alias("number"))


def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("see clauses "), F.col("s_suppkey").cast("string"), F.lit(", "), F.col("s_nationkey").cast("string"), F.lit("-77 and clause 5."))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(extraction.cited(said)).alias("number"))


def dotted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.dotted_date(F.concat(F.lit("as of "), F.date_format("o_orderdate", "d.M.yy"), F.lit(" at least"))).alias("iso"))


def harvested_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("from "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(", once 31.02.1999.")).alias("text"))
    return extraction.harvested_dates(docs, F.lit("1998-01-01").cast("date")).select("doc_id", F.col("date").cast("string").alias("iso"))


def latest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 2 == 0).alias("day_known"), (F.col("o_orderstatus") == "P").alias("garbage"))
    return extraction.latest_date(rows).select("doc_id", F.col("date").cast("string").alias("iso"), "precision")


def window_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document stand for its pages."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line")).select("doc_id", "page", F.size(T.words(F.col("line"))).alias("n_words"))
    windows = chunking.chunk_windows(docs).select("doc_id", F.col("chunk_ord").alias("pos"), (F.col("chunk_ord") * chunking.STEP).alias("start"))
    return extraction.pages_of_windows(windows, pages)


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", 60)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", {"en": 40, "de": 20}).select("doc_id", "lang")


def changed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "pages").select("page_id", F.sha1("html").alias("h"))
    after = table(spark, sf_dir, "pages").select("page_id", F.when(F.contains("url", F.lit("?")), F.sha1("url")).otherwise(F.sha1("html")).alias("h"))
    return sampling.changed_with_controls(before, after, "page_id", "h")


def degraded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sampling.degraded(F.col("url")).alias("url"))


def order_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose folded name contains a folded search text."""
    folded = F.lower(F.translate("p_name", "\"'", ""))
    return table(spark, sf_dir, "part").where(F.contains(folded, F.lit("ring"))).select("p_partkey", "p_name")


def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps against holdings by the two-digit family of a number, largest ratio first."""
    family = F.regexp_extract(F.lpad(F.col("doc_id").cast("string"), 6, "0"), "([0-9]{2})$", 1)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = docs.groupBy(family.alias("family")).agg(F.countDistinct("doc_id").alias("holdings"))
    gaps = labels.where("quality = 0").groupBy(family.alias("family")).agg(F.countDistinct("doc_id").alias("gaps"))
    both = held.join(gaps, "family", "full_outer").na.fill(0, ["holdings", "gaps"])
    ratio = F.round(F.col("gaps") / F.when(F.col("holdings") > 0, F.col("holdings")), 6)
    return both.withColumn("ratio", ratio).orderBy(F.desc_nulls_last("ratio"), "family").limit(10)


def boilerplate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of license lines against all words, by language."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line")).select("lang", F.size(T.words(F.col("line"))).alias("n"), F.lower("line").rlike("license|copyright").alias("boiler"))
    return lines.groupBy("lang").agg(F.sum(F.when(F.col("boiler"), F.col("n")).otherwise(0)).alias("boiler_words"), F.sum("n").alias("words")).withColumn("share", F.round(F.col("boiler_words") / F.greatest(F.col("words"), F.lit(1)), 6))


def ocr_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(gates.ocr_rate(table(spark, sf_dir, "documents")), "per_thousand", [0.5]).select(F.round("value", 6).alias("median_rate"))


def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch-priced cost of line items with a price table by flag; unknown flags take the default price."""
    prices = spark.createDataFrame([("A", 3.0), ("R", 1.0)], "flag string, price double")
    l = table(spark, sf_dir, "lineitem")
    joined = l.join(prices, l.l_returnflag == prices.flag, "left")
    return joined.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.coalesce("price", F.lit(5.0)) * 0.5, 4).alias("cost"))


def context_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "part")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "|").alias("fingerprint"))


def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order before, of the same customer."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", before.alias("previous"))


QUERIES = {f.__name__: f for f in (
    titles_block, text_numbers, cited_numbers, dotted_dates, harvested_dates, latest_date, window_pages, seeded_sample, stratified_sample, changed_controls, degraded_urls, order_search,
    family_rollup, boilerplate_share, ocr_median, model_cost, context_fingerprint, previous_version,
)}

_W = r"len(list_filter(regexp_split_to_array({}, '[\x09-\x0D\x20]+'), lambda x: x <> ''))"

ORACLE_SQL = {
    "titles_block": "SELECT r_name, string_agg('- ' || n_name, chr(10) ORDER BY n_nationkey) AS block FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "text_numbers": "SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS number FROM documents",
    "cited_numbers": "SELECT s_suppkey, unnest(list_distinct([s_suppkey::VARCHAR, s_nationkey::VARCHAR, '77', '5'])) AS number FROM supplier",
    "dotted_dates": "SELECT o_orderkey, CASE WHEN year(o_orderdate) % 100 <= 26 THEN '20' ELSE '19' END || strftime(o_orderdate, '%y-%m-%d') AS iso FROM orders",
    "harvested_dates": "SELECT DISTINCT o_custkey AS doc_id, o_orderdate::DATE::VARCHAR AS iso FROM orders WHERE o_orderdate::DATE <= DATE '1998-01-01'",
    "latest_date": """
WITH r AS (SELECT o_custkey AS doc_id, o_orderdate::DATE AS d, o_orderkey % 2 = 0 AS k, o_orderstatus = 'P' AS g FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, d DESC, k DESC) AS n FROM r)
SELECT doc_id, d::VARCHAR AS iso, CASE WHEN k THEN 'day' ELSE 'month' END AS precision FROM o WHERE n = 1""",
    "window_pages": f"""
WITH {WINDOWS_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page FROM documents),
p AS (SELECT doc_id, page, {_W.format("line")} AS n FROM l),
s AS (SELECT doc_id, page, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p WHERE n > 0)
SELECT w.doc_id, chunk_ord AS pos, s.page FROM windows w ASOF JOIN s ON w.doc_id = s.doc_id AND w.chunk_ord * 140 >= s.start""",
    "seeded_sample": "SELECT doc_id FROM labels WHERE quality = 0 ORDER BY md5(doc_id || '/7'), doc_id LIMIT 60",
    "stratified_sample": """
WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '/7'), doc_id) AS n FROM documents)
SELECT doc_id, lang FROM n WHERE lang = 'en' AND n <= 40 OR lang = 'de' AND n <= 20""",
    "changed_controls": """
WITH j AS (SELECT page_id, contains(url, '?') AND sha1(url) <> sha1(html) AS changed FROM pages)
SELECT page_id, 'changed' AS kind FROM j WHERE changed UNION ALL (SELECT page_id, 'control' FROM j WHERE NOT changed ORDER BY page_id LIMIT 12)""",
    "degraded_urls": "SELECT page_id, translate(url, '710938', '170693') AS url FROM pages",
    "order_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(translate(p_name, '\"''', '')), 'ring')",
    "family_rollup": """
WITH h AS (SELECT right(lpad(doc_id::VARCHAR, 6, '0'), 2) AS family, count(DISTINCT doc_id) AS holdings FROM documents GROUP BY 1),
g AS (SELECT right(lpad(doc_id::VARCHAR, 6, '0'), 2) AS family, count(DISTINCT doc_id) AS gaps FROM labels WHERE quality = 0 GROUP BY 1)
SELECT family, coalesce(holdings, 0) AS holdings, coalesce(gaps, 0) AS gaps, round(coalesce(gaps, 0)::DOUBLE / nullif(coalesce(holdings, 0), 0), 6) AS ratio FROM h FULL JOIN g USING (family) ORDER BY ratio DESC NULLS LAST, family LIMIT 10""",
    "boilerplate_share": f"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT lang, {_W.format("line")} AS n, regexp_matches(lower(line), 'license|copyright') AS b FROM l)
SELECT lang, coalesce(sum(n) FILTER (b), 0)::BIGINT AS boiler_words, sum(n)::BIGINT AS words, round(coalesce(sum(n) FILTER (b), 0)::DOUBLE / greatest(sum(n), 1), 6) AS share FROM n GROUP BY 1""",
    "ocr_median": f"""
WITH g AS (SELECT round(1000.0::DOUBLE * len(regexp_extract_all(text, '[A-Za-z][0-9]|[0-9][A-Za-z]')) / greatest({_W.format("text")}, 1), 6) AS r FROM documents) SELECT round(median(r), 6) AS median_rate FROM g""",
    "model_cost": "SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 3.0::DOUBLE WHEN 'R' THEN 1.0 ELSE 5.0 END * 0.5::DOUBLE, 4) AS cost FROM lineitem",
    "context_fingerprint": "SELECT conv_id, string_agg(turn || ':' || role, '|' ORDER BY turn) AS fingerprint FROM conversations GROUP BY 1",
    "previous_version": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders",
}
