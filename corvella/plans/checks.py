"""Queries of snapshot comparison, text gates, dates, amounts and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.functions import amounts, dates
from corvella.functions import text as T
from corvella.operators import diff, dims, gates

from .inputs import documents, table


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pages as they are, and a later crawl: www hosts gone, pages with a query string changed, mail added."""
    before = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("digest"), F.length("html").alias("size"))
    after = before.where(~F.contains("url", F.lit("://www."))).withColumn("digest", F.when(F.contains("url", F.lit("?")), F.sha2("digest", 256)).otherwise(F.col("digest")))
    added = before.where(F.contains("url", F.lit("://m."))).withColumn("page_id", -F.col("page_id") - 1)
    return before, after.unionByName(added)


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, sf_dir), "page_id", "digest")


def mirror_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return diff.mirror_plan(after.withColumn("size", F.when(F.contains("url", F.lit("?")), F.col("size") + 1).otherwise(F.col("size"))), before, "page_id", "size")


def path_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return diff.path_sets(before.select(path.alias("path")), after.select(path.alias("path")), "path")


def order_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.order_digits(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/doc-"), (F.col("page_id") + 100).cast("string"), F.lit("0")).alias("u")).alias("digits"))


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.content_dedupe(table(spark, sf_dir, "documents"), "text", "doc_id")


def jaccard_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines that mirror a benchmark item."""
    lines = documents(spark, sf_dir, "text").select(F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.select(F.sha1("text").alias("id"), "text").repartition("id").distinct()  # the one shuffle of the lines
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    found = gates.mirrors(lines, items.select(F.sha1("text").alias("id"), "text"), 0.55)
    return found


def grounding_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(gates.stems(F.col("text"))).alias("word"))
    return gates.ungrounded_share(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), words)


def ocr_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.ocr_rate(table(spark, sf_dir, "documents"))


def private_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(T.private(F.col("text"))).alias("n_private"), F.count(F.lit(1)).alias("n"))


#: Words of the test texts in the roles of ruling words.
WORDING = T.Verdicts("The is", "The|Of|And", "the|is|in|on|a", "on", "is|the", ("for", "by"), "with|this")


def verdict_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.verdict_class(F.element_at(F.split("text", "[.\n]"), 1), WORDING).alias("verdict"))


def service_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = l.join(o, l.l_orderkey == o.o_orderkey)
    start, end = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    status = dates.service_status(start, end, F.to_date(F.lit("1998-06-15")))
    return joined.select("l_orderkey", "l_linenumber", status["months_served"].alias("months_served"), status["days_left"].alias("days_left"), F.add_months(start, 3).cast("string").alias("third_month"))


def clamp_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", amounts.daily_pay(F.col("c_acctbal"), 50.0, 250.0, digits=4).alias("pay"))


def money_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", amounts.estimate(F.col("p_retailprice"), F.col("p_size") - 25).alias("estimate"))


def tier_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(dims.tier_gaps(F.col("s_acctbal"), [0.0, 1000.0, 5000.0])).alias("g"))
    return rows.select("s_suppkey", F.col("g.threshold").alias("threshold"), F.col("g.passed").alias("passed"), F.round("g.gap", 2).alias("gap"))


def matrix_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", SEGMENTS).agg(F.count(F.lit(1)))
    long = dims.transposed(counts, "c_nationkey", SEGMENTS).select("column", F.explode("entries").alias("e"))
    return long.select(F.col("column").alias("segment"), F.col("e.c_nationkey").alias("nation"), F.col("e.value").alias("n"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def default_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("place"))
    return dims.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", dim, "n_nationkey", "place", "elsewhere")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension over the star schema: sums by return flag and status."""
    l = table(spark, sf_dir, "lineitem")
    price = (F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(price).cast("long").alias("price_cents"), F.count(F.lit(1)).alias("n"))


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension over the star schema: order value by region of the customer."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)")).cast("long").alias("cents"), F.count(F.lit(1)).alias("n_orders"))


QUERIES = {f.__name__: f for f in (
    snapshot_diff, mirror_plan, path_set_ops, order_digits, content_hash_dedupe, jaccard_mirror, grounding_share, ocr_rate, private_lines, verdict_class,
    service_months, clamp_estimate, money_estimate, tier_gaps, matrix_transpose, default_lookup, pricing_summary, region_revenue,
)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')"
_STEMS = f"""list_distinct(list_filter(list_transform({_WORDS}, lambda x: lower(trim(x, '?.,:;!"''()[]'))), lambda x: length(x) >= 3))"""
_SNAP = """b AS (SELECT page_id, url, sha256(html) AS digest, length(html) AS size FROM pages),
k AS (SELECT page_id, url, CASE WHEN contains(url, '?') THEN sha256(digest) ELSE digest END AS digest, size FROM b WHERE NOT contains(url, '://www.')),
a AS (SELECT * FROM k UNION ALL SELECT -page_id - 1, url, digest, size FROM b WHERE contains(url, '://m.'))"""

ORACLE_SQL = {
    "snapshot_diff": f"""
WITH {_SNAP} SELECT coalesce(b.page_id, a.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'new' WHEN a.page_id IS NULL THEN 'gone' WHEN a.digest <> b.digest THEN 'changed' ELSE 'ok' END AS status
FROM b FULL JOIN a ON a.page_id = b.page_id""",
    "mirror_plan": f"""
WITH {_SNAP}, s AS (SELECT page_id, size + CASE WHEN contains(url, '?') THEN 1 ELSE 0 END AS size FROM a),
p AS (SELECT coalesce(b.page_id, s.page_id) AS page_id, CASE WHEN s.page_id IS NULL THEN 'delete' WHEN b.page_id IS NULL OR s.size <> b.size THEN 'copy' END AS action FROM b FULL JOIN s ON s.page_id = b.page_id)
SELECT * FROM p WHERE action IS NOT NULL""",
    "path_set_ops": f"""
WITH {_SNAP}, x AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM b), y AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT path, 'kept' AS side FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT path, 'added' FROM (SELECT * FROM y EXCEPT SELECT * FROM x) UNION ALL SELECT path, 'dropped' FROM (SELECT * FROM x EXCEPT SELECT * FROM y)""",
    "order_digits": "SELECT page_id, nullif(regexp_extract('doc-' || (page_id + 100) || '0', '[0-9]{4,7}'), '') AS digits FROM pages",
    "content_hash_dedupe": "SELECT sha1(text) AS text_sha1, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "jaccard_mirror": f"""
WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM documents), i AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM benchmark),
ls AS (SELECT sha1(text) AS id, {_STEMS} AS s FROM l), si AS (SELECT sha1(text) AS other, {_STEMS} AS t FROM i),
lw AS (SELECT id, len(s) AS n, unnest(s) AS w FROM ls), iw AS (SELECT other, len(t) AS m, unnest(t) AS w FROM si),
p AS (SELECT id, other, count(*) AS shared, any_value(n) AS n, any_value(m) AS m FROM lw JOIN iw USING (w) GROUP BY 1, 2)
SELECT id, other, round(shared::DOUBLE / (n + m - shared), 6) AS jaccard FROM p WHERE shared::DOUBLE / (n + m - shared) >= 0.55""",
    "grounding_share": f"""
WITH v AS (SELECT DISTINCT unnest({_STEMS}) AS word FROM documents), b AS (SELECT item_id AS id, unnest({_STEMS}) AS word FROM benchmark),
c AS (SELECT id, count(*) AS n_words, count(*) FILTER (v.word IS NULL) AS n_ungrounded FROM b LEFT JOIN v ON v.word = b.word GROUP BY 1)
SELECT item_id AS id, coalesce(n_words, 0) AS n_words, coalesce(n_ungrounded, 0) AS n_ungrounded, round(coalesce(n_ungrounded, 0)::DOUBLE / greatest(coalesce(n_words, 0), 1), 6) AS share FROM benchmark LEFT JOIN c ON c.id = item_id""",
    "ocr_rate": f"""
WITH g AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][0-9]|[0-9][A-Za-z]')) AS glued, len({_WORDS}) AS n FROM documents)
SELECT doc_id, glued::INT AS glued, round(1000.0::DOUBLE * glued / greatest(n, 1), 6) AS per_thousand FROM g""",
    "private_lines": r"SELECT lang, count(*) FILTER (length(text) > 100 OR regexp_matches(regexp_replace(text, '[\s\-]+', '', 'g'), '[0-9]{5,}')) AS n_private, count(*) AS n FROM documents GROUP BY 1",
    "verdict_class": r"""
WITH f AS (SELECT doc_id, trim(regexp_split_to_array(text, '[.\n]')[1]) AS c FROM documents),
e AS (SELECT *, regexp_extract(c, '^((?:The|Of|And)\s+)?(the|is|in|on|a)(.*)$', 1) <> '' AS neg, regexp_extract(c, '^((?:The|Of|And)\s+)?(the|is|in|on|a)(.*)$', 2) AS term,
  trim(regexp_extract(c, '^((?:The|Of|And)\s+)?(the|is|in|on|a)(.*)$', 3)) AS tail FROM f)
SELECT doc_id, CASE WHEN starts_with(c, 'The is') THEN 'none' WHEN term = '' OR neg AND term = 'on' THEN 'accent'
  WHEN starts_with(tail, 'for') OR starts_with(tail, 'by') OR CASE WHEN neg OR term = 'on' THEN regexp_matches(tail, 'is|the') ELSE contains(tail, 'on') OR regexp_matches(tail, 'with|this') END THEN 'cond'
  WHEN neg OR term = 'on' THEN 'no' ELSE 'yes' END AS verdict FROM e
""",
    "service_months": """
WITH j AS (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS s, l_shipdate::DATE AS e, DATE '1998-06-15' AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT *, least(t, e) AS u, e >= s AS sane FROM j)
SELECT l_orderkey, l_linenumber, CASE WHEN sane AND u >= s THEN ((year(u) - year(s)) * 12 + month(u) - month(s) - CASE WHEN day(u) < day(s) THEN 1 ELSE 0 END)::INT END AS months_served,
  CASE WHEN sane THEN greatest(0, date_diff('day', t, e))::INT END AS days_left, (s + INTERVAL 3 MONTH)::DATE::VARCHAR AS third_month FROM u""",
    "clamp_estimate": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(least(greatest(c_acctbal * 3.0::DOUBLE / 90.0::DOUBLE, 50.0::DOUBLE), 250.0::DOUBLE), 4) END AS pay FROM customer",
    "money_estimate": "SELECT p_partkey, CASE WHEN p_size - 25 > 0 THEN round_even(p_retailprice * (p_size - 25), 0) END AS estimate FROM part",
    "tier_gaps": "SELECT s_suppkey, t AS threshold, s_acctbal >= t AS passed, round(greatest(t - s_acctbal, 0.0::DOUBLE), 2) AS gap FROM supplier, (VALUES (0.0::DOUBLE), (1000.0), (5000.0)) v(t)",
    "matrix_transpose": "SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1, 2",
    "default_lookup": "SELECT s_suppkey, s_nationkey, coalesce(n_name, 'elsewhere') AS place FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity, sum(round(l_extendedprice * 100))::BIGINT AS price_cents, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "region_revenue": """
SELECT r_name, sum(round(o_totalprice * 100))::BIGINT AS cents, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
}
