"""Queries of usage logs, quotas, conversations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.functions import amounts
from corvella.functions import text as T
from corvella.operators import conversations, dense, dims, evaluation, index, logs
from corvella.operators.stored import quantiles

from .inputs import HITS_SQL, hits, table, vectors


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a question log: user is device, a user's day a session, event type a role."""
    e = table(spark, sf_dir, "events")
    device = F.col("user_id").cast("string")
    return e.select(F.col("event_id").alias("seq"), "ts", device.alias("device"), F.col("user_id").alias("user"), F.concat_ws("/", device, F.to_date("ts").cast("string")).alias("session"), F.col("event_type").alias("role"), F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def device_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.device_rollup(_log(spark, sf_dir))


def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.population(logs.device_days(_log(spark, sf_dir)), 3)


def daily_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("device").alias("devices"), F.sum(F.round(F.col("cost") * 100).cast("decimal(18,0)")).cast("long").alias("cents"))


def popular_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("lang").alias("role"), F.posexplode(F.split("text", "\n")).alias("pos", "question"), (F.col("doc_id") * 100_000).alias("base"))
    log = lines.select("role", "question", (F.col("base") + F.col("pos")).alias("ts"))
    curated = table(spark, sf_dir, "benchmark").select(F.lit("en").alias("role"), F.col("text").alias("question"), F.col("item_id").alias("ord"))
    return logs.popular(log, curated)


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    cost = amounts.usage_cost(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber"), digits=8)
    return l.select("l_orderkey", "l_linenumber", cost.alias("cost_usd"))


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _log(spark, sf_dir).withColumn("id", F.col("seq") - F.col("seq") % 3)
    cents = F.round(F.col("cost") * 100).cast("long")
    return logs.ledger_totals(e.select("id", "ts", F.col("role").alias("label"), cents.alias("estimate"), F.when(F.col("k") % 2 == 0, cents).alias("actual")))


def quota_one_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.user_quota(_log(spark, sf_dir), 2).select("seq", "user", "verdict")


def quota_two_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.two_quotas(_log(spark, sf_dir), 2, 80).select("seq", "user", "verdict")


def ring_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.newest(_log(spark, sf_dir)).select("seq", "ts", "device")


def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where(F.lower("role").isin("error", "click")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def spend_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("cost") * 100).cast("long")
    e = _log(spark, sf_dir).select(F.to_date("ts").alias("day"), "ts", F.col("seq").alias("id"), cents.alias("estimate"))
    return logs.spend_ceiling(e, 50_000).select(F.col("day").cast("string").alias("day"), "id", "accepted")


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question: in which part its answer fails."""
    docs = table(spark, sf_dir, "documents")
    bare = F.array_distinct(F.filter(F.transform(T.words(F.col("text")), lambda w: F.lower(T.bare(w))), lambda w: F.length(w) >= 3))
    doc_words = docs.select("doc_id", F.explode(bare).alias("word"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(bare).alias("term"))
    # Only pairs of queries that are asked can count.
    rows, queries = vectors(spark, sf_dir)
    mine = queries.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).distinct(), "query_id", "left_semi")
    retrieved = dense.pair_scores(rows, mine).where("score >= 0.2").select("query_id", F.col("row_id").alias("doc_id"))
    first_line = docs.select("doc_id", F.split("text", "\n")[0].alias("text"))
    return logs.triage(asked, doc_words.select("word").distinct(), doc_words, docs.count(), retrieved, titles=first_line.select("doc_id", F.explode(bare).alias("word")))


def history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trimmed(table(spark, sf_dir, "conversations"), 4, 2).select("conv_id", "turn", "role")


def preceding_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.with_question(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.sha1("question").alias("question_sha1"))


def archive_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.archive(table(spark, sf_dir, "conversations"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.transcript(table(spark, sf_dir, "conversations")).select("conv_id", F.length("context").alias("n_chars"), F.sha1("context").alias("context_sha1"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "n_chars", "quality", "toxic")


def gate_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate_counts(_graded(spark, sf_dir).select("lang", (F.col("quality") == 1).alias("ok")), "lang")


def band_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graded(spark, sf_dir)
    band = evaluation.band(F.col("n_chars"), F.col("quality") == 1, 2000, 500)
    return evaluation.band_table(g.select(F.col("lang").alias("source"), band.alias("band")))


def stratified_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    sample = _graded(spark, sf_dir).select(F.col("lang").alias("stratum"), outcome.alias("outcome"))
    return evaluation.stratified_rate(sample, table(spark, sf_dir, "documents").select(F.col("lang").alias("stratum")))


def unmeasured_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which no document is labelled toxic, as strata without a sample."""
    sample = _graded(spark, sf_dir).where("toxic = 1").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.concat_ws("/", "lang", "source").alias("stratum"))
    return evaluation.unmeasured(sample, table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("stratum")))


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _graded(spark, sf_dir).groupBy("lang").agg(F.sum("quality").cast("long").alias("hits"), F.count(F.lit(1)).alias("n"))
    return evaluation.with_wilson(counts, "hits", "n")


def flip_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graded(spark, sf_dir)
    return evaluation.flips(g.select("doc_id", F.col("quality").alias("outcome")), g.select("doc_id", F.col("toxic").alias("outcome")), "doc_id")


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(hits(spark, sf_dir), "score", [0.1, 0.5, 0.9]).select("share", F.round("value", 6).alias("value"))


def positional_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.positional_quantile(table(spark, sf_dir, "documents"), "n_chars", 5)


def anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's closest other row of its own label, and whether it is far."""
    h = hits(spark, sf_dir)
    own = h.where("row_id = query_id").select("query_id", F.col("doc_id").alias("own"))
    pairs = h.where("row_id <> query_id").join(own, "query_id").where("doc_id = own")
    best = evaluation.best_in_group(pairs, ["query_id"], "row_id", "score")
    return best.withColumn("uncovered", F.col("score") < 0.35)


def tier_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = [(0.0, "base"), (2500.0, "silver"), (5000.0, "gold"), (7500.0, "platinum")]
    return table(spark, sf_dir, "customer").select("c_custkey", dims.tier_of(F.col("c_acctbal"), tiers).alias("tier"))


QUERIES = {f.__name__: f for f in (
    device_rollup, population_stats, daily_devices, popular_questions, usage_cost, ledger_totals, quota_one_cap, quota_two_cap, ring_latest, verdict_tally, spend_ceiling, triage,
    history_trim, preceding_question, archive_latest, transcripts, gate_by_set, band_pivot, stratified_rate, unmeasured_strata, wilson_ci, flip_matrix, score_quantiles, positional_quantile, anchor_coverage, tier_asof,
)}

_LOG = """log AS (SELECT event_id AS seq, ts, user_id::VARCHAR AS device, user_id AS user_no, event_type AS role, value AS cost, ts::DATE AS d, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
_GRADED = "graded AS (SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"
_STEMS = r"list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> ''), lambda x: lower(trim(x, '?.,:;!\"''()[]'))), lambda x: length(x) >= 3))".replace('\\"', '"')

ORACLE_SQL = {
    "device_rollup": f"""
WITH {_LOG}, r AS (SELECT device, role, count(*) AS n FROM log GROUP BY 1, 2), t AS (SELECT device, first(role ORDER BY n DESC, role) AS top_role FROM r GROUP BY 1)
SELECT device, count(*) AS n_questions, count(DISTINCT d) AS n_days, count(DISTINCT d) AS n_sessions, sum(cost::DECIMAL(18, 6))::DECIMAL(18, 2)::DOUBLE AS cost, any_value(top_role) AS top_role FROM log JOIN t USING (device) GROUP BY device""",
    "population_stats": f"""
WITH {_LOG}, days AS (SELECT device, d, count(*) AS n FROM log GROUP BY 1, 2), s AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS total FROM days)
SELECT (SELECT count(DISTINCT device) FROM days) AS n_devices, (SELECT count(*) FROM (SELECT device FROM days GROUP BY 1 HAVING count(*) > 1)) AS returning,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM days GROUP BY d)) AS peak_devices, (SELECT count(*) FROM days WHERE n >= 3) AS days_at_cap, (SELECT count(*) FROM days WHERE n > 3) AS days_over_cap,
  (SELECT n FROM s WHERE r = total // 2 + 1) AS upper_median""",
    "daily_devices": f"WITH {_LOG} SELECT d::VARCHAR AS day, count(DISTINCT device) AS devices, sum(round(cost * 100))::BIGINT AS cents FROM log GROUP BY 1",
    "popular_questions": r"""
WITH l AS (SELECT lang AS role, doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT role, unnest(lines) AS line, doc_id * 100000 + unnest(range(len(lines))) AS ts FROM l),
q AS (SELECT role, array_to_string(list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda w: w <> ''), ' ') AS question, ts FROM x),
c AS (SELECT role, question, count(*) AS n, max(ts) AS last FROM q WHERE question <> '' AND length(question) <= 100 AND NOT regexp_matches(regexp_replace(question, '[\s\-]+', '', 'g'), '[0-9]{5,}') GROUP BY 1, 2),
a AS (SELECT * FROM (SELECT role, question, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, last DESC, question) AS ord FROM c) WHERE ord <= 4),
b AS (SELECT * FROM a UNION ALL SELECT 'en', text, 0, 1000000 + item_id FROM benchmark WHERE ('en', text) NOT IN (SELECT (role, question) FROM a)),
p AS (SELECT role, question, n, row_number() OVER (PARTITION BY role ORDER BY ord) AS place FROM b) SELECT * FROM p WHERE place <= 4""",
    "usage_cost": "SELECT l_orderkey, l_linenumber, round((l_partkey * 5.0::DOUBLE + l_suppkey * 25.0::DOUBLE + l_orderkey * 0.5::DOUBLE + l_linenumber * 6.25::DOUBLE) / 1e6::DOUBLE, 8) AS cost_usd FROM lineitem",
    "ledger_totals": f"""
WITH {_LOG}, e AS (SELECT seq - seq % 3 AS id, ts, role AS label, round(cost * 100)::BIGINT AS estimate, CASE WHEN k % 2 = 0 THEN round(cost * 100)::BIGINT END AS actual FROM log),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY actual IS NULL, ts DESC) AS r FROM e)
SELECT label, count(*) AS n, coalesce(sum(actual), 0)::BIGINT AS spent, coalesce(sum(estimate) FILTER (actual IS NULL), 0)::BIGINT AS reserved FROM o WHERE r = 1 GROUP BY 1""",
    "quota_one_cap": f"WITH {_LOG} SELECT seq, user_no AS user, CASE WHEN row_number() OVER (PARTITION BY user_no, d ORDER BY ts, seq) <= 2 THEN 'ok' ELSE 'user' END AS verdict FROM log",
    "quota_two_cap": f"""
WITH {_LOG}, u AS (SELECT *, row_number() OVER (PARTITION BY user_no, d ORDER BY ts, seq) <= 2 AS pass FROM log),
b AS (SELECT *, coalesce(sum(pass::INT) OVER (PARTITION BY d ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT seq, user_no AS user, CASE WHEN before >= 80 THEN 'global' WHEN pass THEN 'ok' ELSE 'user' END AS verdict FROM b""",
    "ring_latest": f"WITH {_LOG} SELECT seq, ts, device FROM log ORDER BY ts DESC, seq DESC LIMIT 200",
    "verdict_tally": f"WITH {_LOG} SELECT role, count(*) AS n FROM log WHERE lower(role) IN ('error', 'click') GROUP BY 1",
    "triage": f"""
WITH {HITS_SQL}, w AS (SELECT doc_id, unnest({_STEMS}) AS word FROM documents), t AS (SELECT item_id AS query_id, unnest({_STEMS}) AS term FROM benchmark),
v AS (SELECT DISTINCT word FROM w), un AS (SELECT DISTINCT query_id FROM t WHERE term NOT IN (SELECT word FROM v)),
topic AS (SELECT word FROM w GROUP BY 1 HAVING count(*) <= 0.1 * (SELECT count(*) FROM documents)),
ti AS (SELECT doc_id, unnest({_STEMS}) AS word FROM (SELECT doc_id, split_part(text, chr(10), 1) AS text FROM documents)),
c AS (SELECT query_id, w.doc_id, count(*) + count(ti.word) AS n FROM t JOIN w ON term = w.word LEFT JOIN ti ON ti.doc_id = w.doc_id AND ti.word = w.word WHERE term IN (SELECT word FROM topic) GROUP BY 1, 2),
b AS (SELECT query_id, doc_id FROM c QUALIFY n = max(n) OVER (PARTITION BY query_id)),
g AS (SELECT DISTINCT query_id, row_id AS doc_id FROM hits WHERE score >= 0.2),
f AS (SELECT b.query_id, bool_or(g.doc_id IS NOT NULL) AS got FROM b LEFT JOIN g ON g.query_id = b.query_id AND g.doc_id = b.doc_id GROUP BY 1)
SELECT q.query_id, CASE WHEN un.query_id IS NOT NULL THEN 'corpus' WHEN coalesce(got, true) THEN 'answer' ELSE 'retrieval' END AS cause
FROM (SELECT DISTINCT query_id FROM t) q LEFT JOIN un USING (query_id) LEFT JOIN f USING (query_id)""",
    "history_trim": """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT * FROM n WHERE r > 2 * ceil(greatest(n - 4, 0) / 2.0)), f AS (SELECT conv_id, min(r) FILTER (role = 'user') AS u FROM k GROUP BY 1)
SELECT conv_id, turn, role FROM k JOIN f USING (conv_id) WHERE r >= u""",
    "preceding_question": """
SELECT conv_id, turn, sha1(q) AS question_sha1 FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) WHERE role = 'assistant'""",
    "archive_latest": "SELECT conv_id, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 40) AS title, count(*) AS n_turns FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "transcripts": "WITH c AS (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1) SELECT conv_id, length(x)::INT AS n_chars, sha1(x) AS context_sha1 FROM c",
    "gate_by_set": f"WITH {_GRADED} SELECT lang, count(*) FILTER (quality = 1) AS passed, count(*) AS total FROM graded GROUP BY ROLLUP (lang)",
    "band_pivot": f"""
WITH {_GRADED}, b AS (SELECT lang, CASE WHEN n_chars >= 2000 AND quality = 1 THEN 'green' WHEN n_chars < 500 THEN 'red' ELSE 'yellow' END AS band FROM graded)
SELECT lang AS source, count(*) FILTER (band = 'green') AS green, count(*) FILTER (band = 'yellow') AS yellow, count(*) FILTER (band = 'red') AS red FROM b GROUP BY 1""",
    "stratified_rate": f"""
WITH {_GRADED}, s AS (SELECT lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS outcome FROM graded),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY 1), p AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1)
SELECT outcome, round(sum(k / n * size / (SELECT count(*) FROM documents)), 6) AS rate FROM (SELECT lang, outcome, count(*)::DOUBLE AS k FROM s GROUP BY 1, 2) JOIN n USING (lang) JOIN p USING (lang) GROUP BY 1""",
    "unmeasured_strata": """
WITH p AS (SELECT lang || '/' || source AS stratum, count(*) AS size FROM documents GROUP BY 1), s AS (SELECT DISTINCT lang || '/' || source AS stratum FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT stratum, size, round(size / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share FROM p ANTI JOIN s USING (stratum)""",
    "wilson_ci": f"""
WITH {_GRADED}, c AS (SELECT lang, sum(quality)::BIGINT AS hits, count(*) AS n FROM graded GROUP BY 1),
m AS (SELECT *, hits::DOUBLE / n AS p, 1.96::DOUBLE AS z FROM c), h AS (SELECT *, p + z * z / 2 / n AS mid, z * sqrt(p * (1 - p) / n + z * z / 4 / (n::DOUBLE * n)) AS half, 1 + z * z / n AS scale FROM m)
SELECT lang, hits, n, round(greatest(0.0::DOUBLE, (mid - half) / scale), 6) AS low, round(least(1.0::DOUBLE, (mid + half) / scale), 6) AS high FROM h""",
    "flip_matrix": f"WITH {_GRADED} SELECT quality AS before, toxic AS after, count(*) AS n FROM graded GROUP BY 1, 2",
    "score_quantiles": f"WITH {HITS_SQL} SELECT share, round(v, 6) AS value FROM (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS share, unnest(quantile_cont(score, [0.1, 0.5, 0.9])) AS v FROM hits)",
    "spend_ceiling": f"""
WITH RECURSIVE {_LOG}, e AS MATERIALIZED (SELECT d, seq AS id, round(cost * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY d ORDER BY ts, seq) AS n FROM log),
f AS (SELECT d, id, n, cents <= 50000 AS accepted, CASE WHEN cents <= 50000 THEN cents ELSE 0 END AS spent FROM e WHERE n = 1
  UNION ALL SELECT e.d, e.id, e.n, f.spent + e.cents <= 50000, f.spent + CASE WHEN f.spent + e.cents <= 50000 THEN e.cents ELSE 0 END FROM f JOIN e ON e.d = f.d AND e.n = f.n + 1)
SELECT d::VARCHAR AS day, id, accepted FROM f""",
    "positional_quantile": "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT n_chars AS value FROM s WHERE i = n * 5 // 10",
    "anchor_coverage": f"""
WITH {HITS_SQL}, own AS (SELECT vec_id AS query_id, label FROM embeddings), p AS (SELECT h.* FROM hits h JOIN own ON own.query_id = h.query_id AND own.label = h.doc_id WHERE h.row_id <> h.query_id)
SELECT query_id, arg_max(row_id, (score, -row_id)) AS row_id, max(score) AS score, max(score) < 0.35 AS uncovered FROM p GROUP BY 1""",
    "tier_asof": """
WITH t(least_value, tier) AS (VALUES (0.0::DOUBLE, 'base'), (2500.0, 'silver'), (5000.0, 'gold'), (7500.0, 'platinum'))
SELECT c_custkey, tier FROM customer ASOF LEFT JOIN t ON c_acctbal >= least_value""",
}
