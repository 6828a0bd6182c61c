"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cluster, decontaminate, fingerprints, langid, periodic, quality, search, shards, simhash, substring, toxicity, urls

URL_RULES = [("allow", "org", ""), ("block", "example.org", "es/"), ("block", "example.org", "en/1"), ("allow", "com", "fr/"), ("block", "com", "de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    cluster.small_batches(spark)
    return cluster.table(spark, sf_dir, name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.id_remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.id_remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    sample, prior = toxicity.sample_labels(docs, labels)
    return toxicity.score(docs, toxicity.fit(sample, prior=prior)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    coded = bpe.encode_and_decode(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"), tails=True)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_decontaminate, op2_spot_signatures, op3_substring_dedup, op4_simhash, op5_url_filter, op6_language_id, op7_bpe, op8_toxicity, op9_chat_format, op10_shards,
    op11_quality_rules, op12_periodic_runs, op13_ranked_search,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
s AS (SELECT doc_id, p, string_agg(word, ' ') OVER f AS body, count(*) OVER f AS n FROM e WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY body) AS c FROM s WHERE n = 35),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM h WHERE c > 1),
k AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN r ON e.doc_id = r.doc_id AND e.p = r.p GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
""",
    "op5_url_filter": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, h || f AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(f) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op11_quality_rules": r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p : p + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM t WHERE len(ws) >= 5)),
s AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM s) GROUP BY doc_id),
f AS (SELECT t.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
v AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words END AS wl, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS sy,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dl FROM f),
m AS (SELECT lang, source, 'wl' AS measure, wl AS x FROM v UNION ALL SELECT lang, source, 'sy', sy FROM v UNION ALL SELECT lang, source, 'dl', dl FROM v),
k AS (SELECT lang, source, measure, x - x % (1 << greatest(0, length(bin(x)) - 6)) AS bucket, count(*) AS held FROM m WHERE x IS NOT NULL GROUP BY ALL),
lv AS (SELECT 1 AS lv, lang, source, measure, bucket, held FROM k UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(held) FROM k GROUP BY lang, measure, bucket
  UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(held) FROM k GROUP BY measure, bucket),
c AS (SELECT *, sum(held) OVER (PARTITION BY lv, lang, source, measure ORDER BY bucket) AS upto, sum(held) OVER (PARTITION BY lv, lang, source, measure) AS al FROM lv),
q AS (SELECT lv, lang, source, measure, max(al) AS n, min(bucket) FILTER (4 * upto >= al) AS q1, min(bucket) FILTER (4 * upto >= 3 * al) AS q3 FROM c GROUP BY ALL),
b AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= 100 THEN o.q1 WHEN l.n >= 100 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.n >= 100 THEN o.q3 WHEN l.n >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM q o JOIN q l ON l.lv = 2 AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN q a ON a.lv = 3 AND o.measure = a.measure WHERE o.lv = 1),
r AS (SELECT *, 3 * greatest(q3 - q1, CASE measure WHEN 'wl' THEN 1500 WHEN 'sy' THEN 50 ELSE 120 END) AS reach FROM b),
w AS (SELECT lang, source, max(q1 - reach) FILTER (measure = 'wl') AS wl0, max(q3 + reach) FILTER (measure = 'wl') AS wl1, max(q1 - reach) FILTER (measure = 'sy') AS sy0, max(q3 + reach) FILTER (measure = 'sy') AS sy1,
  max(q1 - reach) FILTER (measure = 'dl') AS dl0, max(q3 + reach) FILTER (measure = 'dl') AS dl1 FROM r GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(wl BETWEEN wl0 AND wl1 AND sy BETWEEN sy0 AND sy1 AND dl BETWEEN dl0 AND dl1, false) AS kept
FROM v LEFT JOIN w ON v.lang IS NOT DISTINCT FROM w.lang AND v.source IS NOT DISTINCT FROM w.source
""",
    "op13_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""",
}
