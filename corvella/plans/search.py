"""The retrieval plan as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieve as plan
from .inputs import table

BUDGET = 1500


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks: eight rows a document, of which the last is an anchor and the two before it are curated; row k has document k's whole text. Queries: every hundredth vector, with a benchmark text. Boost: the query's own document."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    pos = F.col("row_id") % 8
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.concat("source", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    section = F.when(pos == 7, "sq").when(pos >= 5, "key-facts").otherwise(F.concat(F.lit("chunk"), pos))
    chunks = vectors.join(texts, "row_id").select("row_id", F.expr("row_id div 8").alias("doc_id"), section.alias("section"), pos.alias("pos"), "text", "embedding")
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 100).alias("row_id"), "text")
    queries = vectors.where("row_id % 100 = 0").join(items, "row_id", "left").select(F.col("row_id").alias("query_id"), "text", "embedding")
    return queries, chunks, queries.select("query_id", F.expr("query_id div 8 + 1").alias("doc_id"))


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks, boost = _inputs(spark, sf_dir)
    return plan.retrieve(queries, chunks, 8, boost=boost, budget=BUDGET)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks, boost = _inputs(spark, sf_dir)
    found, merged = plan.retrieve_and_merge(queries, chunks, 8, boost=boost, budget=BUDGET)
    return plan.passages(found, chunks, merged).select("query_id", "doc_id", "section", "first_pos", "last_pos", "score", F.sha1("text").alias("text_sha1"))


QUERIES = {f.__name__: f for f in (retrieve, passages)}

_FOUND = r"""texts AS (SELECT doc_id AS row_id, source || chr(10) || coalesce(text, '') AS text FROM documents),
chunks AS (SELECT vec_id AS row_id, vec_id // 8 AS doc_id, vec_id % 8 AS pos, CASE WHEN vec_id % 8 = 7 THEN 'sq' WHEN vec_id % 8 >= 5 THEN 'key-facts' ELSE 'chunk' || (vec_id % 8) END AS section, text, embedding::DOUBLE[] AS e
  FROM embeddings JOIN texts ON row_id = vec_id),
asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, b.text FROM embeddings LEFT JOIN benchmark b ON b.item_id * 100 = vec_id WHERE vec_id % 100 = 0),
q_words AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS word FROM asked),
terms AS (SELECT query_id, lower(trim(word, '?.,:;!"''()[]')) AS term FROM q_words WHERE length(lower(trim(word, '?.,:;!"''()[]'))) >= 3),
kinds AS (SELECT DISTINCT term FROM terms), low AS (SELECT row_id, lower(text) AS t FROM chunks), held AS (SELECT term, row_id FROM kinds, low WHERE contains(t, term)),
weights AS (SELECT term, round_even(least(ln(1 + (SELECT count(*) FROM chunks)::DOUBLE / (1 + count(*))) / ln(21.0::DOUBLE), 1.5::DOUBLE) / 0.25::DOUBLE, 0)::BIGINT AS quarters FROM held GROUP BY 1),
n AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
o AS (SELECT t.query_id, h.row_id, (125 * sum(quarters) + any_value(n.n)) // (2 * any_value(n.n)) AS bonus FROM terms t JOIN held h USING (term) JOIN weights USING (term) JOIN n ON n.query_id = t.query_id GROUP BY 1, 2),
hits AS (SELECT q.query_id, c.row_id, c.doc_id, c.section, c.pos, (round(list_inner_product(q.e, c.e) * 1000)::BIGINT + coalesce(bonus, 0)::BIGINT + CASE WHEN c.doc_id = q.query_id // 8 + 1 AND section <> 'sq' THEN 50 ELSE 0 END) / 1000 AS score
  FROM asked q CROSS JOIN chunks c LEFT JOIN o ON o.query_id = q.query_id AND o.row_id = c.row_id),
per AS (SELECT query_id, doc_id, max(score) FILTER (section = 'sq') AS anchor_score, max(score) FILTER (section <> 'sq') AS best_score,
  arg_max(row_id, (score, -row_id)) FILTER (section <> 'sq') AS best_id, arg_max(row_id, (score, -row_id)) FILTER (section = 'key-facts') AS facts_id FROM hits GROUP BY 1, 2),
targets AS (SELECT query_id, coalesce(facts_id, best_id) AS target_id, anchor_score FROM per WHERE anchor_score > best_score),
body AS (SELECT row_id, text, substr(text, strpos(text, chr(10)) + 1) AS b FROM chunks),
sized AS (SELECT row_id, len(list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS n_all, len(list_filter(regexp_split_to_array(b, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS n_body FROM body),
unmerged AS (SELECT h.query_id, h.row_id, h.doc_id, h.section, h.pos, coalesce(t.anchor_score, h.score) AS score, t.target_id IS NOT NULL AS lifted
  FROM hits h LEFT JOIN targets t ON t.query_id = h.query_id AND t.target_id = h.row_id WHERE h.section <> 'sq'),
winner AS (SELECT query_id, arg_max(doc_id, (score, -row_id)) AS doc_id FROM unmerged GROUP BY 1),
lead AS (SELECT u.query_id, u.doc_id, u.row_id AS lead_id, n_all FROM unmerged u JOIN winner USING (query_id, doc_id) JOIN sized USING (row_id) WHERE lifted),
run AS (SELECT u.query_id, lead_id, u.row_id, l.n_all + sum(n_body) OVER (PARTITION BY u.query_id ORDER BY score DESC, u.row_id ROWS UNBOUNDED PRECEDING) AS total
  FROM unmerged u JOIN lead l ON l.query_id = u.query_id AND l.doc_id = u.doc_id JOIN sized ON sized.row_id = u.row_id WHERE section = 'key-facts' AND NOT lifted),
merged AS (SELECT * FROM run WHERE total <= 1500),
folded AS (SELECT * FROM unmerged u WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.query_id = u.query_id AND m.row_id = u.row_id)),
{cap}, {depth},
sel AS (SELECT query_id, doc_id, row_id, section, pos, score, {top} AS rank FROM final),
want AS (SELECT query_id, doc_id, unnest([pos - 1, pos + 1]) AS pos, round(score - 0.001::DOUBLE, 3) AS score, rank FROM sel WHERE rank <= 2 AND section LIKE 'chunk%'),
beside AS (SELECT query_id, w.doc_id, c.row_id, c.section, w.pos, arg_min(score, rank) AS score FROM want w JOIN chunks c ON c.doc_id = w.doc_id AND c.pos = w.pos AND c.section LIKE 'chunk%'
  WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.query_id = w.query_id AND s.row_id = c.row_id) GROUP BY ALL),
found AS (SELECT query_id, doc_id, row_id, section, pos, score FROM sel UNION ALL SELECT * FROM beside)"""


def _found() -> str:
    from .retrieval import _CAP, _DEPTH, _TOP

    depth = _DEPTH.replace("kinds AS", "parts AS").replace("FROM kinds", "FROM parts").replace("kinds.", "parts.")
    return _FOUND.format(cap=_CAP.format(src="folded"), depth=depth, top=_TOP)


ORACLE_SQL = {
    "retrieve": f"WITH {_found()} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank, doc_id, row_id, section, pos, score FROM found",
    "passages": f"""
WITH {_found()},
raw AS (SELECT f.*, string_split(b, ' ') AS w, f.pos - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY f.pos) AS island FROM found f JOIN body USING (row_id) WHERE section LIKE 'chunk%'),
pieces AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, doc_id, island ORDER BY pos) = 1 THEN array_to_string(w, ' ') ELSE array_to_string(w[41:], ' ') END AS piece FROM raw),
more AS (SELECT query_id, lead_id AS row_id, string_agg(b, chr(10) ORDER BY total) AS added FROM merged JOIN body USING (row_id) GROUP BY 1, 2)
SELECT query_id, doc_id, 'chunk' AS section, min(pos) AS first_pos, max(pos) AS last_pos, max(score) AS score, sha1(string_agg(piece, ' ' ORDER BY pos) FILTER (piece <> '')) AS text_sha1 FROM pieces GROUP BY query_id, doc_id, island
UNION ALL SELECT f.query_id, doc_id, section, pos, pos, score, sha1(text || coalesce(chr(10) || added, '')) FROM found f JOIN body USING (row_id) LEFT JOIN more m ON m.query_id = f.query_id AND m.row_id = f.row_id WHERE section NOT LIKE 'chunk%'""",
}
