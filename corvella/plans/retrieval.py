"""Queries of chunking, indexing, scoring and rank reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvella.functions import amounts
from corvella.functions import text as T
from corvella.operators import chunking, dense, index, lexical, ranking
from corvella.operators.stored import stored

from .inputs import HITS_SQL, WINDOWS_SQL, best_hits, documents, section, table, vectors


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_windows(documents(spark, sf_dir, "source", "text"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all chunks: titles and texts of documents with words."""
    docs = documents(spark, sf_dir, "source", "text").where(F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    return docs.select(F.concat("source", F.lit("\n"), "text").alias("text"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_ord", "chunk_id", "text")


def anchor_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return chunking.anchor_rows(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), lines.alias("questions")))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.vocabulary(_texts(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    terms = stored(index.query_terms(_queries(spark, sf_dir)))
    return terms, lexical.build(_chunks(spark, sf_dir), terms)


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, built = _index(spark, sf_dir)
    return lexical.frequencies(built, terms)


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return term_df(spark, sf_dir).join(F.broadcast(n)).select("term", "df", amounts.term_weight(F.col("df"), F.col("n")).alias("weight"))  # n: one row


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.lexical_topk(_queries(spark, sf_dir), _chunks(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))
    return found.select("query_id", "rank", "doc_id", "chunk_id", "overlap")


def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.unknown_terms(_queries(spark, sf_dir), _texts(spark, sf_dir))


def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return docs.join(trusted, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def known_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = vectors(spark, sf_dir)
    best = dense.pair_scores(rows, queries, top=8, digits=6)
    return index.per_query_top(best, 8, "score", ["row_id"]).select("query_id", "rank", "row_id", "score")


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense score, plus a quarter of the lexical overlap with document row_id, plus 0.05 for boosted documents."""
    rows, queries = vectors(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(queries.select("query_id"), "query_id", "left_semi")
    overlap = stored(index.lexical_scores(asked, texts).select("query_id", F.col("chunk_id").cast("long").alias("row_id"), "overlap"))
    # A row without overlap is among its section's best by the dense score alone; rows with overlap are scored one by one.
    plain = best_hits(spark, sf_dir, 4, sections=True).join(overlap, ["query_id", "row_id"], "left_anti").withColumn("overlap", F.lit(None).cast("double"))
    met = dense.pair_scores(rows, queries.join(asked.select("query_id").distinct(), "query_id", "left_semi"), also=("doc_id",)).join(overlap, ["query_id", "row_id"])
    scored = plain.unionByName(met.withColumn("section", section()))
    one = F.round(F.col("score") + 0.25 * F.coalesce("overlap", F.lit(0.0)), 3)
    scored = scored.withColumn("score", F.when((F.col("doc_id") == 3) & (F.col("section") != "sq"), F.round(one + 0.05, 3)).otherwise(one))
    return index.per_query_top(scored, 8, "score", ["row_id"], cap=4).select("query_id", "rank", "doc_id", "row_id", "score")


def winner_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.winner_depth(stored(best_hits(spark, sf_dir, 4))).select("query_id", "rank", "doc_id", "row_id", "score")


def anchor_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fold_targets(best_hits(spark, sf_dir, 1, sections=True))


def folded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.winner_depth(stored(ranking.fold_anchors(stored(best_hits(spark, sf_dir, 4, sections=True))))).select("query_id", "rank", "doc_id", "row_id", "score", "lifted")


def budget_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors outbid the other rows here, so that most winners are lifted; a row has as many words as its id has units."""
    scored = stored(best_hits(spark, sf_dir, 1, sections=True, budget=40)).withColumn("score", F.when(F.col("section") == "sq", F.col("score") + 1).otherwise(F.col("score")))
    folded = ranking.fold_anchors(scored).withColumn("n_words", F.col("row_id") % 10)
    return ranking.budget_merge(folded, 40)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with ten rows in a row as the windows of one document."""
    rows, queries = vectors(spark, sf_dir)
    scored = dense.pair_scores(rows, queries, top=64)
    scored = scored.select("query_id", "row_id", "score", F.expr("row_id div 10").alias("doc_id"), (F.col("row_id") % 10).alias("pos"), F.lit("chunk").alias("section"))
    return index.per_query_top(scored, 8, "score", ["row_id"], cap=4)


def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = vectors(spark, sf_dir)
    windows = rows.select(F.expr("row_id div 10").alias("doc_id"), (F.col("row_id") % 10).alias("pos"))
    return ranking.neighbours(_passages(spark, sf_dir), windows)


def stitch_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("n", F.size(F.filter(F.split("body", " "), lambda w: w == "that"))).where("n > 0")
    rows = chunks.select(F.lit(0).alias("query_id"), "doc_id", F.col("chunk_ord").alias("pos"), "body", F.col("n").alias("score"))
    return ranking.stitch(rows).select("doc_id", "first_pos", "last_pos", "n_windows", "score", F.sha1("passage").alias("passage_sha1"))


def reserved_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stored(best_hits(spark, sf_dir, 8, sections=True))
    main = index.per_query_top(scored.where("section = 'chunk'"), 8, "score", ["row_id"], cap=4)
    extra = index.per_query_top(scored, 8, "score", ["row_id"])
    return ranking.reserved_merge(main, extra)


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = index.per_query_top(best_hits(spark, sf_dir, 4), 8, "score", ["row_id"], cap=4)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.length("url").alias("page"))
    return ranking.distinct_sources(top, pages)


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query vector's own label is among the first three documents found without the vector itself."""
    rows, queries = vectors(spark, sf_dir)
    others = best_hits(spark, sf_dir, 5).where("row_id <> query_id")
    ranked = ranking.distinct_sources(index.per_query_top(others, 8, "score", ["row_id"], cap=4))
    gold = queries.select("query_id").join(rows.select(F.col("row_id").alias("query_id"), "doc_id"), "query_id")
    return ranking.hit_at(ranked, gold)


def starvation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose leading document leaves others a row at most."""
    top = index.per_query_top(best_hits(spark, sf_dir, 8), 8, "score", ["row_id"])
    per = top.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id"))
    two = per.withColumn("at", at).groupBy("query_id").agg(F.max(F.when(F.col("at") == 1, F.col("n"))).alias("leader"), F.coalesce(F.max(F.when(F.col("at") == 2, F.col("n"))), F.lit(0)).alias("runner_up"), F.count(F.lit(1)).alias("n_docs"))
    return two.withColumn("starved", (F.col("n_docs") > 1) & (F.col("runner_up") <= 1) & (F.col("leader") >= 3))


QUERIES = {f.__name__: f for f in (
    chunk_windows, anchor_questions, vocabulary, term_df, term_weights, lexical_topk, unknown_terms, scope_semi, known_anti, cosine_topk, hybrid_score,
    winner_depth, anchor_fold, folded_topk, budget_merge, neighbour_expand, stitch_islands, reserved_merge, distinct_sources, hit_at_k, starvation,
)}

_TERMS = r"""q_words AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS word FROM benchmark),
terms AS (SELECT query_id, lower(trim(word, '?.,:;!"''()[]')) AS term FROM q_words WHERE length(lower(trim(word, '?.,:;!"''()[]'))) >= 3)"""
_DF = f"""{WINDOWS_SQL}, {_TERMS},
folded AS (SELECT chunk_id, lower(text) AS t FROM windows),
kinds AS (SELECT DISTINCT term FROM terms),
held AS (SELECT term, chunk_id FROM kinds, folded WHERE contains(t, term)),
dfs AS (SELECT kinds.term, count(chunk_id) AS df FROM kinds LEFT JOIN held USING (term) GROUP BY 1),
weights AS (SELECT term, df, round_even(least(ln(1 + (SELECT count(*) FROM windows)::DOUBLE / (1 + df)) / ln(21.0::DOUBLE), 1.5::DOUBLE) / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS weight FROM dfs)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)"
_CAP = f"capped AS (SELECT *, {_TOP} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, row_id) AS d FROM {{src}}) WHERE d <= 4)"
_DEPTH = """kinds AS (SELECT *, CASE WHEN rank <= 8 AND leads THEN 'L' WHEN leads THEN 'E' WHEN rank <= 8 THEN 'O' END AS kind
  FROM (SELECT *, doc_id = first_value(doc_id) OVER (PARTITION BY query_id ORDER BY rank) AS leads FROM capped)),
sizes AS (SELECT query_id, count(*) FILTER (kind = 'L') AS l, count(*) FILTER (kind = 'E') AS e, count(*) FILTER (kind = 'O') AS o FROM kinds GROUP BY 1),
ends AS (SELECT kinds.*, least(greatest(4 - l, 0), e, o) AS swaps, row_number() OVER (PARTITION BY kinds.query_id, kind ORDER BY CASE WHEN kind = 'O' THEN -rank ELSE rank END) AS nth FROM kinds JOIN sizes USING (query_id)),
final AS (SELECT * FROM ends WHERE kind = 'L' OR kind = 'O' AND nth > swaps OR kind = 'E' AND nth <= swaps)"""
_FOLD = """per AS (SELECT query_id, doc_id, max(score) FILTER (section = 'sq') AS anchor_score, max(score) FILTER (section <> 'sq') AS best_score,
  arg_max(row_id, (score, -row_id)) FILTER (section <> 'sq') AS best_id, arg_max(row_id, (score, -row_id)) FILTER (section = 'key-facts') AS facts_id FROM hits GROUP BY 1, 2),
targets AS (SELECT query_id, doc_id, anchor_score, best_score, coalesce(facts_id, best_id) AS target_id, anchor_score > best_score AS lifted FROM per WHERE anchor_score IS NOT NULL AND best_score IS NOT NULL),
folded AS (SELECT h.query_id, h.row_id, h.doc_id, h.section, coalesce(t.anchor_score, h.score) AS score, t.target_id IS NOT NULL AS lifted
  FROM hits h LEFT JOIN targets t ON t.lifted AND t.query_id = h.query_id AND t.target_id = h.row_id WHERE h.section <> 'sq')"""

ORACLE_SQL = {
    "chunk_windows": f"WITH {WINDOWS_SQL} SELECT doc_id, chunk_ord, chunk_id, text FROM windows",
    "anchor_questions": """
WITH l AS (SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS q FROM benchmark),
r AS (SELECT item_id, unnest(q) AS text, unnest(range(len(q))) AS k FROM l), f AS (SELECT item_id, text, min(k) AS k FROM r GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS i FROM f)
SELECT item_id || '__sq' || i AS id, item_id AS doc_id, text FROM n WHERE length(text) >= 12""",
    "vocabulary": f"""
WITH {WINDOWS_SQL}, w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')) AS word FROM windows)
SELECT DISTINCT lower(trim(word, '?.,:;!"''()[]')) AS word FROM w WHERE length(lower(trim(word, '?.,:;!"''()[]'))) >= 2""",
    "term_df": f"WITH {_DF} SELECT term, df FROM dfs",
    "term_weights": f"WITH {_DF} SELECT term, df, weight FROM weights",
    "lexical_topk": f"""
WITH {_DF}, n AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
s AS (SELECT t.query_id, h.chunk_id, round(sum(w.weight) / any_value(n.n), 6) AS overlap FROM terms t JOIN held h USING (term) JOIN weights w USING (term) JOIN n ON n.query_id = t.query_id GROUP BY 1, 2),
d AS (SELECT *, split_part(chunk_id, '__', 1) AS doc_id FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY overlap DESC, chunk_id) AS k FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_id) AS rank FROM c WHERE k <= 4)
SELECT query_id, rank, doc_id, chunk_id, overlap FROM r WHERE rank <= 8""",
    "unknown_terms": f"""
WITH {WINDOWS_SQL}, {_TERMS}, w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')) AS word FROM windows),
v AS (SELECT DISTINCT lower(trim(word, '?.,:;!"''()[]')) AS word FROM w WHERE length(lower(trim(word, '?.,:;!"''()[]'))) >= 2),
f AS (SELECT query_id, bool_or(v.word IS NULL) AS lacking FROM terms LEFT JOIN v ON v.word = term GROUP BY 1)
SELECT item_id AS query_id, coalesce(lacking, false) AND EXISTS (SELECT 1 FROM v) AS unknown FROM benchmark LEFT JOIN f ON f.query_id = item_id""",
    "scope_semi": "SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1",
    "known_anti": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "cosine_topk": """
WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS row_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM p) SELECT query_id, rank, row_id, score FROM r WHERE rank <= 8""",
    "hybrid_score": f"""
WITH {HITS_SQL}, {_TERMS}, mine AS (SELECT * FROM terms WHERE query_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)),
kinds AS (SELECT DISTINCT term FROM mine), folded AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
held AS (SELECT term, doc_id FROM kinds, folded WHERE contains(t, term)), dfs AS (SELECT term, count(*) AS df FROM held GROUP BY 1),
weights AS (SELECT term, round_even(least(ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (1 + df)) / ln(21.0::DOUBLE), 1.5::DOUBLE) / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS weight FROM dfs),
n AS (SELECT query_id, count(*) AS n FROM mine GROUP BY 1),
o AS (SELECT m.query_id, h.doc_id AS row_id, round(sum(weight) / any_value(n.n), 6) AS overlap FROM mine m JOIN held h USING (term) JOIN weights USING (term) JOIN n ON n.query_id = m.query_id GROUP BY 1, 2),
one AS (SELECT hits.query_id, hits.row_id, hits.doc_id, section, round(score + 0.25::DOUBLE * coalesce(overlap, 0), 3) AS s FROM hits LEFT JOIN o ON o.query_id = hits.query_id AND o.row_id = hits.row_id),
two AS (SELECT query_id, row_id, doc_id, CASE WHEN doc_id = 3 AND section <> 'sq' THEN round(s + 0.05::DOUBLE, 3) ELSE s END AS score FROM one),
{_CAP.format(src="two")} SELECT query_id, rank, doc_id, row_id, score FROM capped WHERE rank <= 8""",
    "winner_depth": f"WITH {HITS_SQL}, {_CAP.format(src='hits')}, {_DEPTH} SELECT query_id, {_TOP} AS rank, doc_id, row_id, score FROM final",
    "anchor_fold": f"WITH {HITS_SQL}, {_FOLD} SELECT * FROM targets",
    "folded_topk": f"WITH {HITS_SQL}, {_FOLD}, {_CAP.format(src='folded')}, {_DEPTH} SELECT query_id, {_TOP} AS rank, doc_id, row_id, score, lifted FROM final",
    "budget_merge": f"""
WITH {HITS_SQL.replace("hits AS", "plain AS")}, hits AS (SELECT query_id, row_id, doc_id, section, score + CASE WHEN section = 'sq' THEN 1 ELSE 0 END AS score FROM plain), {_FOLD}, sized AS (SELECT *, row_id % 10 AS n FROM folded),
winner AS (SELECT query_id, arg_max(doc_id, (score, -row_id)) AS doc_id FROM sized GROUP BY 1),
lead AS (SELECT s.query_id, s.doc_id, s.row_id AS lead_id, s.n AS lead_words FROM sized s JOIN winner USING (query_id, doc_id) WHERE s.lifted),
run AS (SELECT s.query_id, s.doc_id, lead_id, s.row_id, lead_words + sum(n) OVER (PARTITION BY s.query_id, s.doc_id ORDER BY score DESC, s.row_id ROWS UNBOUNDED PRECEDING) AS total_words
  FROM sized s JOIN lead USING (query_id, doc_id) WHERE section = 'key-facts' AND NOT s.lifted)
SELECT query_id, doc_id, lead_id, row_id, total_words::BIGINT AS total_words FROM run WHERE total_words <= 40""",
    "neighbour_expand": f"""
WITH {HITS_SQL}, p AS (SELECT query_id, row_id, row_id // 10 AS doc_id, row_id % 10 AS pos, score FROM hits), {_CAP.format(src="p")},
sel AS (SELECT * FROM capped WHERE rank <= 8),
want AS (SELECT query_id, doc_id, unnest([pos - 1, pos + 1]) AS pos, round(score - 0.001::DOUBLE, 3) AS score, rank FROM sel WHERE rank <= 2),
best AS (SELECT query_id, doc_id, pos, arg_min(score, rank) AS score FROM want WHERE pos >= 0 GROUP BY 1, 2, 3)
SELECT query_id, doc_id, pos, score FROM best WHERE (doc_id, pos) IN (SELECT vec_id // 10, vec_id % 10 FROM embeddings) AND NOT EXISTS (SELECT 1 FROM sel WHERE sel.query_id = best.query_id AND sel.doc_id = best.doc_id AND sel.pos = best.pos)""",
    "stitch_islands": f"""
WITH {WINDOWS_SQL}, s AS (SELECT doc_id, chunk_ord AS pos, string_split(body, ' ') AS w, len(list_filter(string_split(body, ' '), lambda x: x = 'that')) AS score FROM windows),
k AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s WHERE score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS r FROM k),
p AS (SELECT *, CASE WHEN r = 1 THEN array_to_string(w, ' ') ELSE array_to_string(w[41:], ' ') END AS piece FROM o)
SELECT doc_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_windows, max(score)::INT AS score, sha1(string_agg(piece, ' ' ORDER BY pos) FILTER (piece <> '')) AS passage_sha1 FROM p GROUP BY doc_id, island""",
    "reserved_merge": f"""
WITH {HITS_SQL}, raw AS (SELECT * FROM hits WHERE section = 'chunk'), {_CAP.format(src="raw")}, main AS (SELECT query_id, row_id, rank FROM capped WHERE rank <= 8),
extra AS (SELECT * FROM (SELECT query_id, row_id, {_TOP} AS rank FROM hits) WHERE rank <= 8),
fresh AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM extra e WHERE NOT EXISTS (SELECT 1 FROM main m WHERE m.query_id = e.query_id AND m.row_id = e.row_id)),
held AS (SELECT query_id, count(*) AS n FROM main GROUP BY 1),
taken AS (SELECT f.query_id, f.row_id, f.nth, 1 AS list FROM fresh f LEFT JOIN held h USING (query_id) WHERE nth <= greatest(2, 8 - coalesce(n, 0))),
added AS (SELECT query_id, count(*) AS n FROM taken GROUP BY 1),
merged AS (SELECT m.query_id, m.row_id, m.rank AS nth, 0 AS list FROM main m LEFT JOIN added a USING (query_id) WHERE m.rank <= 8 - coalesce(a.n, 0) UNION ALL SELECT * FROM taken)
SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY list, nth) AS place FROM merged""",
    "distinct_sources": f"""
WITH {HITS_SQL}, {_CAP.format(src="hits")}, top AS (SELECT * FROM capped WHERE rank <= 8),
j AS (SELECT top.*, page_id FROM top LEFT JOIN pages ON page_id = row_id),
g AS (SELECT query_id, doc_id, min(rank) AS first_rank, arg_min(row_id, (CASE WHEN page_id IS NULL THEN 1 ELSE 0 END) * 1000 + rank) AS link_id FROM j GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS place FROM g""",
    "hit_at_k": f"""
WITH {HITS_SQL}, others AS (SELECT * FROM hits WHERE row_id <> query_id), {_CAP.format(src="others")},
g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM capped WHERE rank <= 8 GROUP BY 1, 2),
t AS (SELECT vec_id AS query_id, label, (SELECT place FROM g WHERE g.query_id = vec_id AND g.doc_id = label) AS target_rank FROM embeddings WHERE vec_id IN (SELECT query_id FROM g))
SELECT query_id, target_rank, coalesce(target_rank <= 3, false) AS hit FROM t""",
    "starvation": f"""
WITH {HITS_SQL}, top AS (SELECT * FROM (SELECT query_id, doc_id, {_TOP} AS rank FROM hits) WHERE rank <= 8),
per AS (SELECT query_id, doc_id, count(*) AS n FROM top GROUP BY 1, 2), nth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS nth FROM per),
two AS (SELECT query_id, max(n) FILTER (nth = 1) AS leader, coalesce(max(n) FILTER (nth = 2), 0) AS runner_up, count(*) AS n_docs FROM nth GROUP BY 1)
SELECT *, n_docs > 1 AND runner_up <= 1 AND leader >= 3 AS starved FROM two""",
}
