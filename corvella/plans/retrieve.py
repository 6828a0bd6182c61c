"""The whole retrieval plan over a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import index, ranking, scorer
from corvella.operators.stored import stored


def asked(queries: DataFrame, chunks: DataFrame, rules: T.Rules = T.NO_RULES) -> tuple[DataFrame, DataFrame]:
    """queries with terms (term, quarters: 4 x weight x occurrences) and n_terms, and chunks with held: the terms that their texts hold.

    Document frequencies are those of all chunks.
    """
    terms = stored(index.query_terms(queries.select("query_id", "text"), rules))
    texts = chunks.select(F.col("row_id").alias("chunk_id"), "text")
    hits = stored(index.term_chunks(terms, texts, rules))
    weights = index.weights_of(hits, chunks)
    of = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(weights, "term", "left")
    cell = F.when(F.col("weight") > 0, F.struct("term", (4 * F.col("weight") * F.col("times")).cast("int").alias("quarters")))
    per = of.groupBy("query_id").agg(F.collect_list(cell).alias("terms"), F.sum("times").alias("n_terms"))
    full = queries.select("query_id", "embedding").join(per, "query_id", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)).cast("long"))
    held = hits.groupBy(F.col("chunk_id").alias("row_id")).agg(F.collect_list("term").alias("held"))
    return full, chunks.join(held, "row_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    n_results: int = 10,
    max_per_doc: int = 4,
    top_doc_depth: int = 4,
    doc_ids: DataFrame | None = None,
    boost: DataFrame | None = None,
    rules: T.Rules = T.NO_RULES,
    budget: int | None = None,
) -> DataFrame:
    """query_id, rank, doc_id, row_id, section, pos, score: the best chunks of each query.

    queries: query_id, text, embedding. chunks: row_id, doc_id, section, pos,
    text, embedding. doc_ids (doc_id): None means all documents, an empty table
    none. boost (query_id, doc_id): documents whose real rows gain 0.05.

    budget: words up to which curated rows of a lifted winner merge into its
    lead; merged rows give up their places (None: no merge).

    Dense score, lexical bonus, boost, anchor fold, merge, cap, depth,
    neighbours. Scores are whole thousandths. Document frequencies come from the
    whole index, whatever the scope. Only documents that can reach the result
    leave the scorer (see operators.scorer).
    """
    return retrieve_and_merge(queries, chunks, n_results, max_per_doc, top_doc_depth, doc_ids, boost, rules, budget)[0]


def retrieve_and_merge(
    queries: DataFrame,
    chunks: DataFrame,
    n_results: int = 10,
    max_per_doc: int = 4,
    top_doc_depth: int = 4,
    doc_ids: DataFrame | None = None,
    boost: DataFrame | None = None,
    rules: T.Rules = T.NO_RULES,
    budget: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """What retrieve gives, and the rows that merged into leads, as passages takes them."""
    full, told = asked(queries, chunks, rules)
    scoped = told if doc_ids is None else told.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    found = scorer.candidate_hits(scoped, full, n_results, boost)
    hits = found.join(scoped.select("row_id", "section", "pos"), "row_id").withColumn("score", F.col("score") / 1000)
    folded = stored(ranking.fold_anchors(hits))
    merged = None
    if budget is not None:
        merged = stored(merged_rows(folded, chunks, budget))
        folded = folded.join(merged.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    best = stored(ranking.winner_depth(folded, n_results, max_per_doc, top_doc_depth))
    raw = scoped.where(F.startswith("section", F.lit(ranking.RAW)))
    beside = ranking.neighbours(best, raw).join(raw.select("doc_id", "pos", "row_id", "section"), ["doc_id", "pos"])
    both = best.select("query_id", "doc_id", "row_id", "section", "pos", "score").unionByName(beside.select("query_id", "doc_id", "row_id", "section", "pos", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return both.select("query_id", F.row_number().over(order).alias("rank"), "doc_id", "row_id", "section", "pos", "score"), merged


def body_of(text: Column) -> Column:
    """A chunk's text without its title line."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substr(text, at + 1)).otherwise(text)


def merged_rows(folded: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """query_id, doc_id, lead_id, row_id, total_words: the curated rows that merge into a lifted winner. Of a lead all words count, of the others those of their bodies."""
    n = chunks.select(F.col("row_id").alias("_r"), F.size(T.words(F.col("text"))).alias("_all"), F.size(T.words(body_of(F.col("text")))).alias("_body"))
    sized = folded.join(n, folded.row_id == F.col("_r")).withColumn("n_words", F.when(F.col("lifted"), F.col("_all")).otherwise(F.col("_body"))).drop("_r", "_all", "_body")
    return ranking.budget_merge(sized, budget)


def passages(found: DataFrame, chunks: DataFrame, merged: DataFrame | None = None, overlap: int = 40) -> DataFrame:
    """query_id, doc_id, section, first_pos, last_pos, score, text of retrieved rows (as from retrieve).

    Raw windows that follow one another become one passage without the words
    they share; a lead is followed by the bodies that merged into it, in order.
    """
    texts = chunks.select("row_id", "text")
    rows = found.select("query_id", "doc_id", "row_id", "section", "pos", "score").join(texts, "row_id")
    raw = rows.where(F.startswith("section", F.lit(ranking.RAW))).select("query_id", "doc_id", "pos", body_of(F.col("text")).alias("body"), "score")
    stitched = ranking.stitch(raw, overlap).select("query_id", "doc_id", F.lit(ranking.RAW).alias("section"), "first_pos", "last_pos", "score", F.col("passage").alias("text"))
    kept = rows.where(~F.startswith("section", F.lit(ranking.RAW)))
    text = F.col("text")
    if merged is not None:
        bodies = merged.join(texts, "row_id").groupBy("query_id", F.col("lead_id").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct("total_words", body_of(F.col("text")).alias("b")))).alias("m"))
        kept = kept.join(bodies, ["query_id", "row_id"], "left")
        text = F.concat_ws("\n", "text", F.array_join(F.transform("m", lambda x: x["b"]), "\n"))
    return kept.select("query_id", "doc_id", "section", F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"), "score", text.alias("text")).unionByName(stitched)
