"""Vocabulary, document frequencies and lexical scores of a chunk index.

A term matches a chunk where one of its forms stands anywhere in the chunk's
folded text. Forms have no white space, so that is the case just where a word
of the chunk contains a form. Distinct words are cut into substrings and met
with the forms by an equi-join; no term is tried against every chunk, and chunk
words meet only the words that hold a form. What terms hold is stored once and
serves document frequencies and scores alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import amounts
from corvella.functions import text as T

from .stored import sent_if_small, stored

LEXICAL_SHARE = 0.25


def chunk_words(chunks: DataFrame, rules: T.Rules = T.NO_RULES) -> DataFrame:
    """chunk_id, word: the distinct folded words of each chunk, as they stand."""
    return chunks.select("chunk_id", F.explode(F.array_distinct(T.words(T.fold(F.col("text"), rules)))).alias("word"))


def vocabulary(texts: DataFrame, rules: T.Rules = T.NO_RULES, least: int = 2) -> DataFrame:
    """Distinct folded words without marks at their ends, of `least` letters or more. texts: documents will do, as chunks hold no other words."""
    words = texts.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return words.select(T.fold(T.bare(F.col("word")), rules).alias("word")).where(F.length("word") >= least).distinct()


def query_terms(queries: DataFrame, rules: T.Rules = T.NO_RULES) -> DataFrame:
    """query_id, pos, term, forms: the words of each query that have forms; repeated words stay."""
    rows = queries.select("query_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    rows = rows.withColumn("forms", T.term_variants(F.col("word"), rules)).where(F.size("forms") > 0)
    return rows.select("query_id", "pos", F.array_join(F.array_sort("forms"), "|").alias("term"), "forms")


def words_with_terms(terms: DataFrame, kinds: DataFrame) -> DataFrame:
    """term, word: the words (word, distinct and folded) that contain a form of the term."""
    forms = terms.select("term", F.explode("forms").alias("form")).distinct()
    sizes = forms.agg(F.collect_set(F.length("form")).alias("s")).first().s or []  # lengths: few
    if not sizes:
        return kinds.select(F.col("word").alias("term"), "word").limit(0)
    # Pieces of each length of form, one explode a length and no array of arrays.
    size = F.explode(F.array(*map(F.lit, sorted(sizes))))
    cut = kinds.select("word", size.alias("n")).where(F.length("word") >= F.col("n"))
    cut = cut.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1)).alias("at"))
    pieces = cut.select("word", F.expr("substring(word, at, n)").alias("form"))
    return pieces.join(sent_if_small(forms, "form", "term"), "form").select("term", "word").distinct()


def term_chunks(terms: DataFrame, chunks: DataFrame, rules: T.Rules = T.NO_RULES, texts: DataFrame | None = None) -> DataFrame:
    """term, chunk_id: where a form of the term stands in the chunk's folded text.

    texts: a table whose column text has all words of the chunks, such as the
    documents that they were cut from; by default the chunks.
    """
    source = chunks if texts is None else texts
    kinds = source.select(F.explode(F.array_distinct(T.words(T.fold(F.col("text"), rules)))).alias("word")).distinct()
    held = stored(words_with_terms(terms, kinds))
    return chunk_words(chunks, rules).join(sent_if_small(held, "word", "term"), "word").select("term", "chunk_id").distinct()


def document_frequency(terms: DataFrame, chunks: DataFrame, rules: T.Rules = T.NO_RULES, texts: DataFrame | None = None) -> DataFrame:
    """term, df: the number of chunks that hold it, 0 included."""
    found = term_chunks(terms, chunks, rules, texts).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.select("term").distinct().join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def term_weights(terms: DataFrame, chunks: DataFrame, rules: T.Rules = T.NO_RULES, texts: DataFrame | None = None) -> DataFrame:
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    df = document_frequency(terms, chunks, rules, texts)
    return df.join(F.broadcast(n)).select("term", "df", amounts.term_weight(F.col("df"), F.col("n")).alias("weight"))  # n: one row


def weights_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """term, weight of the terms of hits (term, chunk_id)."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    found = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return found.join(F.broadcast(n)).select("term", amounts.term_weight(F.col("df"), F.col("n")).alias("weight"))  # n: one row


def lexical_scores(queries: DataFrame, chunks: DataFrame, rules: T.Rules = T.NO_RULES, texts: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, overlap: the matched terms' weights over the number of terms; chunks without a match have no row."""
    terms = query_terms(queries, rules)
    per_query = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    counts = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = stored(term_chunks(terms, chunks, rules, texts))
    found = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    weighted = counts.join(found, "term").join(F.broadcast(n)).select("query_id", "term", (F.col("times") * amounts.term_weight(F.col("df"), F.col("n"))).alias("w"))  # n: one row
    sums = hits.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("w"))  # weights are multiples of 0.25: sums are exact
    return sums.join(per_query, "query_id").select("query_id", "chunk_id", F.round(F.col("w") / F.col("n_terms"), 6).alias("overlap"))


def unknown_terms(queries: DataFrame, texts: DataFrame, rules: T.Rules = T.NO_RULES) -> DataFrame:
    """query_id, unknown: whether some term has no form in the vocabulary; false for an empty vocabulary."""
    terms = query_terms(queries, rules)
    known = vocabulary(texts, rules)
    forms = terms.select("term", F.explode("forms").alias("form")).distinct()
    held = stored(known.join(forms.select("form").distinct(), F.col("form") == F.col("word"), "left_semi"))
    some = known.limit(1).agg(F.count(F.lit(1)).alias("some"))
    ok = forms.join(held, F.col("form") == F.col("word"), "left_semi").select("term").distinct().withColumn("known", F.lit(True))
    flags = terms.select("query_id", "term").join(ok, "term", "left").groupBy("query_id").agg(F.max(F.col("known").isNull()).alias("lacking"))
    return queries.select("query_id").join(flags, "query_id", "left").join(F.broadcast(some)).select("query_id", (F.coalesce("lacking", F.lit(False)) & (F.col("some") > 0)).alias("unknown"))  # some: one row


def per_query_top(rows: DataFrame, n: int, score: str, ties: list[str | Column], cap: int | None = None, doc: str = "doc_id") -> DataFrame:
    """The n best rows of each query_id, at most cap of a document; ties in ascending order. Adds rank. Tasks keep n (cap) rows each before the shuffle."""
    order = [F.desc(score), *ties]
    if cap is not None:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", doc).orderBy(*order))).where(F.col("_d") <= cap).drop("_d")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)
