"""Reshaping of ranked hits.

Hits have query_id, doc_id, section, score and a row_id that orders equal
scores. section: 'sq' for anchor questions, 'key-facts...' for curated rows,
'chunk...' for raw windows. Every window is partitioned by query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANCHOR, CURATED, RAW = "sq", "key-facts", "chunk"


def _best_first(*keys: str) -> Window:
    return Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "row_id")


def capped(hits: DataFrame, cap: int = 4) -> DataFrame:
    """At most `cap` rows of a document, best first; adds rank over what is left."""
    kept = hits.withColumn("_d", F.row_number().over(_best_first("doc_id"))).where(F.col("_d") <= cap).drop("_d")
    return kept.withColumn("rank", F.row_number().over(_best_first()))


def _top(hits: DataFrame, n: int, cap: int) -> DataFrame:
    """The best n of the capped rows; tasks keep cap a document and n a query before each shuffle."""
    return capped(hits, cap).where(F.col("rank") <= n)


def winner_depth(hits: DataFrame, n: int = 8, cap: int = 4, depth: int = 4) -> DataFrame:
    """The best n rows, with up to `depth` rows of the leading document.

    Rows of other documents at the end of the list give way to further rows of
    the leader, as many as it lacks and has. rank is that of the final order.
    """
    top = _top(hits, n, cap)
    leader = top.where("rank = 1").select(F.col("query_id").alias("_q"), F.col("doc_id").alias("_lead"))
    # Beyond the best n only the leader's own rows matter: cap of them at most.
    own = hits.join(leader, (F.col("query_id") == F.col("_q")) & F.col("doc_id").eqNullSafe(F.col("_lead")), "left_semi")
    own = own.withColumn("_d", F.row_number().over(_best_first("doc_id"))).where(F.col("_d") <= cap).drop("_d")
    beyond = own.join(top.select(F.col("query_id").alias("_q"), F.col("row_id").alias("_r")), (F.col("query_id") == F.col("_q")) & (F.col("row_id") == F.col("_r")), "left_anti")
    beyond = beyond.withColumn("rank", F.row_number().over(_best_first()) + n)
    rows = top.unionByName(beyond)
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("leads", F.first("doc_id").over(q.orderBy("rank")).eqNullSafe(F.col("doc_id")))
    inside = F.col("rank") <= n
    rows = rows.withColumn("kind", F.when(inside & F.col("leads"), "L").when(~inside & F.col("leads"), "E").when(inside, "O"))
    size = {k: F.sum((F.col("kind") == k).cast("int")).over(q) for k in "LEO"}
    swaps = F.least(F.greatest(F.lit(min(depth, cap)) - F.coalesce(size["L"], F.lit(0)), F.lit(0)), F.coalesce(size["E"], F.lit(0)), F.coalesce(size["O"], F.lit(0)))
    if depth <= 1:
        swaps = F.lit(0)
    rows = rows.withColumn("swaps", swaps)
    ends = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.when(F.col("kind") == "O", -F.col("rank")).otherwise(F.col("rank"))))
    rows = rows.withColumn("at", ends)
    kept = rows.where((F.col("kind") == "L") | ((F.col("kind") == "O") & (F.col("at") > F.col("swaps"))) | ((F.col("kind") == "E") & (F.col("at") <= F.col("swaps"))))
    kept = kept.drop("leads", "kind", "swaps", "at", "rank")
    return kept.withColumn("rank", F.row_number().over(_best_first()))


def fold_targets(hits: DataFrame) -> DataFrame:
    """query_id, doc_id, anchor_score, best_score, target_id, lifted, for documents with anchors and real rows.

    Where the best anchor scores above the best real row, the document's best
    curated row, or else its best real row, is to take the anchor's score.
    """
    real = F.col("section") != ANCHOR
    curated = F.startswith(F.col("section"), F.lit(CURATED))

    def first(of):
        return F.max(F.when(of, F.struct("score", (-F.col("row_id")).alias("r"))))

    per = hits.groupBy("query_id", "doc_id").agg(F.max(F.when(~real, F.col("score"))).alias("anchor_score"), first(real).alias("best"), first(curated).alias("facts"))
    per = per.where("anchor_score IS NOT NULL AND best IS NOT NULL")
    lifted = F.col("anchor_score") > F.col("best.score")
    return per.select("query_id", "doc_id", "anchor_score", F.col("best.score").alias("best_score"), (-F.coalesce("facts.r", "best.r")).alias("target_id"), lifted.alias("lifted"))


def fold_anchors(hits: DataFrame) -> DataFrame:
    """hits without anchor rows, the targets of lifted documents at the anchor's score; adds lifted."""
    t = fold_targets(hits).where("lifted").select(F.col("query_id").alias("_q"), F.col("target_id").alias("_t"), "anchor_score")
    real = hits.where(F.col("section") != ANCHOR)
    joined = real.join(t, (F.col("query_id") == F.col("_q")) & (F.col("row_id") == F.col("_t")), "left")
    return joined.withColumn("lifted", F.col("_t").isNotNull()).withColumn("score", F.coalesce("anchor_score", "score")).drop("_q", "_t", "anchor_score")


def budget_merge(folded: DataFrame, budget: int = 180) -> DataFrame:
    """The curated rows that merge into a lifted winner, in order.

    folded: as from fold_anchors, with n_words. Where the best row of a query
    belongs to a lifted document, that document's other curated rows join its
    lifted row, best first, while the running word count stays in the budget.
    Gives query_id, doc_id, lead_id, row_id, total_words.
    """
    winner = folded.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("row_id")).alias("r"), "doc_id")).alias("w")).select("query_id", F.col("w.doc_id").alias("doc_id"))
    lead = folded.where("lifted").join(winner, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", F.col("row_id").alias("lead_id"), F.col("n_words").alias("lead_words"))
    rest = folded.where(F.startswith(F.col("section"), F.lit(CURATED)) & ~F.col("lifted")).join(lead, ["query_id", "doc_id"])
    running = F.sum("n_words").over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "row_id").rowsBetween(Window.unboundedPreceding, 0))
    return rest.withColumn("total_words", (F.col("lead_words") + running).cast("long")).where(F.col("total_words") <= budget).select("query_id", "doc_id", "lead_id", "row_id", "total_words")


def neighbours(selected: DataFrame, windows: DataFrame, first: int = 2, less: float = 0.001) -> DataFrame:
    """The windows beside the first selected raw rows that are not selected yet.

    selected: query_id, doc_id, pos, section, score, rank. windows: doc_id, pos.
    A neighbour scores a little less than its anchor; one wanted twice goes to
    the better-ranked anchor.
    """
    raw = selected.where(F.startswith(F.col("section"), F.lit(RAW)))
    wanted = raw.where(F.col("rank") <= first).select("query_id", "doc_id", F.explode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("pos"), F.round(F.col("score") - less, 3).alias("score"), "rank").where("pos >= 0")
    wanted = wanted.groupBy("query_id", "doc_id", "pos").agg(F.min(F.struct("rank", "score")).alias("by"))
    found = wanted.join(windows.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_semi")
    return found.join(raw.select("query_id", "doc_id", "pos"), ["query_id", "doc_id", "pos"], "left_anti").select("query_id", "doc_id", "pos", F.col("by.score").alias("score"))


def stitch(rows: DataFrame, overlap: int = 40) -> DataFrame:
    """Consecutive raw windows (query_id, doc_id, pos, body, score) as one passage each.

    Gives query_id, doc_id, first_pos, last_pos, n_windows, score, passage: the
    first body, then the others without their first `overlap` words.
    """
    order = Window.partitionBy("query_id", "doc_id").orderBy("pos")
    rows = rows.dropDuplicates(["query_id", "doc_id", "pos"]).withColumn("island", F.col("pos") - F.row_number().over(order))
    rows = rows.withColumn("opens", F.row_number().over(Window.partitionBy("query_id", "doc_id", "island").orderBy("pos")) == 1)
    tail = F.array_join(F.slice(F.split("body", " "), overlap + 1, 1_000_000), " ")
    rows = rows.withColumn("piece", F.when(F.col("opens"), F.col("body")).otherwise(tail))
    parts = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    pieces = F.filter(F.transform(parts, lambda p: p["piece"]), lambda p: p != "")
    return rows.groupBy("query_id", "doc_id", "island").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n_windows"), F.max("score").alias("score"), F.array_join(pieces, " ").alias("passage")
    ).drop("island")


def reserved_merge(main: DataFrame, extra: DataFrame, slots: int = 8, reserve: int = 2) -> DataFrame:
    """Two ranked lists (query_id, row_id, rank) in one of `slots`: extra rows not in main get max(reserve, slots - len(main)) places after main's head."""
    fresh = extra.join(main.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank")
    fresh = fresh.withColumn("at", F.row_number().over(order))
    sizes = main.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    room = F.greatest(F.lit(reserve), F.lit(slots) - F.coalesce("held", F.lit(0)))
    taken = fresh.join(sizes, "query_id", "left").where(F.col("at") <= room).select("query_id", "row_id", "at", F.lit(1).alias("list"))
    counts = taken.groupBy("query_id").agg(F.count(F.lit(1)).alias("added"))
    head = main.join(counts, "query_id", "left").where(F.col("rank") <= F.lit(slots) - F.coalesce("added", F.lit(0))).select("query_id", "row_id", F.col("rank").alias("at"), F.lit(0).alias("list"))
    merged = head.unionByName(taken)
    return merged.select("query_id", "row_id", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "at")).alias("place"))


def distinct_sources(hits: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, first_rank, link_id, place: documents in the order they first appear.

    link_id: the document's first row that pages (row_id, page) covers, else its first row.
    """
    hits = hits.join(pages.select("row_id", "page"), "row_id", "left") if pages is not None else hits.withColumn("page", F.lit(None).cast("long"))
    per = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_rank"), F.min(F.struct(F.col("page").isNull().alias("none"), "rank", "row_id")).alias("link"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank"))
    return per.select("query_id", "doc_id", "first_rank", F.col("link.row_id").alias("link_id"), place.alias("place"))


def hit_at(ranked_docs: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """query_id, target_rank, hit: rank of the first expected document (gold: query_id, doc_id), hit null without gold."""
    found = gold.join(ranked_docs.select("query_id", "doc_id", "place"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("place").alias("target_rank"))
    queries = ranked_docs.select("query_id").distinct()
    joined = queries.join(found.withColumn("_gold", F.lit(True)), "query_id", "left")
    return joined.select("query_id", "target_rank", F.when(F.col("_gold"), F.coalesce(F.col("target_rank") <= k, F.lit(False))).alias("hit"))
