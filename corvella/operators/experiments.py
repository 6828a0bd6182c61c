"""Experiments on retrieval: degraded questions, reachability, layers, ablations, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T

from . import sampling
from .stored import sent_if_small

KINDS = ("typo", "fragment", "slang", "ocr", "no-marks")
TYPOS = ("swap", "double", "drop", "near")
# Fixed value: the letters among which a neighbouring key is drawn.
LETTERS = "אבגדהוזחטיכלמנסעפצקרשת"


def _dice(salt: int, *of: Column) -> Column:
    return F.xxhash64(F.lit(salt), *of)


def typo(word: Column, kind: Column, at: Column, letters: str = LETTERS) -> Column:
    """word with one slip at a 1-based place before its last letter: two letters swapped, one doubled, dropped or another one; words under three letters stay."""
    a, b, rest = F.left(word, at - 1), F.substr(word, at, F.lit(1)), F.substr(word, at + 1)
    other = F.substr(F.lit(letters), F.pmod(_dice(3, word, at), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    slipped = (
        F.when(kind == "swap", F.concat(a, F.left(rest, F.lit(1)), b, F.substr(rest, F.lit(2))))
        .when(kind == "double", F.concat(a, b, b, rest)).when(kind == "drop", F.concat(a, rest)).otherwise(F.concat(a, other, rest))
    )
    return F.when(F.length(word) < 3, word).otherwise(slipped)


def degraded(questions: DataFrame, slang: dict[str, str], letters: str = LETTERS, marks: str = "?,״", seed: int = 1) -> DataFrame:
    """id, kind, text of questions (id, text), each spoilt in one of five ways that a hash of its id chooses.

    typo: a slip in two of over two words. fragment: the last two or three of
    over four words are gone. slang: the first listed word in it is replaced
    once. ocr: digits as a scanner reads them. no-marks, also where another way
    doesn't apply: marks are gone.
    """
    words = T.words(F.col("text"))
    n = F.size("words")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(_dice(seed, F.col("id")), F.lit(len(KINDS))) + 1).cast("int"))
    rows = questions.select("id", "text", words.alias("words")).withColumn("drawn", kind)
    fits = ((F.col("drawn") == "typo") & (n > 2)) | ((F.col("drawn") == "fragment") & (n > 4)) | F.col("drawn").isin("slang", "ocr")
    rows = rows.withColumn("kind", F.when(fits, F.col("drawn")).otherwise("no-marks"))
    first = F.pmod(_dice(seed + 1, F.col("id")), n).cast("int")
    second = F.pmod(first + 1 + F.pmod(_dice(seed + 2, F.col("id")), F.greatest(n - 1, F.lit(1))), n).cast("int")

    def slip(w: Column, i: Column) -> Column:
        how = F.element_at(F.array(*map(F.lit, TYPOS)), (F.pmod(_dice(seed + 3, w), F.lit(4)) + 1).cast("int"))
        at = (F.pmod(_dice(seed + 4, w), F.greatest(F.length(w) - 1, F.lit(1))) + 1).cast("int")
        return F.when(i.isin(first, second), typo(w, how, at, letters)).otherwise(w)

    gone = (F.pmod(_dice(seed + 5, F.col("id")), F.lit(2)) + 2).cast("int")
    replaced = F.col("text")
    for plain, said in reversed(slang.items()):
        at = F.instr("text", plain)
        once = F.concat(F.left("text", at - 1), F.lit(said), F.substr("text", at + len(plain)))
        replaced = F.when(at > 0, once).otherwise(replaced)
    text = (
        F.when(F.col("kind") == "typo", F.array_join(F.transform("words", slip), " "))
        .when(F.col("kind") == "fragment", F.array_join(F.slice("words", F.lit(1), F.greatest(F.lit(3), n - gone)), " "))
        .when(F.col("kind") == "slang", replaced).when(F.col("kind") == "ocr", F.translate("text", "710938", "170693"))
        .otherwise(F.translate("text", marks, ""))
    )
    return rows.select("id", "kind", text.alias("text"))


def some_of(rows: DataFrame, key: str, percent: int = 25, seed: int = 7) -> DataFrame:
    """About that share of the rows, by a seeded hash of the key: a sampling operator."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(100)) < percent)


def combinations(roles: DataFrame, situations: DataFrame, n: int, a_call: int = 8, seed: int = 7) -> DataFrame:
    """role, persona, situation: as many of all combinations, in a seeded order, as n questions need at `a_call` each. Both tables are lists of a prompt's wordings."""
    every = roles.crossJoin(sent_if_small(situations, "situation"))
    return every.orderBy(F.md5(F.concat_ws("|", "role", "persona", "situation", F.lit(str(seed))))).limit(-(-n // a_call))


def outcome(answered: Column, unanswered: Column) -> Column:
    """nothing, full or partial from the numbers of parts answered and not; unknown ones are partial."""
    return F.when(answered == 0, "nothing").when(unanswered == 0, "full").otherwise("partial")


def self_retrieval(anchors: DataFrame, ranked: DataFrame, probes: int = 6, within: int = 5) -> DataFrame:
    """doc_id, self_rank, best_anchor, anchors_probed, reachable: the best rank of a document over its first anchors (doc_id, pos, anchor_id) in ranked (query_id, doc_id, place). Equal ranks: the first anchor."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    tried = anchors.withColumn("nth", nth).where(F.col("nth") <= probes)
    found = tried.join(ranked.select(F.col("query_id").alias("anchor_id"), "doc_id", "place"), ["anchor_id", "doc_id"], "left")
    best = F.min(F.when(F.col("place").isNotNull(), F.struct("place", "nth", "anchor_id")))
    per = found.groupBy("doc_id").agg(best.alias("b"), F.count(F.lit(1)).alias("anchors_probed"))
    return per.select("doc_id", F.col("b.place").alias("self_rank"), F.col("b.anchor_id").alias("best_anchor"), "anchors_probed", F.coalesce(F.col("b.place") <= within, F.lit(False)).alias("reachable"))


def rank_without_anchors(hits: DataFrame, gold: DataFrame, anchor: str = "sq") -> DataFrame:
    """query_id, target_rank, section: where the first expected document (gold: query_id, doc_id) ranks once anchor rows are gone, and its best row's section."""
    real = hits.where(F.col("section") != anchor)
    best = real.groupBy("query_id", "doc_id").agg(F.max(F.struct("score", (-F.col("row_id")).alias("r"), "section")).alias("b"))
    wanted = best.join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.max("b").alias("own"))
    # The rank is one more than the number of documents whose best row comes first: a count, not a sort.
    ahead = best.join(wanted, "query_id").groupBy("query_id").agg((F.count_if(F.col("b") > F.col("own")) + 1).alias("target_rank"), F.first("own").alias("own"))
    return ahead.select("query_id", "target_rank", F.col("own.section").alias("section"))


def layer_audit(deployed: DataFrame, stripped: DataFrame, k: int = 3, curated: str = "key-facts") -> DataFrame:
    """One row: cases, hits with anchors (deployed: query_id, hit), hits without (stripped: as above), and of those the ones won by curated rows."""
    joined = deployed.select("query_id", F.coalesce("hit", F.lit(False)).alias("a")).join(stripped, "query_id", "left")
    b = F.coalesce(F.col("target_rank") <= k, F.lit(False))
    return joined.agg(F.count(F.lit(1)).alias("cases"), F.count_if("a").alias("with_anchors"), F.count_if(b).alias("without_anchors"), F.count_if(b & F.startswith("section", F.lit(curated))).alias("by_curated"), F.count_if(F.col("a") & ~b).alias("only_by_anchor"))


def ablation(run: Callable[[int], DataFrame], base: int, factors: tuple[int, ...] = (2, 4)) -> DataFrame:
    """factor, query_id, n_base, n_now, added: rows (query_id, row_id) that a run gains when its budget grows."""
    first = run(base).select("query_id", "row_id")
    n_base = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_base"))
    out = None
    for factor in factors:
        now = run(base * factor).select("query_id", "row_id")
        new = now.join(first.withColumn("_b", F.lit(1)), ["query_id", "row_id"], "left")
        per = new.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_now"), F.count_if(F.col("_b").isNull()).alias("added"))
        part = per.join(n_base, "query_id", "left").select(F.lit(factor).alias("factor"), "query_id", F.coalesce("n_base", F.lit(0)).alias("n_base"), "n_now", "added")
        out = part if out is None else out.unionByName(part)
    return out


def probe_sample(rows: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Up to n rows (id, source, band): of the yellow band, or, if there is none, of all but the green; two thirds blind ones, else inside_out."""
    some = rows.where("band = 'yellow'").limit(1).count()
    pool = rows.where("band = 'yellow'" if some else "band <> 'green'")
    sizes = {r.source: r.n for r in pool.groupBy(F.when(F.col("source").isin("blind", "inside_out"), F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = min(n, sum(sizes.values()))
    blind = min(sizes.get("blind", 0), n * 2 // 3)
    return sampling.stratified(pool, "id", "source", {"blind": blind, "inside_out": n - blind}, seed)


def call_cost(rows: DataFrame, prices: DataFrame, default: tuple[float, float], write: float = 1.25, read: float = 0.10, batch: float = 0.5, digits: int = 8) -> DataFrame:
    """rows (model, tokens_in, tokens_out, cache_write, cache_read, batch) with cost: prices (model, price_in, price_out) are by a million tokens; unknown models take the default."""
    p = prices.select(F.col("model").alias("_m"), "price_in", "price_out")
    joined = rows.join(sent_if_small(p, "_m"), F.col("model") == F.col("_m"), "left")  # a shuffle would send all rows of a model to one task
    a, b = F.coalesce("price_in", F.lit(default[0])), F.coalesce("price_out", F.lit(default[1]))
    total = (F.col("tokens_in") * a + F.col("tokens_out") * b + F.col("cache_write") * a * F.lit(write) + F.col("cache_read") * a * F.lit(read)) / F.lit(1e6)
    return joined.withColumn("cost", F.round(total * F.when(F.col("batch"), F.lit(batch)).otherwise(F.lit(1.0)), digits)).drop("_m", "price_in", "price_out")


def percentage_band(value: Column, bands: list[tuple[int, float]], default: float) -> Column:
    """The percentage of the highest band whose least value is reached."""
    out = F.lit(default)
    for least, percent in sorted(bands):
        out = F.when(value >= least, F.lit(percent)).otherwise(out)
    return out
