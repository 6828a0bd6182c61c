"""Toxicity scores from a counterfactual-regularised logistic classifier.

Features say which words and word beginnings occur in a text. Those that tell
the two labels apart are selected by counts over the labelled rows; a logistic
model is fitted on a bounded sample of them. Each labelled text of the sample
gives a counterfactual pair: two versions that differ in identity terms only.
A text with such terms is paired with itself under a swap of each term for
another of its group; a text without them gets a term of its own language
inserted, and the same text with another term of that group is its twin. The
squared difference of a pair's scores is part of the loss, so the mention of
one group or another moves the score little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import shared, text_chunks
from .words import NOT_ALNUM, U, Words, mix

PREFIXES = (4, 5, 6, 7, 8)
MOST_FEATURES = 2000  # strongest features of the labelled sample that the model keeps
ROWS_A_LABEL = 3000
LEAST_COUNT = 3
FAIRNESS = 5.0

# Identity terms by language and group; a term is swapped for the next of its group.
IDENTITY_GROUPS = {
    "en": [
        ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
        ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
        ["black", "white", "asian", "latino"],
        ["gay", "straight", "lesbian", "bisexual"],
        ["man", "woman"],
        ["men", "women"],
        ["male", "female", "transgender"],
        ["american", "mexican", "chinese", "african", "european"],
        ["immigrant", "refugee", "citizen"],
        ["immigrants", "refugees", "citizens"],
        ["old", "young"],
        ["disabled", "blind", "deaf"],
    ],
    "de": [
        ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"],
        ["frauen", "männer"],
        ["schwule", "lesben", "heteros"],
        ["türken", "polen", "deutsche", "araber", "afrikaner"],
        ["ausländer", "flüchtlinge", "einheimische"],
    ],
    "fr": [
        ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
        ["femmes", "hommes"],
        ["homosexuels", "lesbiennes", "hétéros"],
        ["français", "arabes", "africains", "chinois"],
        ["immigrés", "réfugiés", "citoyens"],
    ],
    "es": [
        ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
        ["mujeres", "hombres"],
        ["gais", "lesbianas", "heteros"],
        ["españoles", "mexicanos", "chinos", "africanos"],
        ["inmigrantes", "refugiados", "ciudadanos"],
    ],
}
# Words that tell these languages apart well enough to choose a term.
LANGUAGE_MARKS = {"en": {"the", "and", "of", "to", "is"}, "de": {"der", "die", "und", "ist", "nicht"}, "fr": {"le", "les", "et", "des", "est"}, "es": {"el", "los", "y", "que", "es"}}
NEXT_TERM = {a: b for groups in IDENTITY_GROUPS.values() for group in groups for a, b in zip(group, group[1:] + group[:1])}
_TERM = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(NEXT_TERM, key=len, reverse=True)) + r")(?![\p{L}\p{N}])")


def swapped(text: str) -> str:
    """The lower-cased text with each identity term replaced by the next of its group."""
    return _TERM.sub(lambda m: NEXT_TERM[m[0]], text.lower())


def counterfactuals(text: str, draw: int) -> tuple[str, str]:
    """Two versions of a text that differ in identity terms only; draw chooses where the text has none."""
    text = text.lower()
    other = swapped(text)
    if other != text:
        return text, other
    words = set(text.split())
    language = max(LANGUAGE_MARKS, key=lambda k: len(LANGUAGE_MARKS[k] & words))
    groups = IDENTITY_GROUPS[language]
    group = groups[draw % len(groups)]
    term = group[draw // len(groups) % len(group)]
    return f"{term} {text}", f"{NEXT_TERM[term]} {text}"


def features(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) once each, of the words of texts and their beginnings; only: sorted features that count."""
    words = Words(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM)
    doc = words.doc()
    rows, found = [doc], [words.hash]
    for size in PREFIXES:
        at, h = words.prefix_hash(size)
        rows.append(doc[at])
        found.append(h)
    if only is not None:
        for i, h in enumerate(found):
            hit = _place(h, only) >= 0
            rows[i], found[i] = rows[i][hit], h[hit]
    row, feature = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


def _place(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, or -1."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


class Model:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feature = features(texts, self.chosen)
        total = np.bincount(row, self.weights[_place(feature, self.chosen)], len(texts)) if len(row) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


class Pairs:
    """Counterfactual pairs: versions of rows of x, as what each adds to (1) or takes from (-1) its row."""

    def __init__(self, rows: np.ndarray, changes: list[list[np.ndarray]]):
        """changes: for each side and pair the features (own row's first) with which the version differs."""
        self.rows = rows
        self.sides = []
        for side in changes:
            at = np.repeat(np.arange(len(side)), [len(c) for c in side])
            both = np.concatenate(side) if len(side) else np.zeros(0, np.int64)
            self.sides.append((at, np.abs(both) - 1, np.sign(both).astype(float)))

    def logits(self, x: np.ndarray, w: np.ndarray, side: int) -> np.ndarray:
        at, feature, sign = self.sides[side]
        return (x @ w[:-1].astype(x.dtype))[self.rows] + w[-1] + np.bincount(at, w[feature] * sign, len(self.rows))

    def pull(self, x: np.ndarray, d: np.ndarray, side: int) -> np.ndarray:
        """The gradient over all weights where d is that of each pair's logit."""
        at, feature, sign = self.sides[side]
        own = x.T @ np.bincount(self.rows, d, len(x)).astype(x.dtype)
        return np.append(own + np.bincount(feature, d[at] * sign, x.shape[1]), d.sum())


def version(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Features that other has beyond own, plus one, and minus those (plus one) that it lacks."""
    return np.concatenate([np.setdiff1d(other, own).astype(np.int64) + 1, -(np.setdiff1d(own, other).astype(np.int64) + 1)])


def train(x: np.ndarray, y: np.ndarray, pairs: Pairs, prior: float, ridge: float = 2.0, fairness: float = FAIRNESS, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent, begun afresh where it overshoots.

    prior: the share of label 1 among all labelled rows; classes are weighted
    to it, as the sample takes as many rows of either.
    """
    x, single = x.astype(np.float32), np.float32
    n, k = x.shape
    share = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum()))
    m = len(pairs.rows)
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    penalty = np.append(np.full(k, ridge / max(n, 1)), 0.0)
    apart = sum(len(at) for at, _, _ in pairs.sides) / max(1, m)
    smooth = 0.25 * float((share[:, None] * x1 * x1).sum(axis=1).sum()) + penalty.max() + (fairness * 0.25 * apart if m else 0.0)
    w = np.zeros(k + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    ahead, t = w.copy(), 1.0

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(steps):
        g = x1.T @ (share * (sigmoid(x1 @ ahead.astype(single)) - y)).astype(single) + penalty * ahead
        if m and fairness:
            fa, fb = (sigmoid(pairs.logits(x, ahead, side)) for side in (0, 1))
            d = fairness * 2 * (fa - fb) / m
            g = g + pairs.pull(x, d * fa * (1 - fa), 0) - pairs.pull(x, d * fb * (1 - fb), 1)
        new = ahead - g / smooth
        if g @ (new - w) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def sample_labels(docs: DataFrame, labels: DataFrame, rows_a_label: int = ROWS_A_LABEL) -> tuple[DataFrame, float]:
    """The texts and labels of rows_a_label ids of each label at most, drawn by a hash of the id, and the share of label 1.

    The drawn ids are at most twice rows_a_label rows, so they are broadcast
    and no text is shuffled. Null ids, other labels and labels without a
    document draw nothing; repeated labels count once; a repeated id brings all
    its texts; empty tables give no rows and the share 0.
    """
    rows = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for label in (0, 1):
        some = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_a_label)
        drawn = some if drawn is None else drawn.union(some)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    return shared(found), sizes.get(1, 0) / max(1, sum(sizes.values()))


def fit(labelled: DataFrame, rows_a_label: int = ROWS_A_LABEL, most_features: int = MOST_FEATURES, prior: float | None = None, fairness: float = FAIRNESS) -> Model:
    """A model from labelled (text, toxic: 0 or 1); other labels and null texts don't count.

    About rows_a_label rows of each label are used, drawn by text hash, each
    with its counterfactual pair. With one label only, or no rows, scores are
    constant.
    prior: the share of label 1 where labelled is a sample with another share.
    """
    rows = labelled.where("toxic IN (0, 1) AND text IS NOT NULL").select("text", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, U), np.zeros(0), 30.0 if sizes.get(1) else -30.0)
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("toxic") == 1, rows_a_label / sizes[1]).otherwise(rows_a_label / sizes[0])
    sample = rows.where(draw < limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                row, feature = features(chunk.column("text"))
                toxic = chunk.column("toxic").to_numpy(zero_copy_only=False)[row]
                kinds, at = np.unique(feature, return_inverse=True)
                yield pa.record_batch({"feature": pa.array(kinds.view(np.int64)), "bad": pa.array(np.bincount(at, toxic, len(kinds)).astype(np.int64)), "seen": pa.array(np.bincount(at, minlength=len(kinds)).astype(np.int64))})

    counts = sample.mapInArrow(count, "feature long, bad long, seen long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    n1, n0 = (min(rows_a_label, sizes[k]) for k in (1, 0))
    p1, p0 = (F.col("bad") + 0.5) / (n1 + 1.0), (F.col("seen") - F.col("bad") + 0.5) / (n0 + 1.0)
    error = F.sqrt(1.0 / (F.col("bad") + 0.5) + 1.0 / (F.col("seen") - F.col("bad") + 0.5))
    ranked = counts.where(F.col("seen") >= LEAST_COUNT).withColumn("z", F.abs(F.log(p1 / p0)) / error).where("z > 2.0")
    best = [r.feature for r in ranked.orderBy(F.desc("z"), "feature").limit(most_features).collect()]
    terms = Words(pa.array(sorted(NEXT_TERM)), NOT_ALNUM).hash
    chosen = np.unique(np.concatenate([np.array(best, np.int64).view(U), terms]))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                texts, keys = chunk.column("text").to_pylist(), chunk.column("key").to_pylist()
                one, two = zip(*(counterfactuals(t, k & 0x7FFFFFFF) for t, k in zip(texts, keys)))
                found = {n: pa.array(_lists(pa.array(v, pa.string()), chosen), pa.binary()) for n, v in (("own", texts), ("one", one), ("two", two))}
                yield pa.record_batch({"key": chunk.column("key"), "toxic": chunk.column("toxic")} | found)

    got = sample.withColumn("key", F.xxhash64("text")).select("key", "toxic", "text").mapInArrow(rows_of, "key long, toxic int, own binary, one binary, two binary").collect()
    got.sort(key=lambda r: (r.toxic, r.key))
    own = [_places(r.own) for r in got]
    x = np.stack([_dense(p, len(chosen)) for p in own])
    y = np.array([r.toxic for r in got], float)
    pairs = Pairs(np.arange(len(got)), [[version(p, _places(r[side])) for p, r in zip(own, got)] for side in ("one", "two")])
    weights, bias = train(x, y, pairs, sizes[1] / (sizes[0] + sizes[1]) if prior is None else prior, fairness=fairness)
    return Model(chosen, weights, bias)


def _lists(texts: pa.Array, chosen: np.ndarray) -> list[bytes]:
    row, feature = features(texts, chosen)
    place = _place(feature, chosen).astype(np.int32)
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    return [place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _places(places: bytes) -> np.ndarray:
    return np.frombuffer(places, np.int32)


def _dense(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.float32)
    out[places] = 1
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every row's whole text.

    Null and empty texts get the score of no features; repeated rows come back
    repeated; an empty table gives no rows; other columns of docs are ignored.
    A very long text comes alone and whole; its features are counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                s = model.scores(chunk.column("text").fill_null(""))
                yield pa.record_batch({"doc_id": chunk.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
