"""Language ID by hierarchical discrimination.

Texts become histograms of hashed byte trigrams. Linear support vector
machines first tell the language families apart (one against the rest), then
one-versus-one machines separate the languages within the family found.
Families are a table of language codes; a code outside it is its own family.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import text_chunks
from .words import U, separators

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMENSIONS = 4096
ROWS_A_LANGUAGE = 500
UNKNOWN = "und"
LEAST_SCORE = 0.25  # two even choices, of family and of language
_GAP = separators(bytes(b for b in range(128) if not chr(b).isalpha()))
_LETTER = regex.compile(r"\p{L}")


def histograms(texts: pa.Array) -> np.ndarray:
    """Square roots of trigram counts, each row scaled to length 1; white space and signs count as one gap."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    out = np.zeros((n, DIMENSIONS))
    if len(data) >= 3:
        codes = np.where(_GAP[data], 32, data).astype(np.uint32)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        keep[offs[:-1][offs[:-1] < len(codes)]] = True
        doc = np.repeat(np.arange(n), np.diff(offs))[keep]
        codes = codes[keep]
        if len(codes) >= 3:
            key = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
            slot = ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - 12)).astype(np.int64)
            inside = doc[:-2] == doc[2:]
            out += np.bincount(doc[:-2][inside] * DIMENSIONS + slot[inside], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    out = np.sqrt(out)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, epochs: int = 30, seed: int = 6) -> np.ndarray:
    """Weights, the last of a constant 1, of a squared-hinge SVM by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * cost * share)
    norm = (x * x).sum(axis=1) + slack
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """families: name -> weights; pairs: (a, b) -> weights, positive for a."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs_at = np.array(langs)
        known = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for lang in known:
            self.members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        family_at = np.array([FAMILY_OF.get(c, c) for c in langs])
        names = sorted(self.members)
        self.names = names
        self.family = np.stack([linear_svm(x, np.where(family_at == f, 1, -1)) if len(names) > 1 else np.zeros(x.shape[1] + 1) for f in names]) if names else np.zeros((0, DIMENSIONS + 1))
        self.pairs: dict[tuple[str, str], np.ndarray] = {}
        for codes in self.members.values():
            for a, b in combinations(codes, 2):
                at = (langs_at == a) | (langs_at == b)
                self.pairs[a, b] = linear_svm(x[at], np.where(langs_at[at] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: the family's probability times the mean of the winner's pairs."""
        if not self.names:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        margins = x @ self.family.T
        best = margins.argmax(axis=1)
        lang = np.empty(len(x), object)
        score = _probability(margins[np.arange(len(x)), best]) if len(self.names) > 1 else np.ones(len(x))
        for f, name in enumerate(self.names):
            rows = np.flatnonzero(best == f)
            codes = self.members[name]
            won = np.zeros((len(rows), len(codes)))
            for (a, b), w in self.pairs.items():
                if a in codes:
                    p = _probability(x[rows] @ w)
                    won[:, codes.index(a)] += p
                    won[:, codes.index(b)] += 1 - p
            top = won.argmax(axis=1)
            lang[rows] = np.array(codes, object)[top]
            if len(codes) > 1:
                score[rows] *= won[np.arange(len(rows)), top] / (len(codes) - 1)
        return lang.tolist(), score


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3.0 * margin, -30, 30)))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def fit(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> Model:
    """A model from docs (text, lang) with non-null lang and text.

    About rows_a_language rows of each language are used: those whose text hash
    is below a threshold set from the language's count. Their histograms, of
    fixed size each, are computed in tasks and collected.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND lang <> ''").select("text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # counts has a row a language. Ties in the draw beyond the bound are cut in hash order.
    drawn = rows.withColumn("draw", draw).join(F.broadcast(counts), "lang").where(F.col("draw") * F.col("n") < rows_a_language * 1.25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = histograms(part.column("text")).astype(np.float16)
                yield pa.record_batch({"lang": part.column("lang"), "draw": part.column("draw"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    found = drawn.select("lang", "draw", "text").mapInArrow(run, "lang string, draw double, x binary").dropDuplicates(["lang", "draw"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    got = found.withColumn("place", order).where(F.col("place") <= rows_a_language).orderBy("lang", "place").collect()
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIMENSIONS), np.float32)
    return Model(x, [r.lang for r in got])


def predict(docs: DataFrame, model: Model, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns carry of docs, lang_pred and score (0 to 1) of every row's whole text.

    Null texts and texts without a letter are `und` with score 0, as is
    everything under a model without languages. Repeated rows come back
    repeated; an empty table gives no rows. A very long text comes alone and
    whole; its features are counts, whatever its length. Other columns of docs,
    of any names, are not read.
    """
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col("text").alias("_text"))
    types = {f"c{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(carry)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "_text"):
                for at in range(0, chunk.num_rows, 256):
                    part = chunk.slice(at, 256)
                    langs, scores = model.predict(histograms(part.column("_text")))
                    has = [bool(t) and _LETTER.search(t) is not None for t in part.column("_text").to_pylist()]
                    langs = [a if ok else UNKNOWN for a, ok in zip(langs, has)]
                    made = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.where(has, scores, 0.0), pa.float64())}
                    yield pa.record_batch({c: part.column(c) for c in types} | made)

    out = source.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()) + ", lang_pred string, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language the model can tell, columns unchanged.

    Rejected: null texts, texts without a letter, and texts whose score is
    below least_score. Repeated rows stay or go together; an empty table gives
    no rows; columns may have any names; very long texts are judged whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                for at in range(0, chunk.num_rows, 256):
                    part = chunk.slice(at, 256)
                    _, scores = model.predict(histograms(part.column("text")))
                    has = [bool(t) and _LETTER.search(t) is not None for t in part.column("text").to_pylist()]
                    yield part.filter(pa.array(np.array(has, bool) & (scores >= least_score)))

    return docs.mapInArrow(run, docs.schema)
