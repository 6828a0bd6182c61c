"""Language ID and toxicity scores recomputed in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvella.llm import langid, toxicity

MASK = (1 << 64) - 1


def slow_histogram(text):
    data = [b if chr(b).isalpha() or b > 127 else 32 for b in (text or "").lower().encode()]
    codes = [b for i, b in enumerate(data) if b != 32 or i == 0 or data[i - 1] != 32]
    counts = Counter()
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[((a << 16 | b << 8 | c) * 0x9E3779B97F4A7C15 & MASK) >> 52] += 1
    norm = math.sqrt(sum(counts.values()))
    return {slot: math.sqrt(n) / norm for slot, n in counts.items()}


def slow_prediction(model, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = slow_histogram(text)
    margin = lambda w: sum(w[i] * v for i, v in x.items()) + w[-1]
    chance = lambda m: 1 / (1 + math.exp(-3 * m))
    family = max(range(len(model.names)), key=lambda f: margin(model.family[f]))
    score = chance(margin(model.family[family])) if len(model.names) > 1 else 1.0
    codes = model.members[model.names[family]]
    won = dict.fromkeys(codes, 0.0)
    for (a, b), w in model.pairs.items():
        if a in won:
            p = chance(margin(w))
            won[a] += p
            won[b] += 1 - p
    best = max(codes, key=won.get)
    return best, score * (won[best] / (len(codes) - 1) if len(codes) > 1 else 1)


def test_histograms_against_slow_version():
    texts = ["", "a", "ab", "abc", "  The  cat--sat. ", "été, où?", "日本語です", "x\n\ny z" * 9, None, "12 34"]
    got = langid.histograms(pa.array(texts, pa.string()))
    for row, text in zip(got, texts):
        want = np.zeros(langid.DIMENSIONS)
        for slot, v in slow_histogram(text).items():
            want[slot] = v
        assert np.allclose(row, want, atol=1e-6), text


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.3, 1, -1)
    w = langid.linear_svm(x, y, cost=1.0, epochs=400)
    full = np.hstack([x, np.ones((60, 1))])
    share = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    slope = w - 2 * ((share * np.maximum(0, 1 - y * (full @ w)) * y)[:, None] * full).sum(axis=0)
    assert np.abs(slope).max() < 1e-3 * np.abs(w).max()


def test_languages_against_slow_version(spark, sf_dir, docs_of, messy):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(langid.id_remainder(F.col("doc_id"), 4) != 2))
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 4000] + [(i, t) for i, t in messy if len(t or "") < 4000]
    got = langid.predict(docs_of(rows).drop("lang"), model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) > 150
    for r in got:
        lang, score = slow_prediction(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r.doc_id
    assert len({r.lang_pred for r in got}) >= 5


def mix(x, salt=0):
    x = (x + 0x9E3779B97F4A7C15 * (salt + 1)) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def slow_features(text):
    found = set()
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode()):
        h = mix(mix(len(word), 7) ^ int.from_bytes(word[:8], "little"), 1)
        for at in range(8, len(word), 8):
            h = mix(h ^ int.from_bytes(word[at : at + 8], "little"), 1)
        found.add(h)
        found |= {mix(int.from_bytes(word[:size], "little"), 100 + size) for size in toxicity.PREFIXES if len(word) > size}
    return found


def test_toxicity_scores_against_slow_version(spark, sf_dir, docs_of, messy):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    sample, prior = toxicity.sample_labels(docs, labels)
    model = toxicity.fit(sample, prior=prior)
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist()))
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 4000] + [(1000 + k, t) for k, (_, t) in enumerate(messy) if len(t or "") < 4000]
    texts = dict(rows)
    got = toxicity.score(docs_of(rows), model).collect()
    assert len(got) == len(rows) > 150
    for r in got:
        total = sum(weight.get(f, 0.0) for f in slow_features(texts[r.doc_id])) + model.bias
        score = 1 / (1 + math.exp(-max(-30, min(30, total))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.5), r.doc_id
    assert len({round(r.score, 6) for r in got}) > 50
