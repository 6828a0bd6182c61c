"""Quality rules, periodic runs and ranked search against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvella.llm import periodic, quality, search
from corvella.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures_of(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def test_measures(spark, docs_of, messy):
    rng = random.Random(2)
    rows = messy + [(100 + i, "".join(rng.choice(["a ", "b ", "cc\n", "\t", "&x ", "é "]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    got = quality.measured(docs_of(rows), ["doc_id"]).collect()
    want = Counter((i, *measures_of(t)) for i, t in rows)
    assert Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in got) == want


def brute_bounds(values, measure):
    def bucket(v):
        return v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6)

    b = sorted(map(bucket, values))
    q1, q3 = b[-(-len(b) // 4) - 1], b[-(-3 * len(b) // 4) - 1]
    reach = 3 * max(q3 - q1, quality.LEAST_SPREAD[measure])
    return q1 - reach, q3 + reach


def test_verdicts_against_loop(spark):
    rng = random.Random(7)
    made = []
    for i in range(260):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])
        odd = rng.random() < 0.15
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4) if lang == "en" else rng.randint(5, 9))) + ("&%" if odd else "") for _ in range(rng.randint(5, 60))]
        lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        made.append((i % 230, "\n".join(lines + lines[:1] * rng.choice([0, 0, 0, 6])), lang, source))
    made += [(900, None, "en", "a"), (901, "", "en", "a"), (902, " ", None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    least = 20
    groups = defaultdict(list)
    rows = []
    for doc_id, text, lang, source in made:
        n, chars, symbols, lines, dup, repeat = measures_of(text)
        v = {"word_length": 1000 * chars // n if n else None, "symbols": 1000 * symbols // n if n else None, "dup_lines": 1000 * dup // lines if lines else None}
        rows.append((doc_id, n, repeat, lang, source, v))
        for m, x in v.items():
            if x is not None:
                for key in ((m, lang, source), (m, lang), (m,)):
                    groups[key].append(x)
    want = Counter()
    for doc_id, n, repeat, lang, source, v in rows:
        failed = n < 10 or 100 * repeat > 20 * n
        kept = not failed
        for m, x in v.items():
            if kept:
                key = next(k for k in ((m, lang, source), (m, lang), (m,)) if len(groups[k]) >= least or len(k) == 1)
                low, high = brute_bounds(groups[key], m)
                kept = low <= x <= high
        want[doc_id, failed, kept] += 1
    got = quality.judge(docs, least=least)
    assert Counter((r.doc_id, r.base_failed, r.kept) for r in got.collect()) == want
    assert 20 < sum(n for (_, failed, kept), n in want.items() if kept) and 10 < sum(n for (_, failed, kept), n in want.items() if not failed and not kept)
    assert quality.keep_good(docs, least).count() == sum(n for (_, _, kept), n in want.items() if kept)
    assert quality.keep_good(docs, least).columns == docs.columns


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"), (F.col("id") % 7).cast("string").alias("source"), (F.col("id") * 37 % 911).alias("v"))
    whole = quality.sketches(rows, [], {"m": F.col("v")})
    parts = quality.merged(quality.merged(quality.sketches(rows, ["lang", "source"], {"m": F.col("v")}), ["lang"]), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    q = quality.quartiles(whole, []).first()
    values = sorted(i * 37 % 911 for i in range(4000))
    assert q.held == 4000 and all(t * 31 / 32 <= got <= t for got, t in ((q.q1, values[999]), (q.q3, values[2999])))


def test_quality_on_messy_rows(spark, docs_of, messy):
    got = quality.judge(docs_of(messy))
    assert got.count() == len(messy)
    assert {(r.doc_id, r.kept) for r in got.where("doc_id in (1, 2, 3)").collect()} == {(1, False), (2, False), (3, False)}
    assert quality.judge(docs_of([])).count() == 0
    assert quality.judge(docs_of(messy), ["doc_id", "size", "rank"]).columns[:3] == ["doc_id", "size", "rank"]


def test_labelled_quality(spark):
    judged = QUERIES["op11_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    counts = {(r.quality, r.kept): r["count"] for r in judged.where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True] and counts.get((0, True), 0) <= 0.05 * counts[0, False]


def brute_runs(w, least=12):
    """Every maximal stretch with each period, of which its smallest counts."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + size - d)) for d in range(1, q)):
                out.add((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("few", [0, 3, 48, 10**9])
def test_runs_against_brute_force(monkeypatch, few):
    monkeypatch.setattr(periodic, "FEW", few)
    rng = random.Random(few)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 6])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 2 + 1)
                w = w[:a] + [w[min(n - 1, a + (i - a) % p)] for i in range(a, n)]
            texts.append(w)
        a, b = [0], [0, 1]
        for _ in range(7):  # Fibonacci words hold as many runs as words can
            a, b = b, b + a
        texts.append(b)
        least = rng.choice([2, 12])
        assert [[tuple(r) for r in x.tolist()] for x in periodic.runs(texts, least)] == [brute_runs(w, least) for w in texts]


def brute_digest(doc_id, text, tails=True):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if tails and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    told = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_op12_against_brute_force(spark, docs_of, messy):
    got = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    short = {i: t for i, t in docs if len(t.split()) < 900}
    assert len(short) > 150 and len(got) == len(docs)
    assert sorted(tuple(r) for r in got if r.doc_id in short) == sorted((brute_digest(i, t) for i, t in short.items()))
    assert sum(r.n_runs > 0 for r in got) > 10
    rows = [r for r in messy if len(r[1] or "") < 5000] + [(20, "x " * 300), (21, "a b " * 7 + "a"), (22, "\n".join(["one line of words"] * 4))]
    assert Counter(map(tuple, periodic.run_digests(docs_of(rows)).collect())) == Counter(brute_digest(i, t, False) for i, t in rows)
    assert periodic.run_digests(docs_of(messy), True, at_once=100).count() == len(messy)
    assert periodic.run_digests(docs_of([])).count() == 0


def test_collapse_runs(spark, docs_of):
    docs = docs_of([(1, "keep  this\tas it is"), (2, "start " + "a b c " * 5 + "end"), (3, None), (3, None)])
    got = Counter((r.doc_id, r.text) for r in periodic.collapse_runs(docs).collect())
    assert got == Counter({(1, "keep  this\tas it is"): 1, (2, "start a b c end"): 1, (3, None): 2})
    assert periodic.collapse_runs(docs).columns == docs.columns


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in held:
            size = sum(c.values())
            m = 10 + (90 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(heapq.nsmallest(k, found, key=lambda x: x[:3]), 1)]
    return Counter(out)


@pytest.mark.parametrize("shard_bytes,block", [(1 << 24, 512), (300, 2)])
def test_search_against_brute_force(spark, docs_of, messy, shard_bytes, block):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "straße", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 12, 43])]) for _ in range(n))
    docs = messy + [(rng.randint(0, 400), text(rng.randint(0, 60))) for _ in range(300)] + [(500, "w1 w2 w3")] * 15
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(3, "W39 w39;w38"), (50, None), (51, ""), (52, "unheard-of"), (None, "w7 w8 \x7fw9"), (53, "the text again")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = search.build_index(docs_of(docs), shard_bytes)
    got = search.search(index.cache(), asked, queries_a_block=block)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)
    assert search.search_documents(docs_of([]), asked).count() == 0
    assert search.search(index, asked.limit(0)).count() == 0


def test_best_documents_prunes_without_loss():
    rng = random.Random(3)
    for _ in range(400):
        lists = []
        for _ in range(rng.randint(0, 6)):
            at = sorted(rng.sample(range(80), rng.randint(0, 60)))
            top = rng.choice([0, 1, 3, 50])
            lists.append((at, [rng.randint(0, top) for _ in at]))
        sums = Counter()
        for at, scores in lists:
            for d, s in zip(at, scores):
                sums[d] += s
        k = rng.randint(1, 12)
        assert search.best_documents(lists, k) == [(s, d) for d, s in sorted(((d, s) for d, s in sums.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]]


def test_postings_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for most in (5, 300, 70_000, 10**10):
        at = np.unique(rng.integers(0, most, 50))
        times = rng.integers(1, most, len(at))
        a, t = search.unpacked(search.packed(at, times), len(at))
        assert (a == at).all() and (t == times).all()
