"""SimHash, substring dedup and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvella.llm import components, simhash, substring


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint_matches_definition(messy):
    for _, text in messy:
        if text is None or len(text) < 10_000:
            assert simhash.simhash(text) == brute_simhash(text)
    assert simhash.simhash("A b C D e") == simhash.simhash("a B c d E")


def test_gray_index_links_all_near_pairs():
    rng = random.Random(4)
    for trial in range(30):
        base = [rng.getrandbits(64) for _ in range(4)]
        fps = set()
        for _ in range(rng.choice([3, 40, 300])):
            x = rng.choice(base)
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
        index = simhash.GrayIndex(np.array(sorted(fps), np.uint64))
        got = index.links(4, chunk=16)
        want = brute_components(index.fps.tolist())
        assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want], trial


def test_blocks_meet_every_pair():
    rng = random.Random(1)
    for n in (10, 10**9, 10**12):
        sets = simhash.blocks_of(4, n)
        for _ in range(200):
            flips = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(all((flips >> s) & ((1 << w) - 1) == 0 for s, w in parts) for parts in sets)


def test_large_buckets_are_dealt_again_and_lose_no_link(spark):
    rng = random.Random(9)
    alike = {rng.getrandbits(64) & ~0x1FFF | 0x0ABC for _ in range(300)}  # agree on one block, else unlike
    base = rng.getrandbits(64)
    near = {base ^ sum({1 << rng.randrange(64) for _ in range(3)}) for _ in range(200)}
    near |= {x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 5))}) for x in list(alike)[:60]}
    fps = sorted(alike | near)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    want = brute_components(fps)
    for most in (64, 1 << 16):
        dealt = simhash.buckets(table, 4, most)
        sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
        assert max(sizes) <= most
        if most == 64:
            assert dealt.count() > 5 * len(fps)
        got = {r.node: r.component for r in components.components(simhash.bucket_links(table, 4, most)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want
    assert simhash.buckets(table.limit(0), 4, 64).count() == 0


def test_further_blocks_meet_every_pair():
    rng = random.Random(3)
    for mask in (0, (1 << 13) - 1, rng.getrandbits(64), rng.getrandbits(64) | rng.getrandbits(64)):
        finer = simhash.further_blocks(mask, 4)
        assert len(finer) == 5 and all(f & mask == mask for f in finer)
        for _ in range(200):
            flips = sum({1 << rng.choice([i for i in range(64) if not mask >> i & 1]) for _ in range(4)})
            assert any(f & flips == 0 for f in finer)


def test_near_duplicates_against_brute_force(docs_of, messy):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = list(messy)
    for g in range(12):
        text = rng.choices(words, k=300)
        for k in range(rng.randint(1, 4)):
            copy = list(text)
            for _ in range(k):
                copy[rng.randrange(300)] = "changed"
            rows.append((100 + 10 * g + k, " ".join(copy)))
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fps = [brute_simhash(t) for _, t in rows]
    label = brute_components(fps)
    least = {}
    for (i, _), l in zip(rows, label):
        if i is not None:
            least[l] = min(least.get(l, i), i)
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least.get(l)) for (i, _), f, l in zip(rows, fps, label))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == want


def test_keep_one_keeps_a_document_of_each_group(docs_of):
    text = " ".join(f"t{i}" for i in range(100))
    docs = docs_of([(3, text), (1, text), (2, "other words here"), (None, None)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None}


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 101)], "a long, b long"))
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def brute_cut(rows, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_against_brute_force(docs_of, messy):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(50)]
    passage = rng.choices(words, k=60)
    rows = list(messy)
    for i in range(40):
        body = rng.choices(words, k=rng.randint(0, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            cut = rng.randint(0, 20)
            body[at:at] = passage[cut:]
        if i % 7 == 0:
            body += ["in"] * rng.randint(30, 90)
        rows.append((100 + i, "  ".join(body)))
    want = brute_cut(rows)
    for options in ({}, {"flush": 50}, {"bits": 4}):
        got = substring.repeat_digests(docs_of(rows), **options)
        assert Counter(tuple(r) for r in got.collect()) == want, options


def test_remove_repeats_keeps_untouched_texts(docs_of):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = docs_of([(1, f"before it {passage}"), (2, f"{passage} after  it"), (3, "left\nas it is"), (4, None)])
    got = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "before it", 2: "after it", 3: "left\nas it is", 4: None}
    assert got[1].n_chars == len("before it")
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_windows_of_a_hot_anchor_are_dealt_out(spark, docs_of, monkeypatch):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(16)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(40)] + passage + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(1500)]
    rows += [(5000, rows[0][1]), (5001, rows[7][1] + " more")]
    docs = docs_of(rows).select("text", F.xxhash64("doc_id", "text").alias("ref"), F.xxhash64("text", "doc_id").alias("ref2"))
    sizes = Counter()
    for r in substring.packed_windows(docs).select("segment", F.octet_length("hash").alias("n")).collect():
        sizes[r.segment] += r.n // 8
    assert sum(sizes.values()) > 5_000 and max(sizes.values()) < 0.4 * sum(sizes.values())
    assert Counter(tuple(r) for r in substring.repeat_digests(docs_of(rows)).collect()) == brute_cut(rows)


def test_segment_never_underestimates():
    rng = np.random.default_rng(2)
    anchors = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    counts = rng.integers(1, 5, 3000).astype(np.uint32)
    for bits in (4, 10, 16):
        segment = substring.Segment(bits, hot_from=5)
        for part in np.array_split(np.arange(3000), 7):
            segment.add(anchors[part], counts[part])
        assert (segment.estimate(anchors) >= counts).all()
    assert (segment.estimate(anchors) == counts).mean() > 0.95


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_words_that_sums_of_powers_confuse(docs_of):
    for size in (1024, 2048):
        same = " ".join(f"s{i}" for i in range(34))
        rows = [(1, f"{same} {thue_morse(size, 'a', 'b')}"), (2, f"{same} {thue_morse(size, 'b', 'a')}"), (3, " ".join(thue_morse(1024, "a", "b"))), (4, " ".join(thue_morse(1024, "b", "a")))]
        assert Counter(tuple(r) for r in substring.repeat_digests(docs_of(rows)).collect()) == brute_cut(rows)


def test_clashing_column_names(spark):
    names = ["emptied", "kept", "_text", "_ref", "_of", "_spans", "row", "made", "ref", "ref2", "of", "of2", "spans", "key", "key2", "node", "fp", "o", "block", "a.b"]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{x} {passage}", *[f"{n}{i}" for n in names]) for i, x in enumerate(["one", "two"])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted(tuple(r) for r in cut.collect()) == [(i, x, *r[2:]) for i, (x, r) in enumerate(zip(["one", "two"], rows))]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows)


def test_keep_one_does_not_mix_rows_of_an_id(docs_of):
    t, u, v = (" ".join(f"{c}{i}" for i in range(100)) for c in "tuv")
    docs = docs_of([(5, t), (8, t), (8, u), (9, v), (9, v), (None, t)]).repartition(3)
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(5, t), (8, u), (9, v)]


def test_near_duplicates_with_a_very_frequent_fingerprint(docs_of):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    hot = " ".join(rng.choices(words, k=200))
    rows = [(1000 + i, hot) for i in range(300)] + [(i, " ".join(rng.choices(words, k=200))) for i in range(200)] + [(7, hot)]
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs_of(rows).repartition(5)).collect())
    fps = [simhash.simhash(t) for _, t in rows]
    label = brute_components(fps)
    least = {}
    for (i, _), l in zip(rows, label):
        least[l] = min(least.get(l, i), i)
    assert got == Counter((i, least[l]) for (i, _), l in zip(rows, label))


def words_that_met(word, tries, fine):
    """Another 16-byte word with the hash that `word` has without a key: its last 8 bytes are solved for."""
    from corvella.llm.words import U, mix

    size = mix(np.array([16], U), 7)
    lane = lambda b: np.frombuffer(b, "<u8")
    goal = mix(size ^ lane(word[:8]), 1) ^ lane(word[8:])
    rng = np.random.default_rng(5)
    first = rng.choice(np.frombuffer(fine, np.uint8), (tries, 8)).astype(np.uint8)
    last = goal ^ mix(size ^ np.ascontiguousarray(first).view("<u8").ravel(), 1)
    good = np.isin(last.view(np.uint8).reshape(-1, 8), np.frombuffer(fine, np.uint8)).all(1)
    return [first[i].tobytes() + last[i].tobytes() for i in np.flatnonzero(good).tolist()]


def test_words_made_to_meet_are_told_apart(docs_of):
    import pyarrow as pa

    from corvella.llm.words import Words

    printable = bytes(range(33, 127))
    pairs = [(b"averyplainword16", b"Df9ulftbzK!V^+]w")] + [(b"averyplainword16", w) for w in words_that_met(b"averyplainword16", 40_000, printable)[:6]]
    assert len(pairs) > 3
    both = Words(pa.array([" ".join(w.decode() for w in p) for p in pairs])).hash.reshape(-1, 2)
    assert (both[:, 0] == both[:, 1]).all()  # they do meet without a key
    for k, pair in enumerate(pairs):
        head = " ".join(f"same{k}x{i}" for i in range(34))
        rows = [(i, f"{head} {w.decode()}") for i, w in enumerate(pair)] + [(9, f"{head} and others"), (10, f"{head} and others")]
        assert Counter(tuple(r) for r in substring.repeat_digests(docs_of(rows)).collect()) == brute_cut(rows)
        if k == 0:
            left = {r.doc_id: r.text for r in substring.remove_repeats(docs_of(rows[:2])).collect()}
            assert left == {i: t for i, t in rows[:2]}


def test_leaks_are_decided_by_words(docs_of, spark):
    from corvella.llm import decontaminate

    fine = b"abcdefghijklmnopqrstuvwxyz0123456789"
    twins = words_that_met(b"averyplainword16", 30_000_000, fine)
    assert twins
    head = [f"w{i}" for i in range(8)]
    item = " ".join([*head, "averyplainword16", "averyplainword16"])
    other = " ".join([*head[:6], "x1", "x2", twins[0].decode(), twins[0].decode()])  # four edits by words, two by hashes that anyone can make
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, other), (2, item), (3, item.replace("w2", "y"))]
    assert [(r.doc_id, r.distance) for r in decontaminate.find_leaks(docs_of(rows), benchmark).orderBy("doc_id").collect()] == [(2, 0), (3, 1)]
    assert {r.doc_id for r in decontaminate.keep_clean(docs_of(rows), benchmark).collect()} == {1}
