"""Fingerprints, BPE, chat formatting, decontamination, language ID, toxicity."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvella.llm import bpe, chat, decontaminate, fingerprints, langid, queries, toxicity
from corvella.llm.words import NOT_ALNUM, Words, rolling


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_match_regex(texts):
    w = Words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[w.start[j] : w.end[j]]).decode() for j in range(w.at[i], w.at[i + 1])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    flat = [x for words in got for x in words]
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_rolling_hash_depends_on_content_only():
    w = Words(pa.array(["a b c d", "x a b c"]), NOT_ALNUM)
    r = rolling(w.hash, 3)
    assert r[0] == r[5] and len(set(r.tolist())) == 5


# fingerprints


def test_fingerprints_against_naive(docs_of, messy):
    rows = [(i, t) for i, t in messy if i is not None] + [(100 + i, f"the quick fox number {i} and the lazy dog of house {i} ran to the hill") for i in range(60)]
    got = fingerprints.fingerprint_with_edits(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    order = sorted({i for i, _ in rows if i not in (7, 8)})
    text = {i: t or "" for i, t in rows}
    for a, b in zip(order, order[1:]):
        if {a, b} <= {1, 2, 3, 4, 5} or a >= 100:
            half = len(text[a]) // 2
            edited = text[a][: len(text[a]) - half] + text[b][:half]
            assert by[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            sets = [set(re.findall(".{8}", by[x].fingerprint)) for x in (a, b)]
            other = set(re.findall(".{8}", by[a].edited_fingerprint))
            want = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in (other, sets[1])]
            assert [by[a].near_edited, by[a].near_next] == pytest.approx(want)
    half = len(text[order[-1]]) // 2
    assert by[order[-1]].edited_sha256 == hashlib.sha256((text[order[-1]][: len(text[order[-1]]) - half] + text[order[0]][:half]).encode()).hexdigest()
    assert by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0
    assert by[2].fingerprint == "" and by[1].n_chars == 0
    assert fingerprints.fingerprint_with_edits(docs_of(rows).limit(0)).count() == 0


def test_every_text_with_words_has_a_signature():
    sets = fingerprints.signature_sets(["x", "the", "the of and", "", "one two"])
    assert [len(s) > 0 for s in sets] == [True, True, True, False, True]
    assert fingerprints.likeness(sets[0], sets[1]) == 0.0
    assert fingerprints.likeness(np.arange(10), np.arange(100), at_least=0.5) == 0.0


def naive_signatures(text):
    """Chains of two content words after each common word and at the start; word pairs where common words are rare."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
    common = [w in fingerprints.ANCHORS for w in words]
    bare = all(common)
    content = [i for i, c in enumerate(common) if bare or not c]
    spots = [(words[i], i + 1) for i, c in enumerate(common) if c] + ([("", 0)] if words else [])
    chains = {(w, *[words[i] for i in content if i >= at][: fingerprints.CHAIN]) for w, at in spots}
    found = {c for c in chains if len(c) > 1}
    if sum(common) * fingerprints.SPARSE < len(words):
        found |= {("pair", a, b) for a, b in zip(words, words[1:])}
    return found


def test_signatures_against_naive():
    rng = random.Random(8)
    texts = ["", "the of and", "x", "one two three", " ".join(f"w{i}" for i in range(50)), "the a the b the c d", "w " * 30]
    texts += [" ".join(rng.choices(["the", "of", "und", "alpha", "beta", "gamma", "delta", "rho"], k=rng.randint(1, 60))) for _ in range(60)]
    got = fingerprints.signature_sets(texts)
    want = [naive_signatures(t) for t in texts]
    assert [len(s) for s in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            both = len(want[i] & want[j])
            assert len(np.intersect1d(got[i], got[j])) == both


def test_near_duplicates_against_brute_force(docs_of, messy, monkeypatch):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(300)] + ["the", "of", "and"] * 40
    rows = list(messy)
    for g in range(25):
        text = rng.choices(vocab, k=rng.randint(20, 200))
        for k in range(rng.randint(1, 6)):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + 10 * g + k, " ".join(copy)))
    sets = fingerprints.signature_sets([t or "" for _, t in rows])
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and fingerprints.likeness(sets[i], sets[j]) >= 0.8 - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (i, _), l in zip(rows, label):
        if i is not None:
            least[l] = min(least.get(l, i), i)
    want = Counter((i, least.get(l)) for (i, _), l in zip(rows, label))
    assert len(set(label)) < len(rows) - 20
    for tile in (2000, 2):
        monkeypatch.setattr(fingerprints, "TILE", tile)
        assert Counter(tuple(r) for r in fingerprints.near_duplicates(docs_of(rows)).collect()) == want
    assert fingerprints.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_length_partitions_adjoin():
    bounds = np.array(fingerprints.length_bounds(1, 5000, 0.8))
    for a in range(1, 4000):
        b = int(a / 0.8)
        assert np.searchsorted(bounds, b, "right") - np.searchsorted(bounds, a, "right") <= 1


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    return path, Tokenizer.from_file(path)


def test_bpe_matches_library(library, spark, sf_dir, docs_of, messy):
    path, tokenizer = library
    docs = docs_of(messy).select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_and_decode(docs, path).collect()) == want
    assert bpe.encode(docs.limit(0), path).count() == 0


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aestinr'<|>\x1c\x85 \u3000ΣİΑ\u0301")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_matches_library_on_any_text(text):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    if not hasattr(test_bpe_matches_library_on_any_text, "t"):
        test_bpe_matches_library_on_any_text.t = Tokenizer.from_file(path), bpe.load(open(path).read())
    tokenizer, mine = test_bpe_matches_library_on_any_text.t
    for t in (text, f"{text}<|endoftext|>{text}"):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert mine.encode([t])[0] == ids
        assert mine.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_of_every_code_point(library):
    path, tokenizer = library
    mine = bpe.load(open(path).read())
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert mine.encode(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bpe_long_words(library):
    path, tokenizer = library
    mine = bpe.load(open(path).read())
    words = ["a" * 5000, "theing" * 900, "!" * 3000, "é" * 700]
    assert mine.encode(words) == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_bpe_case_variants_of_special_tokens(library):
    path, tokenizer = library
    mine = bpe.load(open(path).read())
    texts = ["a <|EndOfText|> b", "<|ENDOFTEXT|>", "<|endoftext|> <|Endoftext|>", "<|StartOfText|>x <|startoftext|>"]
    assert mine.encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# chat


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"),
        (1, 5, "message", 3, "user", "more"), (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, "assistant", "good "), (1, 8, "delta", 2, None, "day"),
        (1, 9, "edit", 1, None, "hey"), (2, 1, "delta", 1, "user", "no opening"), (None, 1, "message", 1, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(df).collect()}
    assert got == {(1, 1): ("user", "hey"), (1, 2): ("assistant", "good day"), (2, 1): ("user", "no opening"), (None, 1): ("", "")}


def fold(events):
    """events of one conversation in order -> {message: [role, text]}"""
    said = {}
    for kind, message, role, text in events:
        if kind == "regenerate":
            said = {m: v for m, v in said.items() if m < message}
        if kind in ("regenerate", "message", "edit"):
            said.setdefault(message, [None, ""])[1] = text or ""
        else:
            said.setdefault(message, [None, ""])[1] += text or ""
        said[message][0] = said[message][0] or role
    return {m: (role or "", text) for m, (role, text) in said.items()}


def test_fold_against_loop(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(40), None]:
        for seq in range(rng.randint(1, 60)):
            rows.append((conv, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randint(1, 6), rng.choice([None, "user", "assistant"]), rng.choice([None, f"t{seq} "])))
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string").repartition(5)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(df).collect()}
    want = {(c, m): v for c in {r[0] for r in rows} for m, v in fold([r[2:] for r in rows if r[0] == c]).items()}
    assert got == want


def test_log_needs_the_fold(spark, sf_dir):
    log = chat.conversation_log(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 20
    events = [r for r in log.collect()]
    for conv in sorted({r.conv_id for r in events})[:20]:
        mine = sorted((r for r in events if r.conv_id == conv), key=lambda r: tuple(r.seq))
        assert {tuple(m): v for m, v in fold([(r.kind, tuple(r.message), r.role, r.text) for r in mine]).items()} == {tuple(r.message): (r.role, r.text) for r in chat.reconstruct(log.where(F.col("conv_id") == conv)).collect()}


def test_format_reads_back(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "#", "##\n### x:\n</turn>\n", "\\", "</turn\\>", "\U0001f600" * 3, "a" * 50_000]
    rows = [(c, t, role, text, "x") for c in (1, 2) for t, text in enumerate(texts) for role in ("user", "assistant")] + [(3, None, "odd: #\n</turn> \\", "t", "x"), (3, 5, None, "u", "x"), (None, 1, "assistant", "n", "x"), (4, 1, "user", "twice", "x"), (4, 1, "user", "twice", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = "".join(r.turn_text for r in chat.format_conversations(df).where("conv_id = 1").orderBy("message").collect())
    assert len(whole) == got[1].formatted_chars and whole.count("### ") == 2 * len(texts) == whole.count("</turn>")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# decontamination


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t)))
    return min(row)


def plain(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())


def test_leaks_against_brute_force(spark, docs_of, messy):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(150)] + ["the", "of", "in"] * 10
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 50)))) for i in range(40)] + [(90, None), (91, "!!"), (3, "same id again and more words")]
    rows = list(messy)
    for i in range(120):
        body = rng.choices(vocab, k=rng.randint(0, 80))
        item = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, max(1, len(item) // 4))):
            j = rng.randrange(len(item))
            rng.choice([lambda: item.__setitem__(j, "zz"), lambda: item.pop(j) if len(item) > 1 else None, lambda: item.insert(j, "yy")])()
        at = rng.randint(0, len(body))
        rows.append((100 + i, ", ".join(body[:at] + [x.upper() for x in item] + body[at:])))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.find_leaks(docs_of(rows), bench).collect()
    want = set()
    for d, t in rows:
        words = plain(t or "")
        for i, q in items:
            q = plain(q or "")
            if q and brute_distance(q, words) <= int(0.2 * len(q) + 1e-9):
                want.add((d, i, len(q)))
    got = {(r.doc_id, r.item_id, r.item_words) for r in found}
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    text = dict(rows)
    for r in found:
        if text[r.doc_id] is not None and r.doc_id not in (7, 8, None):
            stretch = plain(text[r.doc_id])[r.start : r.start + r.length]
            q = next(plain(q) for i, q in items if i == r.item_id and q and len(plain(q)) == r.item_words)
            assert brute_distance(q, stretch) == r.distance
    blocks = decontaminate.find_leaks(docs_of(rows), bench, block_bytes=500)
    assert {(r.doc_id, r.item_id, r.item_words) for r in blocks.collect()} == got
    clean = decontaminate.keep_clean(docs_of(rows), bench)
    dirty = {d for d, _, _ in got}
    assert {r.doc_id for r in clean.where("doc_id >= 100").collect()} == {d for d, _ in rows if d and d >= 100} - dirty
    assert decontaminate.find_leaks(docs_of(rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 15, 30, 59, 100, 200])
@pytest.mark.parametrize("kinds", ["s", "i", "d", "sid"])
def test_recall_does_not_fall_with_length(n, kinds):
    rng = random.Random(n)

    def leaked(item):
        at, out = set(rng.sample(range(n), n // 5)), []
        for i, w in enumerate(item):
            kind = rng.choice(kinds) if i in at else ""
            out += {"": [w], "s": [f"z{rng.random():.9f}"[3:]], "i": [f"z{rng.random():.9f}"[3:], w], "d": []}[kind]
        return out

    items = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for _ in range(200)]
    texts = [" ".join([*(f"x{rng.randrange(10**6)}" for _ in range(30)), *leaked(i), *(f"x{rng.randrange(10**6)}" for _ in range(30))]) for i in items]
    found = decontaminate.Items(list(range(200)), [" ".join(i) for i in items]).leaks(pa.array(texts))
    assert len({x.row for x in found if x.row == x.item}) >= 0.98 * 200


# classifiers


def test_language_id_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op6_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.99 and 0 <= r[1] <= r[2] <= 1


def test_language_id_edges(spark, docs_of, messy):
    rows = [(i, f"{w} {w} text number {i}", lang) for i in range(30) for w, lang in (("the cat sat", "en"), ("die katze", "de"), ("le chat du", "fr"), ("日本語の文", "ja"))]
    model = langid.fit(spark.createDataFrame([*rows, (99, None, "en"), (98, "no lang", None)], "doc_id long, text string, lang string"))
    assert set(model.members) == {"germanic", "romance", "ja"}
    got = langid.predict(docs_of(messy + [(10, "123 !?"), (11, "the cat sat there")]), model).collect()
    assert len(got) == len(messy) + 2
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == by[10] == "und" and by[11] == "en"
    docs = docs_of(messy)
    assert langid.keep_known(docs, model, 0.0).count() == sum(1 for _, t in messy if t and re.search(r"[^\W\d_]", t))
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    got = queries.op8_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.expr("count_if(predicted = 1 AND toxic = 1)"), F.expr("count_if(predicted = 1)"), F.expr("count_if(toxic = 1)")).first()
    assert r[0] / r[1] >= 0.95 and r[0] / r[2] >= 0.8


def test_label_sample_is_bounded(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(200)] + [(None, "no id"), (3, "second text of an id")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)] + [(None, 1, 1), (0, 1, 1), (7, None, None), (900, 1, 1)], "doc_id long, quality int, toxic int")
    sample, share = toxicity.sample_labels(docs, labels, rows_a_label=20)
    counts = Counter(r.toxic for r in sample.collect())
    assert counts[0] in (20, 21) and 19 <= counts[1] <= 20
    assert 0.25 < share < 0.27


def test_counterfactual_penalty_shrinks_score_changes(spark):
    """Held-out rows of made labels in which some groups are named more often in toxic texts."""
    rng = random.Random(3)
    neutral = {"en": "the and of to is", "de": "der die und ist nicht", "fr": "le les et des est", "es": "el los y que es"}

    def text(lang, toxic):
        group = rng.choice(toxicity.IDENTITY_GROUPS[lang])
        term = group[0] if rng.random() < (0.8 if toxic else 0.3) else rng.choice(group)
        words = rng.choices(neutral[lang].split(), k=8) + [term] + ["idiot"] * (toxic and rng.random() < 0.6) + [f"w{rng.randrange(40)}" for _ in range(5)]
        rng.shuffle(words)
        return " ".join(words)

    rows = [(text(lang, toxic), toxic) for lang in neutral for toxic in (0, 1) for _ in range(200)]
    held = [text(lang, 0) for lang in neutral for _ in range(100)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")

    def changes(model):
        return [float(np.abs(model.scores(pa.array(t)) - model.scores(pa.array([toxicity.swapped(x) for x in t]))).mean()) for t in np.array_split(held, 4)]

    plain, fair = (changes(toxicity.fit(labelled, fairness=f)) for f in (0.0, toxicity.FAIRNESS))
    assert all(f < 0.5 * p for p, f in zip(plain, fair)), (plain, fair)
    model = toxicity.fit(labelled)
    assert model.scores(pa.array(["the idiot is w1"]))[0] > 0.5 > model.scores(pa.array(["the christians and the woman of w1"]))[0]


def test_every_text_has_a_counterfactual(spark, sf_dir):
    assert toxicity.swapped("A Muslim man, not Christianity") == "a jewish woman, not christianity"
    assert toxicity.counterfactuals("A Muslim man", 0) == ("a muslim man", "a jewish woman")
    for text in ("", "der hund und die katze", "el gato y los que"):
        for draw in (0, 1, 17, 123456):
            a, b = toxicity.counterfactuals(text, draw)
            assert a != b and a.split(" ", 1)[1:] == b.split(" ", 1)[1:]
    assert toxicity.counterfactuals("der hund und die katze", 0)[0] == "christen der hund und die katze"


def test_gradient_of_the_penalty():
    rng = np.random.default_rng(1)
    x = (rng.random((6, 5)) < 0.5).astype(np.float64)
    rows = np.arange(6)
    versions = [[np.flatnonzero(rng.random(5) < 0.5) for _ in rows] for _ in range(2)]
    pairs = toxicity.Pairs(rows, [[toxicity.version(np.flatnonzero(o), v) for o, v in zip(x, side)] for side in versions])
    w = rng.random(6)
    for side in (0, 1):
        dense = np.zeros((6, 6))
        dense[:, 5] = 1
        for i, v in enumerate(versions[side]):
            dense[i, v] = 1
        assert np.allclose(pairs.logits(x, w, side), dense @ w)
        assert np.allclose(pairs.pull(x, w[:6], side), dense.T @ w[:6])


def test_toxicity_edges(spark, docs_of, messy):
    rows = [(f"you are an idiot number {i}", 1) for i in range(20)] + [(f"a fine day number {i}", 0) for i in range(40)] + [(None, 1), ("x", None), ("y", 7)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs_of(messy + [(50, "what an idiot"), (51, "what a fine day")]), model).collect()}
    assert got[50].score > got[51].score and got[1].score == got[2].score
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    one = toxicity.fit(spark.createDataFrame([("x", 0)], "text string, toxic int"))
    assert {r.predicted for r in toxicity.score(docs_of(messy), one).collect()} == {0}


def test_rows_of_one_id_spread_over_blocks(spark, docs_of):
    rng = random.Random(12)
    rows = [(None, f"text {rng.random()} and more") for _ in range(150)] + [(5, f"other {rng.random()} words") for _ in range(150)] + [(i, f"the {i} one") for i in range(100, 200)]
    blocks = fingerprints.in_blocks(docs_of(rows).repartition(5), 8).where("NOT late")
    sizes = {r.block: r["count"] for r in blocks.groupBy("block").count().collect()}
    assert sum(sizes.values()) == 400 and max(sizes.values()) < 120 and len(sizes) >= 6
    order = docs_of(rows).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), F.xxhash64("text").alias("tie"), "text").orderBy("rank", "tie").collect()
    got = {r.edited_sha256 for r in fingerprints.fingerprint_with_edits(docs_of(rows)).collect()}
    texts = [r.text for r in order]
    assert got == {hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest() for a, b in zip(texts, texts[1:] + texts[:1])}
