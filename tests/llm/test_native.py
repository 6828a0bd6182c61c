"""URL filter and sharding."""

import random
import re
import zlib
from collections import Counter

import xxhash

from corvella.llm import shards, urls
from corvella.llm.queries import URL_RULES


def brute_url(url, rules, default="allow"):
    m = re.search("://", url or "")
    host, path = "", ""
    if m:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url[m.end() :]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["org", "com", "example", "a", "b", "www", ""]
    urls_ = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG", "http://example.org?q=/es/", "x://y://example.org/es/", "http://example.org/es/#a", "http://badexample.org/es/1", "http://w.Example.ORG/en/1\n2", "a\n://com/fr/"]
    for _ in range(400):
        host = ".".join(rng.choices(labels, k=rng.randint(1, 5)))
        urls_.append(f"http{rng.choice(['', 's'])}://{host}{rng.choice(['', '/', '/es/', '/en/12', '/fr/x', '/de/?q', '#f'])}")
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls_)] + [(0, urls_[0], "h", 1)], "page_id long, url string, host string, key long")
    many = [(v, ".".join(rng.choices(labels[:6], k=rng.randint(1, 4))), rng.choice(["", "es/", "en/1", "f"])) for v in ("allow", "block") for _ in range(15)]
    for rules in (URL_RULES, list({(h, p): (v, h, p) for v, h, p in many}.values()), []):
        table = [(h, f"/{p}", v) for v, h, p in rules]
        got = urls.judge_urls(pages, urls.rule_table(spark, rules))
        assert Counter(tuple(r) for r in got.collect()) == Counter((i, *brute_url(u, table)) for i, u in [*enumerate(urls_), (0, None)])
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0


def brute_place(x, n, seed):
    a, b = shards.grid(n)

    def signed(v):
        return v - (1 << 64) if v >> 63 else v

    def h(value, key):
        first = xxhash.xxh64_intdigest((value % (1 << 64)).to_bytes(8, "little"), 42)
        return signed(xxhash.xxh64_intdigest(key.to_bytes(8, "little"), first))

    while True:
        left, right = divmod(x, b)
        for r in range(shards.ROUNDS):
            if r % 2 == 0:
                left = (left + h(right, seed * 64 + r) % a) % a
            else:
                right = (right + h(left, seed * 64 + r) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 97, 1009):
        got = [r[0] for r in spark.range(n).orderBy("id").select(shards.shuffled_place(F.col("id"), n, 20)).collect()]
        assert sorted(got) == list(range(n))
        assert got == [brute_place(i, n, 20) for i in range(n)]
    for n in (10**9 + 7, 10**11 + 3):
        a, b = shards.grid(n)
        assert 0 <= a * b - n <= 64


def test_shards(docs_of, messy):
    rows = messy + [(1000 + i, f"text {i}") for i in range(500)]
    docs = docs_of(rows)
    got = shards.assign_shards(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
        assert r.slot * 8 + r.shard == brute_place(r.row_number, len(rows), 20)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    again = shards.assign_shards(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert shards.assign_shards(docs.limit(0)).count() == 0


def test_written_shards(docs_of, spark, tmp_path):
    docs = docs_of([(i, f"text {i}") for i in range(100)] + [(5, "text 5")])
    shards.write_shards(docs, str(tmp_path / "out"), slots_per_file=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
