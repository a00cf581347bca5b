import random
import zlib
from collections import Counter, defaultdict

import pytest

from attestor.llm import sharding as S

D = "/root/testdata/sf0.01"


def spread(masses, parts, k):
    sums = [0] * k
    for m, p in zip(masses, parts):
        sums[p] += m
    return max(sums) - min(sums)


def test_known_case():
    # Two-way differencing of 8 7 6 5 4 leaves 2, as in the literature.
    assert spread([8, 7, 6, 5, 4], S.differencing([8, 7, 6, 5, 4], 2), 2) == 2


@pytest.mark.parametrize("k", [1, 2, 3, 8])
def test_tighter_than_greedy(k):
    rng = random.Random(k)
    masses = [int(rng.paretovariate(1.2) * 1000) for _ in range(800)]
    sums = [0] * k
    for m in sorted(masses, reverse=True):
        sums[sums.index(min(sums))] += m
    assert spread(masses, S.differencing(masses, k), k) <= max(sums) - min(sums)


def test_bundles():
    for m, c in ((5, 1), (5, 1000), (10**6, 3), (1, 10**7)):
        assert sum(S.bundles(m, c, 10**5)) == c
    assert len(S.bundles(1, 10**9, 10**8)) < 64


def check(rows, docs, k=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs
    )
    by, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < k
        by[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in by.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    rows = S.op1_sharding(spark, D).collect()
    check(rows, docs)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 64


def test_edge_cases(spark, monkeypatch):
    schema = "doc_id long, text string, size string, shard int, key int"
    docs = [(1, None), (2, ""), (3, "a" * 5000), (4, "a" * 5000), (4, "a" * 5000), (None, "b"), *((i, f"t{i}") for i in range(100, 300))]
    df = spark.createDataFrame([(*d, "s", 1, 1) for d in docs], schema)
    check(S.shard_documents(df).collect(), docs)
    assert S.shard_documents(df.limit(0)).count() == 0
    monkeypatch.setattr(S, "slot_buckets", lambda n: 7)
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 0)
    check(S.shard_documents(df, 3).collect(), docs, 3)
