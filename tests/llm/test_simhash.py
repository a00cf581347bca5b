import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import simhash as S

D = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [S.xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    f = np.array(fps, np.uint64)
    comp = list(range(len(f)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                comp[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(f)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(f))]


def test_golay_keys_meet():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (rx, kx), (ry, ky) = S.fuzzy_keys(x), S.fuzzy_keys(y)
    own = [set() for _ in x]
    for r, k in zip(rx.tolist(), kx.tolist()):
        own[r].add(k)
    met = [False] * len(x)
    for r, k in zip(ry.tolist(), ky.tolist()):
        met[r] |= k in own[r]
    assert all(met)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a b c", "a b c d", "A B c D e f", "é É x\x0by z w q r s", "w " * 40000])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_hash_is_the_engines_own(spark):
    got = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % 2**64 == S.xxhash.xxh64_intdigest(b"a b c d", seed=42)


def test_documents_against_brute_force(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    comp = brute_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op5_simhash(spark, D).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)}


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp string, component_id int, a long"
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, None), (2, ""), (9, "same words in here"), (7, "same words in here"), (7, "same words in here"), (None, "alone " * 9)]
    got = S.near_duplicates(spark.createDataFrame([(*r, "x", 1, 1) for r in rows], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (2, 2), (3, 2), (7, 7), (7, 7), (9, 7)]


def test_chain_and_dense_runs():
    fps = np.array([0, 0b1111, 0b11111111, 31 * 2**40], np.int64)
    e = S.links_in_runs(np.zeros(4, np.int64), np.sort(fps))
    assert {tuple(sorted(x)) for x in e.tolist()} == {(0, 0b1111), (0b1111, 0b11111111)}
    many = np.array([i for i in range(2048)], np.int64)
    e = S.links_in_runs(np.zeros(2048, np.int64), many)
    assert len(e) == 2047


def shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []


def brute_wide(text):
    """320 bits: each lane's bit is set if set in over half of the shingles' hashes of that lane."""
    total, hashes = 0, [S.xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles(text)]
    for lane in range(5):
        hs = []
        for h in hashes:
            if lane:
                h = (h + lane * 0x9E3779B97F4A7C15) % 2**64
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
                h ^= h >> 31
            hs.append(h)
        total |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) << (64 * lane)
    return total


def brute_wide_components(docs):
    """Index of the first of each component, in order of docs (id, text): fingerprints 52 bits apart or fewer."""
    fps = [brute_wide(t) for _, t in docs]
    comp = list(range(len(docs)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    lanes = np.array([[f >> (64 * k) & (2**64 - 1) for k in range(5)] for f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(lanes[i + 1 :] ^ lanes[i]).sum(axis=1) <= 52) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                comp[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(docs))]


def test_similar_texts_against_brute_force(spark):
    """Edited copies: similarities of 0.9 are all found, of 0.8 all but a few, and nothing that the bits don't link."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for group in range(60):
        base = [vocabulary[i] for i in rng.integers(0, 4000, 300)]
        docs.append((len(docs), " ".join(base)))
        for edits in (1, 3, 5, 8, 40):
            w = list(base)
            for at in rng.integers(0, len(w), edits):
                w[at] = vocabulary[rng.integers(0, 4000)]
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = {r.id for r in S.repeated_keys(df).collect()}
    comp = brute_wide_components(docs)
    want = {d for (d, _), c in zip(docs, comp) if c != d}
    assert not gone - want and len(gone) >= 0.9 * len(want)
    sets = [set(shingles(t)) for _, t in docs]
    similar = {d: len(sets[d] & sets[d - d % 6]) / len(sets[d] | sets[d - d % 6]) for d in range(len(docs)) if d % 6}
    assert all(d in gone for d, j in similar.items() if j >= 0.9)
    assert np.mean([d in gone for d, j in similar.items() if j >= 0.8]) >= 0.95
    assert not any(d in gone for d, j in similar.items() if j < 0.6)
