import zlib
from collections import Counter

import numpy as np
import pytest

from attestor.llm import langid as L

D = "/root/testdata/sf0.01"


def brute_counts(text):
    c = Counter()
    words = "".join(ch.lower() if ch.isalpha() and len(ch.lower()) == 1 else ch if ch.isalpha() else " " for ch in text or "").split()
    for w in words:
        p = f" {w} "
        c.update(w)
        c.update(a + b for a, b in zip(p, p[1:]))
        c.update(a + b + d for a, b, d in zip(p, p[1:], p[2:]))
    return c


def code(gram):
    out = 0
    for ch in gram:
        out = out << 21 | ord(ch)
    return out


@pytest.mark.parametrize("block", [4, 7, 1 << 20])
@pytest.mark.parametrize("text", [None, "", "  ", "12 %", "a", "The cat, the Hat", "é  ß42Ünder x" * 3, "中文 a\nb"])
def test_counts(text, block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    codes, n = L.ngram_counts(text)
    got = {c: k for c, k in zip(codes.tolist(), n.tolist())}
    want = Counter()
    for g, k in brute_counts(text).items():
        want[code(g)] += k
    # A blank between two words belongs to both, so a blank before and after a word stands once in the text.
    assert got == dict(want)


def test_distance_by_hand():
    p = L.Profiles({"xx": np.array([10, 20, 30]), "yy": np.array([30, 10])}, size=5)
    doc = np.array([20, 10, 99])
    assert p.distance(doc, "xx") == 1 + 1 + 5
    assert p.distance(doc, "yy") == 5 + 0 + 5


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect()}
    got = L.op3_language_id(spark, D).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int"
    rows = [(1, "the cat and the dog", "en"), (4, "der hund und die katze", "de"), (None, None, None), (5, "12 !", "en"),
            (5, "12 !", "en"), (6, "the dog", None), (7, "", "fr")]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], schema)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in L.identify(df).collect())
    assert got == [(0, "und"), (1, "en"), (4, "de"), (5, "und"), (5, "und"), (6, "en"), (7, "und")]
    assert L.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_query_against_brute_force(spark):
    """Profiles, out-of-place distances, predictions and scores of every row, with strings and dictionaries only."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()

    def ranked(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:300]]

    sums = {}
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums.setdefault(r.lang, Counter()).update(brute_counts(r.text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in sums.items()}
    got = {r.doc_id: r for r in L.op3_language_id(spark, sf).collect()}
    for r in docs:
        grams = ranked(brute_counts(r.text))
        if not grams:
            want = ("und", 0.0)
        else:
            best, lang = min((sum(min(abs(i - p[g]), 300) if g in p else 300 for i, g in enumerate(grams)), lang) for lang, p in profiles.items())
            want = (lang, 1 - best / (300 * len(grams)))
        assert got[r.doc_id].lang_pred == want[0] and abs(got[r.doc_id].score - want[1]) < 1e-12
