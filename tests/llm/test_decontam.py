import hashlib
import re

import pytest

from attestor.llm import decontam as D

SF = "/root/testdata/sf0.01"


def words(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    by = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            by.setdefault(tuple(w[at : at + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in by}:
            for at in range(len(w) - n + 1):
                if ids := by.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    got = sorted((tuple(r) for r in D.op7_decontamination(spark, SF).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_documents_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"SELECT {names} FROM ({D.SQL})").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    assert sorted(want, key=str) == brute(docs, items)


def test_edge_cases(spark):
    ten = "a b c d e f g h i j"
    docs = [(1, None), (2, ""), (3, "x A b C d e f g h i j y"), (3, "x A b C d e f g h i j y"), (4, f"{ten} {ten} k"),
            (5, "tiny item"), (6, "TINY, item! tiny item"), (None, "éÉ naïve"), (7, "a b c d e f g h i"), (8, "the " * 3000)]
    items = [(1, ten + " k"), (1, ten), (22, "tiny item"), (9, ""), (10, None), (11, "éÉ"), (12, "the " * 12)]
    d = spark.createDataFrame([(*r, "n", 1) for r in docs], "doc_id long, text string, term string, rid int")
    i = spark.createDataFrame([(*r, "n") for r in items], "item_id long, text string, words string")
    got = sorted((tuple(r) for r in D.contamination(d, i).collect()), key=str)
    assert got == brute(docs, items)
    assert D.contamination(d.limit(0), i).count() == 0
    assert not any(r.contaminated for r in D.contamination(d, i.limit(0)).collect())


def test_all_tokens_when_there_are_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_TERMS", 1)
    docs, items = [(1, "p q r s t"), (2, "q r")], [(5, "q r s")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in D.contamination(d, i).collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("slop,want", [(0, []), (1, []), (2, [(1, 6)])])
def test_proximity(spark, slop, want):
    d = spark.createDataFrame([(1, "z a x b x c q")], "doc_id long, text string")
    i = spark.createDataFrame([(5, "a b c")], "item_id long, text string")
    got = D.search(d, i, slop=slop).first().matches
    assert [(m.start, m.end) for m in got] == want
