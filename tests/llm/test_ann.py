import numpy as np
from pyspark.sql import functions as F

from attestor.llm import ann as A

D = "/root/testdata/sf0.01"


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    codes = A.fit(x)
    index = A.Index(np.arange(3000), x, codes)
    for r in (0, 1, 3, 4, 7, 11, 20, codes.bits):
        for q in range(0, 3000, 500):
            want = np.flatnonzero(np.bitwise_count(index.code ^ index.code[q]).sum(axis=1) <= r)
            assert (index.within(index.code[q], r) == want).all()


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, [i for i in range(len(ids)) if ids[i] % 100 == 0])
    got = {}
    for r in A.op9_neighbours(spark, D).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    dist = {(q, i): d for q in want for i, d in want[q]}
    assert all(abs(dist.get((q, i), d) - d) < 1e-12 for q in got for i, d in got[q])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 1.0, 2.0]) for i in range(1, 6)]
    bad = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [nan, 1.0, 1.0]), (400, [1.0, inf, 1.0]), (500, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (600, [1.0])]
    rows = [*good, *bad, (0, [1.0, 1.0, 2.0]), (7, [1.0, 1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, x string")
    got = A.neighbours(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 0.0), (0, 7, 0.0), (0, 2, 1.0), (0, 3, 2.0), (0, 4, 3.0), (0, 5, 4.0)]
    assert A.neighbours(df.limit(0), F.lit(True)).count() == 0


def test_outliers_are_searched_again(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(400, 8)), [[-90.0] * 8]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = A.neighbours(df, F.col("vec_id") == 400).collect()
    want = brute(np.arange(401), x, [400])[400]
    assert len(got) == 10
    assert len({r.vec_id for r in got} & {i for i, _ in want}) >= 9


def test_repeated_query_rows(spark):
    """A repeated query row is one query; one id with two vectors is two; repeated candidates all count."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    ids = np.arange(1, 61)
    rows = [*zip(ids.tolist(), x.tolist()), (100, x[3].tolist()), (100, x[3].tolist()), (200, x[9].tolist()), (200, x[20].tolist()), (7, x[6].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.neighbours(df, F.col("vec_id") % 100 == 0).collect()
    every = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q, vectors in ((100, [3]), (200, [9, 20])):
        mine = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == q)
        want = []
        for v in vectors:
            d = np.sqrt(((every[1] - x[v]) ** 2).sum(axis=1))
            order = [i for i in np.lexsort((every[0], d)) if every[0][i] != q][:10]
            want += [(n, int(every[0][i]), round(float(d[i]), 9)) for n, i in enumerate(order, 1)]
        assert len(mine) == len(want) == 10 * len(vectors)
        assert len(set(mine) & set(want)) >= 0.9 * len(want)


def test_stored_index_and_blocks(spark, monkeypatch):
    """Many blocks of rows and of queries give what one of each gives."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    one = sorted(A.neighbours(df, F.col("vec_id") % 50 == 0).collect())
    monkeypatch.setattr(A, "ROWS", 100)
    monkeypatch.setattr(A, "QUERY_BYTES", 7 * 64)
    many = sorted(A.neighbours(df, F.col("vec_id") % 50 == 0).collect())
    assert one == many and len(one) == 600
    index = A.Index(np.arange(3000), x, A.fit(x))
    back = A.Index.read(index.stored(), 8)
    assert (back.within(back.code[5], 9) == index.within(index.code[5], 9)).all() and (back.x == x).all()
