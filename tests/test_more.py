"""Lookups, test sets, stores, services, readers and limits."""

import json

import pytest
from pyspark.sql import functions as F

from attestor import api, services
from attestor.functions import text
from attestor.operators import dense, limits, lookup, select, testset
from attestor.plans.verify import Corpus
from attestor.sources import ingest, sinks, stores


def test_verbatim_against_plain(spark):
    sources = ["one two three four", "alpha  beta\ngamma", "xone two", "", "ünï cödé words here", None, "a b c " * 500, "tail end"]
    segments = ["one two", "two three four", "ne two thr", "beta\ngamma", "alpha beta", "ha  beta\ngam", "", "cödé", "cöd", "zzz", " ", "one", "d", "e wor", "b c a b", "four ", "  ", "end", "tail end x", None]
    src, seg = spark.createDataFrame([(s, 1) for s in sources], "text string, x int"), spark.createDataFrame([(i, s) for i, s in enumerate(segments)], "i int, text string")
    got = {r.i: r.exists for r in select.verbatim_exists(seg, src).collect()}
    assert got == {i: s is not None and any(s in t for t in sources if t is not None) for i, s in enumerate(segments)}


def test_limits_of_a_hot_key_and_bursts(spark):
    rows = [("hot", i * 0.01, i) for i in range(20000)] + [(f"k{i % 7}", i * 37.0, 100000 + i) for i in range(500)] + [(None, 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, at double, n long")
    got = {r.n: r.admitted for r in limits.admit(df, "k", "at", "n", 3, 10.0).collect()}
    by = {}
    for k, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(k, []).append((at, n))
    want = {n: ok for x in by.values() for (_, n), ok in zip(x, limits.admit_times([a for a, _ in x], 3, 10.0))}
    assert got == want
    both = {r.n: (r.own_ok, r.admitted) for r in limits.admit_both(df, "k", "at", "n", (3, 10.0), (4, 20.0)).collect()}
    passed = sorted((at, n) for _, at, n in rows if want[n])
    shared = dict(zip([n for _, n in passed], limits.admit_times([a for a, _ in passed], 4, 20.0)))
    assert both == {n: (ok, shared.get(n, False)) for n, ok in want.items()}


def test_dense_against_plain(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(9, 6)), rng.normal(size=(300, 6))
    v[7] = v[8]
    monkeypatch.setattr(dense, "ROWS", 40)
    monkeypatch.setattr(dense, "QUERY_BYTES", 6 * 8 * 4)
    queries = spark.createDataFrame([*((f"q{i}", x.tolist()) for i, x in enumerate(q)), ("zero", [0.0] * 6), ("none", None)], "query_id string, vec array<double>")
    vectors = spark.createDataFrame([*((i, x.tolist(), "a") for i, x in enumerate(v)), (3, (-v[3]).tolist(), "b"), (900, [0.0] * 6, "a"), (901, None, "a"), (902, [1.0], "a")], "doc_id long, vec array<double>, list string")
    got = {}
    for r in dense.dense_topk(queries, vectors, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    sims[:, 3] = abs(sims[:, 3])
    assert got == {f"q{i}": [int(j) for j in np.lexsort((np.arange(300), -sims[i].round(12)))[:5]] for i in range(9)}
    assert dense.dense_topk(queries.limit(0), vectors).count() == 0 and dense.dense_topk(queries, vectors.limit(0)).count() == 0


def cache(spark):
    rows = [("search:b", ["نص اول", "نص ثان"]), ("search:a", ["نص ثان"]), ("alts:x", ["نص ثالث"])]
    df = spark.createDataFrame(rows, "key string, t array<string>")
    return df.select("key", F.transform("t", lambda x: F.struct(x.alias("text"))).alias("response"))


def test_cached_responses_and_other_languages(spark):
    asked = spark.createDataFrame([("نص ثان",), ("نص ثالث",), ("نص اول",)], "text string")
    assert {r.text: r.key for r in lookup.cached_response(asked, cache(spark)).collect()} == {"نص ثان": "search:a", "نص ثالث": None, "نص اول": "search:b"}
    claims = spark.createDataFrame([(1, "first text", [1.0, 0.0]), (2, "far", [-1.0, -1.0])], "claim_id long, text string, vec array<double>")
    vectors = spark.createDataFrame([("k1", [0.9, 0.1]), ("k2", [0.1, 0.9])], "doc_id string, vec array<double>")
    texts = spark.createDataFrame([("k1", "نص اول"), ("k2", "نص لا يخزن")], "doc_id string, text string")
    got = lookup.cross_lingual(claims, vectors, texts, cache(spark)).collect()
    assert [(r.claim_id, r.text, r.query) for r in got] == [(1, "نص اول", "b")]
    got = lookup.cross_lingual(claims, vectors, texts, cache(spark), scorer=lambda q, d: [5.0 if "يخزن" in x else -5.0 for x in d]).collect()
    assert sorted((r.claim_id, r.text, r.query) for r in got) == [(1, "نص لا يخزن", "نص لا يخزن"), (2, "نص لا يخزن", "نص لا يخزن")]


def test_pages_of_a_column_and_best_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(9, 0, -1)], "id int, text string, v int")
    assert [tuple(r) for r in lookup.ordered_column(df, "text", ("text",), offset=2, limit=3).collect()] == [(3, "t3"), (4, "t4"), (5, "t5")]
    with pytest.raises(ValueError):
        lookup.ordered_column(df, "v; drop", ("text",))
    best = lookup.best_by(df.withColumn("k", F.col("id") % 2), ["k"], "v", ["text"]).collect()
    assert {r.k: (r.text, r.v) for r in best} == {0: ("t2", 2), 1: ("t5", 2)}


def test_search(spark):
    n = spark.createDataFrame([(1, "m", "1", "نص", "deeds are judged by purposes"), (2, "m", "2", "نص", "advice is good")], "doc_id long, collection string, number string, text_ar string, text_en string")
    n = n.withColumns({"text_norm": text.normalize_ar(F.col("text_ar")), "body_norm": F.lit(""), "text_en_norm": text.normalize_en(F.col("text_en")), "url": F.lit("")})
    c = Corpus(n, spark.createDataFrame([], "doc_id long, grade_class string, origin string"))
    got = api.search(spark.createDataFrame([(7, "purposes of deeds")], "query_id long, text string"), c).collect()
    assert [(r.query_id, r.doc_id, r.rank, r.weak) for r in got] == [(7, 1, 1, True)]  # one list alone gives a confidence just under the bound


def test_sets_of_items(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(40)] + [(99, " ".join(f"w3x{j}" for j in range(10)))]
    df = spark.createDataFrame(rows, "n long, t string")
    plan = [("identical", 5), ("partial", 3), ("altered", 2)]
    got = testset.build(df, plan, "n", "t", "auth", "en").collect()
    assert got == testset.build(df.repartition(7), plan, "n", "t", "auth", "en").collect() and len({r.expected_source_id for r in got}) == 10
    assert [sum(r.variant == v for r in got) for v, _ in plan] == [5, 3, 2] and "hadith:99" not in {r.expected_source_id for r in got}
    by = dict(rows)
    for r in got:
        words, inner = by[int(r.expected_source_id[7:])].split(), r.input.removeprefix('The Prophet ﷺ said: "').removesuffix('"').split()
        assert inner == {"identical": words, "partial": words[:6], "altered": words[:5] + words[6:]}[r.variant] and r.id.startswith(f"auth-{r.variant}-0")
    assert [r.id for r in testset.chosen(testset.build(df, plan, "n", "t", "auth"), "auth", 2).collect()] == ["auth-altered-01", "auth-altered-02"]
    quoted = spark.createDataFrame([('a "b c" d',), ("none",)], "t string").select(testset.first_quoted(F.col("t"))).collect()
    assert [r[0] for r in quoted] == ["b c", "none"]


def test_policy_labels(spark):
    seeds = spark.createDataFrame([("q1", "a b c d", "daif"), ("q2", "e f g h", "daif"), ("q3", "i j k l", "mawdu"), ("q4", "m n o p", "mawdu")], "query string, norm string, top_class string")
    hits = spark.createDataFrame([("q1", "a b c d", "mawdu"), ("q1", "zz yy", "sahih"), ("q2", "e f g h", "mawdu"), ("q2", "e f g h", "hasan"), ("q4", "m n o p", "sahih")], "query string, norm string, grade_class string")
    got = {r.query: (r.status, r.n_same) for r in testset.policy_label(seeds, hits).collect()}
    assert got == {"q1": ("red", 1), "q2": ("amber", 2), "q3": ("red", 0), "q4": ("amber", 1)}


def test_vector_store_goes_on_after_a_stop(spark, tmp_path):
    store = stores.VectorStore(spark, f"file://{tmp_path}/v")
    rows = spark.createDataFrame([(f"d{i}", "x" * (i + 1)) for i in range(5)], "doc_id string, text string")
    assert store.counts(["a"]) == {"a": 0} and store.read("a") is None
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<double>")
    assert store.query("a", queries, 3).count() == 0

    def encode(texts):
        return [[float(len(t)), 1.0] for t in texts]

    assert store.add("a", rows, encode, limit=2) == 2
    (tmp_path / "v/a/batch=1").mkdir()  # a batch that was not finished
    assert store.add("a", rows, encode) == 3 and store.add("a", rows, encode) == 0 and store.counts(["a"]) == {"a": 5}
    assert [r.doc_id for r in store.query("a", queries, 2).orderBy("rank").collect()] == ["d4", "d3"]


def test_posts_probes_and_stored_results(spark):
    s = stores.PostStore(2)
    for i in "abc":
        s.remember(i, i * 3)
    assert s.recall("a") is None and s.recall("c") == "ccc"
    now, asked = [0.0], []

    def ask():
        asked.append(now[0])
        if len(asked) == 2:
            raise OSError
        return True

    p = stores.Probe(ask, 300, lambda: now[0])
    assert p() and p()
    now[0] = 301.0
    assert not p() and asked == [0.0, 301.0]
    rows = sinks.result_rows(spark.createDataFrame([(1, 0, "x")], "post_id int, idx int, claim_text string"), spark.createDataFrame([(1, "p")], "post_id int, text string"))
    assert stores.stored_result(rows, 1)["post_id"] == 1 and stores.stored_result(rows, 2) is None


def test_chain_of_models():
    def call(model, prompt, schema):
        if model in ("busy", "down"):
            raise services.ServiceError(429 if model == "busy" else 503)
        if model == "bad":
            raise services.ServiceError(400)
        return json.dumps({"claims": [{"text": "t", "claim_type": "saying", "lang": "en"}]})

    chain = services.Chain(call, ["busy", "down", "good"])
    assert services.extractor(chain, "p")("post")[0]["text"] == "t" and [m for m, _ in chain.tried] == ["busy", "down"]
    with pytest.raises(services.ServiceError):
        services.Chain(call, ["bad", "good"]).ask("x")
    with pytest.raises(services.ServiceError):
        services.Chain(call, ["busy"]).ask("x")
    assert services.provider({"a": None, "b": "k"}) == "b" and services.provider({"a": None}) is None and services.provider({"a": "k", "b": None}, "b") is None


def test_schemas_images_and_steps():
    got = services.plain_schema({"type": "object", "additionalProperties": False, "properties": {"who": {"type": ["string", "null"]}, "n": {"type": "array", "items": {"type": "integer"}}}, "required": ["who"]})
    assert got == {"type": "OBJECT", "properties": {"who": {"type": "STRING", "nullable": True}, "n": {"type": "ARRAY", "items": {"type": "INTEGER"}}}, "required": ["who"]}
    tries = []

    def read(image):
        tries.append(image)
        if len(tries) == 1:
            raise services.ServiceError(500)
        return " text "

    assert services.read_image(read, b"x") == "text" and services.read_image(lambda i: "", b"x") is None
    now = iter([0.0, 1.0, 1.0, 3.0, 5.0, 6.0])
    steps = services.Steps(clock=lambda: next(now))
    with steps.step("a", n=1) as row:
        row["k"] = 2
    with pytest.raises(ValueError), steps.step("b"):
        raise ValueError
    with steps.step("a"):
        pass
    assert steps.totals() == {"a": 2000.0, "b": 2000.0} and steps.done[0]["k"] == 2 and steps.done[1]["status"] == "error"


def test_readers_of_lines(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"id": "a", "category": "c", "expected_source_ids": ["x"]}\n')
    (tmp_path / "p.jsonl").write_text('{"id": "a", "ms": 12, "top1": true}\n')
    (tmp_path / "s.jsonl").write_text('{"query": "q", "n_results": 2, "top": {"text": "t", "grade_class": "daif", "hadith_id": "h"}, "top_similarity": 0.95}\n')
    assert ingest.test_items(spark, f"{tmp_path}/i.jsonl").first().expected_source_ids == ["x"]
    assert ingest.predictions(spark, f"{tmp_path}/p.jsonl").first().ms == 12
    assert ingest.seed_report(spark, f"{tmp_path}/s.jsonl").first().top.grade_class == "daif"
    sinks.results({"k": 1}, {"m": 0.5}, f"file://{tmp_path}/r", spark)
    assert ingest.results_json(spark, f"file://{tmp_path}/r").first().metrics.m == 0.5
    n = spark.createDataFrame([("c", "1", "b", "n", "e"), ("d", "2", None, " ", None)], "collection string, number string, body_norm string, text_norm string, text_en string")
    assert [tuple(r) for r in ingest.index_rows(n, "hadith_ar").collect()] == [("c:1", "b")] and ingest.index_rows(n, "hadith_en", ["d"]).count() == 0


def test_staged_tables_are_released(spark):
    from attestor.operators import lexical, staging

    staging.release(spark)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, t string")
    index = lexical.LexicalIndex.stored(docs, "id", text.tokens(F.col("t")))
    one = staging.staged(docs, "one")
    assert one.count() == 2 and staging.release(spark) == 1 and staging.release(spark) == 0
    assert index.postings.count() == 4 and {r.term: r.n for r in index.terms.collect()} == {"a": 1, "b": 2, "c": 1}
    with pytest.raises(Exception):
        one.count()


def test_column_form_of_the_guard(spark):
    from attestor.operators import claims

    rows = [("a  b", "x a\nb y"), ("«a b»", "a b"), ("b a", "a b"), ("", "a")]
    got = spark.createDataFrame(rows, "s string, p string").select("s", claims.is_verbatim(F.col("s"), F.col("p")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False]
