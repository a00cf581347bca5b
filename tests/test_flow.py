import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestor import api
from attestor.config import Settings
from attestor.functions import text
from attestor.operators import claims, limits, prepare, score, select, stream_match
from attestor.plans.verify import Corpus
from attestor.sources import ingest, provider, sinks
from attestor.streaming import flows

SCORES = [
    ("quran", "identical", 1.0, "unknown", False, "green", 100), ("quran", "altered", 0.9, "unknown", False, "amber", 71), ("quran", "not_found", 0.9, "unknown", False, "red", 0),
    ("hadith", "identical", 1.0, "sahih", False, "green", 100), ("hadith", "identical", 1.0, "mawdu", False, "red", 30), ("hadith", "identical", 1.0, "daif", False, "amber", 75),
    ("hadith", "paraphrase", 0.8, "sahih", False, "amber", 77), ("hadith", "paraphrase", 0.8, "sahih", True, "green", 77), ("hadith", "paraphrase", 0.4, "sahih", True, "amber", 61),
    ("saying", "not_found", 0.0, "unknown", False, "amber", 0), ("hadith", "not_found", 0.0, "unknown", False, "red", 0), ("hadith", "partial", 1.0, "unknown", False, "amber", 70),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(SCORES)], "i int, t string, m string, c double, g string, x boolean, status string, score int")
    s = score.score(F.col("t"), F.col("m"), F.col("c"), F.col("g"), F.col("t") == "hadith", F.col("x"))
    for r in df.select("i", "status", "score", s.alias("s")).collect():
        assert (r.s.status, r.s.score) == (r.status, r.score), SCORES[r.i]


GRADES = [
    (["sahih", "daif"], "daif"), (["sahih", "sahih", "daif"], "sahih"), (["mawdu"], "mawdu"), (["mawdu", "daif", "daif"], "mawdu"), (["mawdu", "sahih"], "mawdu"),
    (["mawdu", "sahih", "sahih"], "sahih"), (["unknown"], "unknown"), (["hasan", "sahih"], "hasan"), (["unknown", "hasan"], "hasan"),
]


def test_grades(spark):
    rows = [(i, g, "d") for i, (gs, _) in enumerate(GRADES) for g in gs] + [(99, "daif", "d"), (99, "sahih", "collection_inclusion")]
    got = {r.k: r.grade_class for r in score.aggregate_grade(spark.createDataFrame(rows, "k int, grade_class string, o string"), ["k"], included=F.col("o") == "collection_inclusion").collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(GRADES)}, 99: "sahih"}


def test_claims():
    post = "قال رسول الله ﷺ: «إنما الأعمال بالنيات» and the Prophet said: be kind to all of them. ثم ﴿نص آية هنا﴾"
    got = claims.claims_of(post)
    assert [(c["text"], c["claim_type"]) for c in got] == [("إنما الأعمال بالنيات", "hadith"), ("be kind to all of them", "hadith"), ("نص آية هنا", "quran")]
    assert all(c["text"] in post for c in got)
    assert claims.claims_of("just a short post")[0]["claim_type"] == "saying" and claims.claims_of("tiny") == [] and claims.claims_of(None) == []
    assert claims.claims_of("x" * 700) == []
    assert claims.find_verbatim("a  b", "see a\nb here") == "a\nb" and claims.find_verbatim("zz", "see") is None


def test_injected_extractor_is_guarded(spark):
    posts = spark.createDataFrame([(1, "one text that is here"), (2, "other text of a post")], "post_id int, text string")

    def made_up(post):
        if "other" in post:
            raise RuntimeError
        return [{"text": "never said", "claim_type": "hadith", "attributed_to": None, "lang": "en"}]

    kept, _ = claims.extract(posts, extractor=made_up)
    assert {(r.post_id, r.text) for r in kept.collect()} == {(1, "one text that is here"), (2, "other text of a post")}


def test_stream_of_passages(spark):
    rows = [(1, "a b c"), (2, "d e"), (3, "a b c"), (4, "d e f"), (5, "x")]
    stream = stream_match.token_stream(spark.createDataFrame([(0, *r) for r in rows], "p int, id int, t string"), "p", "id", text.tokens(F.col("t")))
    asked = spark.createDataFrame([(1, "c d e"), (2, "a b c"), (3, "e f x"), (4, "q")], "claim_id int, t string").select("claim_id", text.tokens(F.col("t")).alias("words"))
    got = sorted((r.claim_id, r.start_id, r.end_id, r.whole) for r in stream_match.exact_matches(asked, stream).collect())
    assert got == [(1, 1, 2, False), (1, 3, 4, False), (2, 1, 1, True), (2, 3, 3, True), (3, 4, 5, False)]
    best = {r.claim_id: (r.start_id, len(r.others)) for r in stream_match.pick_occurrence(stream_match.exact_matches(asked, stream)).collect()}
    assert best == {1: (1, 1), 2: (1, 1), 3: (4, 0)}
    w = stream_match.windows(spark.createDataFrame([(1, 0, 2, 4)], "claim_id int, part int, id int, n_words int"), spark.createDataFrame([(0, *r) for r in rows], "p int, id int, t string"), "p", "id", "t")
    r = w.withColumn("s", stream_match.shrink(F.col("rows"), F.lit(3), F.lit(6))).first()
    assert (r.start_id, r.end_id, r.window_text) == (1, 3, "a b c d e a b c") and (r.s.start_id, r.s.end_id) == (2, 3)


def corpus(spark):
    n = [(1, "main", "10", "انما الاعمال بالنيات وانما لكل امرئ ما نوى", "actions are by intentions and each has what he intended"), (2, "extra", "3", "من غشنا فليس منا ابدا", "who cheats us is not of us"),
         (3, "main", "11", "الدين النصيحة لله ولرسوله", "religion is sincere advice")]
    df = spark.createDataFrame(n, "doc_id long, collection string, number string, text_ar string, text_en string").withColumns(
        {"text_norm": text.normalize_ar(F.col("text_ar")), "body_norm": F.lit(None).cast("string"), "text_en_norm": text.normalize_en(F.col("text_en")), "url": F.lit(None).cast("string")})
    r = spark.createDataFrame([(1, "sahih", "collection_inclusion"), (2, "mawdu", "dataset"), (3, "sahih", "dataset")], "doc_id long, grade_class string, origin string")
    v = spark.createDataFrame([(0, 1, "قل هو الله احد"), (0, 2, "الله الصمد لم يلد")], "part int, id long, text string").withColumn("text_norm", text.normalize_ar(F.col("text"), honorifics=False))
    return Corpus(df, r, v, secondary=("extra",))


def test_verify_and_prepare(spark):
    c = corpus(spark)
    posts = spark.createDataFrame([
        (1, "قال رسول الله ﷺ: «إنما الأعمال بالنيات وإنما لكل امرئ ما نوى»"), (2, "قال النبي: «من غشنا فليس منا أبدا»"), (3, "قال تعالى ﴿هو الله أحد الله الصمد﴾"),
        (4, "قال النبي: «كلام لا أصل له في شيء هنا»"), (5, "the Prophet said: religion is sincere advice."), (6, ""),
    ], "post_id int, text string")
    results, rejected = api.verify(posts, c)
    got = {r.post_id: r for r in results.collect()}
    assert [r.reason for r in rejected.collect()] == ["empty_input"]
    assert (got[1].match_type, got[1].status, got[1].doc_id, got[1].score) == ("identical", "green", 1, 100)
    assert (got[2].match_type, got[2].status, got[2].grade_class) == ("identical", "red", "mawdu")
    assert (got[3].claim_type, got[3].match_type, got[3].start_id, got[3].end_id) == ("quran", "partial", 1, 2)
    assert (got[4].match_type, got[4].status, got[4].score) == ("not_found", "red", 0)
    assert (got[5].match_type, got[5].doc_id, got[5].status) == ("paraphrase", 3, "green")
    out = {r.post_id: r for r in api.prepare(posts.where("post_id in (1, 2, 4)"), results, c).collect()}
    assert all(r.validated for r in out.values())
    assert out[1].actions == ["keep"] and "«انما الاعمال بالنيات وانما لكل امرئ ما نوى» [1]" in out[1].text and "main 10" in out[1].text
    assert out[4].actions == ["remove"] and "قال النبي" not in out[4].text


def test_tampered_text_is_caught(spark):
    p = spark.createDataFrame([(1, "x «one two three four» y", ["k"], ["one two three four"]), (2, "x «one two changed four»", ["k"], ["one two changed four"]), (3, "gone", ["k"], ["three"])], "post_id int, text string, actions array<string>, segments array<string>")
    src = spark.createDataFrame([("zero one two three four five",)], "text string")
    assert {r.post_id: r.validated for r in prepare.validate(p, src).collect()} == {1: True, 2: False, 3: False}


def test_rewrite():
    c = [{"text": "claim A", "action": "replace", "original": "NEW", "source": "S"}, {"text": "claim B", "action": "remove"}, {"text": "absent", "action": "keep", "original": "O"}]
    got = prepare.rewrite("Hi. The Prophet said: “claim A”. Then \"claim B\" end", c, "en")
    assert got["actions"] == ["replace", "remove", "skipped"] and "said" not in got["text"]
    assert "An authentic text with this meaning: «NEW» [1]" in got["text"] and got["text"].endswith("Sources:\n[1] S")


def test_choices(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    n = spark.createDataFrame([(2, "c", 5), (3, "d", 2), (3, "e", 1)], "k int, v string, at int")
    assert {r.k: r.v for r in select.upsert_latest(t, n, ["k"], "at").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.k: r.v for r in select.insert_ignore(t, n, ["k"], [F.col("at")]).collect()} == {1: "a", 2: "b", 3: "e"}


def test_limits(spark):
    assert limits.admit_times([0, 1, 2, 11, 12, 13], 2, 10) == [True, True, False, True, True, False]
    assert limits.admit_times([0, 0, 0], 0, 10) == [True] * 3
    df = spark.createDataFrame([("a", 0.0, 1), ("b", 0.1, 2), ("a", 0.2, 3), ("a", 0.3, 4)], "k string, at double, n int")
    got = {r.n: (r.own_ok, r.admitted) for r in limits.admit_both(df, "k", "at", "n", (2, 10.0), (2, 10.0)).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (True, False), 4: (False, False)}


def test_readers(spark, tmp_path):
    (tmp_path / "v.xml").write_text('<q><sura index="1"><aya index="1" text="واحد"/><aya index="2" text="اثنان" bismillah="ب"/></sura></q>', encoding="utf-8")
    (tmp_path / "m.xml").write_text('<q><sura index="1"><aya index="1" text="وَاحِد"/><aya index="2" text="اثْنَان"/></sura></q>', encoding="utf-8")
    (tmp_path / "n.xml").write_text('<q><suras><sura index="1" name="الأولى" tname="First"/></suras></q>', encoding="utf-8")
    (tmp_path / "t.txt").write_text("# c\n1|1|one|more\n\n")
    got = ingest.passages(ingest.verses_xml(spark, f"{tmp_path}/v.xml"), ingest.verses_xml(spark, f"{tmp_path}/m.xml"), ingest.chapter_names_xml(spark, f"{tmp_path}/n.xml"), ingest.verses_text(spark, f"{tmp_path}/t.txt")).orderBy("id").collect()
    assert [(r.id, r.text_clean, r.text_norm, r.text_en, r.name_en) for r in got] == [(1, "واحد", "واحد", "one|more", "First"), (2, "اثنان", "اثنان", None, "First")]
    a = {"metadata": {"sections": {"1": "Book"}}, "hadiths": [{"hadithnumber": 1, "arabicnumber": 1, "text": "نص", "reference": {"book": 1}, "grades": [{"name": "R", "grade": "Sahih"}, {"name": "S", "grade": "-"}]}, {"hadithnumber": 2, "arabicnumber": 1, "text": "مكرر", "grades": []}, {"hadithnumber": 3, "arabicnumber": 0, "text": " "}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "e.json").write_text(json.dumps({"hadiths": [{"hadithnumber": 1, "text": "old"}, {"hadithnumber": 1, "text": "Narrated X Y: text"}]}))
    n, r = ingest.narrations_a(spark, f"{tmp_path}/a.json", f"{tmp_path}/e.json", "c", "u/", included="all")
    assert [(x.number, x.book, x.text_ar, x.text_en, x.narrator, x.url) for x in n.collect()] == [("1", "Book", "نص", "Narrated X Y: text", "X Y", "u/c:1")]
    assert sorted((x.rater, x.label, x.origin) for x in r.collect()) == [("R", "Sahih", "dataset"), ("all", "sahih", "collection_inclusion")]
    (tmp_path / "b.json").write_text(json.dumps({"chapters": [{"id": 1, "arabic": "باب"}], "hadiths": [{"id": 9, "idInBook": 4, "chapterId": 1, "arabic": "نص", "english": {"narrator": "", "text": "t"}}]}))
    b = ingest.narrations_b(spark, f"{tmp_path}/b.json", "d").first()
    assert (b.number, b.book, b.narrator, b.text_en) == ("4", "باب", None, "t")
    (tmp_path / "s.txt").write_text("# x\nquery one\tok\nquery two\n")
    assert {(x.query, x.review_status) for x in ingest.seeds(spark, f"{tmp_path}/s.txt").collect()} == {("query one", "ok"), ("query two", "needs_review")}


HTML = """<div class="border-bottom">out</div><div id="home"><div class="x border-bottom"><article>1 - : نص الحديث ، هنا</article><strong>الراوي : <span>فلان</span></strong><strong>| المحدث: <span>علان</span></strong>
<strong>درجة الحديث: <span>صحيح</span></strong><a href="/h/ab12?alts=1">x</a></div><div class="border-bottom"><h5>ثان</h5><a tag="zz9">y</a></div><div class="border-bottom">none</div></div>"""


def test_provider(spark):
    got = provider.parse(HTML)
    assert [(r["text"], r["rawi"], r["mohdith"], r["grade"], r["hadith_id"], r["has_alternate"]) for r in got] == [("نص الحديث، هنا", "فلان", "علان", "صحيح", "ab12", True), ("ثان", "", "", "", "zz9", False)]
    assert provider.parse(None) == [] and provider.parse("<div class='border-bottom'><h5>x") [0]["text"] == "x"
    assert spark.createDataFrame([(HTML,)], "h string").select(F.size(provider.records(F.col("h")))).first()[0] == 2


def test_client():
    calls, slept = [], []

    def fetch(status):
        def run(url):
            calls.append(url)
            if len(calls) < 3:
                raise provider.FetchError(status)
            return HTML

        return run

    client = provider.Client("http://p", fetch(503), sleep=slept.append, clock=lambda: 0.0)
    assert len(client.search("a  b")) == 2 and len(calls) == 3 and calls[0].endswith("q=a%20b") and len(slept) == 2
    calls.clear()
    with pytest.raises(provider.FetchError):
        provider.Client("http://p", fetch(403)).search("x")
    assert len(calls) == 1
    with pytest.raises(provider.FetchError):
        provider.Client("http://p").search("x")


def test_sinks(spark, tmp_path):
    t = {"n": spark.createDataFrame([(1, "c")], "id int, collection string"), "checks": spark.createDataFrame([(1,)], "id int")}
    sinks.sanitised_copy(t, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o/n")).count() == 1 and not (tmp_path / "o/checks").exists()
    res = spark.createDataFrame([(1, 0, "x")], "post_id int, idx int, claim_text string")
    row = sinks.result_rows(res, spark.createDataFrame([(1, "secret")], "post_id int, text string")).first()
    assert "secret" not in row.result_json and json.loads(row.result_json)["claims"][0]["claim_text"] == "x" and len(row.input_hash) == 64
    assert "| a | 1 |" in sinks.report({"a": 1}, [{"x": 1}])


def test_streams(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [("a", start + timedelta(seconds=s)) for s in (0, 1, 2, 30)] + [("b", start)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    q = flows.admit_stream(src, "k", 2, 10.0).writeStream.format("memory").queryName("adm").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.k, (r.ts - start).seconds): r.admitted for r in spark.table("adm").collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 30): True, ("b", 0): True}
    q = flows.latest_stream(src, ["k"], "ts").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.k: (r.ts - start).seconds for r in spark.table("latest").collect()} == {"a": 30, "b": 0}


def test_settings(monkeypatch):
    monkeypatch.setenv("ATTESTOR_RRF_K", "7")
    assert Settings.from_env().rrf_k == 7 and Settings().rrf_k == 60
