"""Verses: exact in two spellings, altered, partial, across borders, by translation; what prepare() makes of them."""

import pytest
from pyspark.sql import functions as F

from attestor import api
from attestor.functions import text
from attestor.plans.verify import Corpus, claims_table, verify

# Placeholder sentences stand for verses: plain and marked spelling, translation.
VERSES = [
    (1, "هذا كتاب واحد للاختبار", "هَٰذَا كِتَٰب وَٰحِد لِلِاخْتِبَار", "this is one book for testing"),
    (2, "والثاني يتبعه في نفس الصفحة مع كلمات اخرى كثيرة", "وَالثَّانِي يَتْبَعُهُ فِي نَفْسِ الصَّفْحَةِ مَعَ كَلِمَات أُخْرَى كَثِيرَة", "and the second follows it on the same page with many other words"),
    (3, "ثم الثالث قصير جدا", "ثُمَّ الثَّالِثُ قَصِير جِدًّا", "then the third is very short"),
    (4, "هذا كتاب واحد للاختبار", "هَٰذَا كِتَٰب وَٰحِد لِلِاخْتِبَار", None),
    (5, "كلمة السطر الخامس تختلف عن غيرها من السطور كلها", "كَلِمَةُ السَّطْرِ الْخَامِسِ تَخْتَلِفُ عَنْ غَيْرِهَا مِنَ السُّطُورِ كُلِّهَا", "the word of the fifth line differs from all the other lines"),
]
POSTS = [
    (1, "قال تعالى ﴿هذا كتاب واحد للاختبار﴾"), (2, "قال تعالى ﴿والثاني يتبعه في نفس الصفحة مع اشياء اخرى كثيرة﴾"), (3, "﴿كثيرة ثم الثالث قصير جدا﴾"),
    (4, "﴿هَٰذَا كِتَٰب وَٰحِد﴾"), (5, "Allah says: the word of the fifth line differs from all the other lines"), (6, "﴿جملة لا علاقة لها بما سبق ابدا مطلقا﴾"),
    (7, "قال فلان: «كلمة السطر الخامس تختلف عن غيرها من السطور كلها»"), (8, "﴿الصفحة مع كلمات غريبة كثيرة ثم الثالث قصير جدا﴾"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    v = spark.createDataFrame([(0, i, 1, i, *x) for i, *x in VERSES], "part int, id long, ref_chapter int, ref_verse int, text string, text_marked string, text_en string")
    v = v.withColumns({"text_norm": text.normalize_ar(F.col("text"), honorifics=False), "name_ar": F.lit("الاسم"), "name_en": F.lit("Name")})
    n = spark.createDataFrame([(1, "main", "10", "حدثنا فلان عن فلان ان رسول الله قال العمل بالنية ولكل امرئ ما نوى من عمله", "deeds are by intention", "u1")], "doc_id long, collection string, number string, text_ar string, text_en string, url string")
    n = n.withColumns({"text_norm": text.normalize_ar(F.col("text_ar")), "body_norm": F.lit(None).cast("string"), "text_en_norm": text.normalize_en(F.col("text_en"))})
    r = spark.createDataFrame([(1, "sahih", "dataset", "R", "Sahih")], "doc_id long, grade_class string, origin string, rater string, label string")
    return Corpus(n, r, v)


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "post_id int, text string")


@pytest.fixture(scope="module")
def results(posts, corpus):
    return api.verify(posts, corpus)[0].cache()


def test_matches(results):
    got = {r.post_id: r for r in results.collect()}
    kind = {i: (r.claim_type, r.match_type, r.start_id, r.end_id) for i, r in got.items()}
    assert kind[1] == ("quran", "identical", 1, 1) and got[1].status == "green"
    assert kind[2] == ("quran", "altered", 2, 2) and got[2].status == "amber" and 0 < got[2].confidence < 1
    assert [(d.text, d.source) for d in got[2].diff if d.op == "replace"] == [("اشياء", "كلمات")]
    assert kind[3] == ("quran", "partial", 2, 3) and got[3].confidence == 1
    assert kind[4] == ("quran", "partial", 1, 1)
    assert kind[5][:2] == ("quran", "paraphrase") and kind[5][2:] == (5, 5) and "matched_translation_meaning" in got[5].notes
    assert kind[6] == ("quran", "not_found", None, None) and got[6].score == 0 and "searched_without_reranker" in got[6].notes
    assert kind[7] == ("quran", "identical", 5, 5) and "retyped_as_quran" in got[7].notes
    assert kind[8] == ("quran", "altered", 2, 3)


@pytest.mark.parametrize("out", ["ar", "en"])
def test_prepare_keeps_verses(posts, results, corpus, out):
    got = {r.post_id: r for r in api.prepare(posts, results, corpus, out).collect()}
    assert all(r.validated and not r.errors for r in got.values())
    for i in (1, 2, 3, 4, 5, 7, 8):
        assert got[i].actions == ["keep"], i
    assert got[6].actions == ["remove"]
    assert f"﴿{VERSES[0][2]} (1)﴾" in got[1].text and " [1]\n\n" in got[1].text
    assert f"﴿{VERSES[1][2]} (2) {VERSES[2][2]} (3)﴾" in got[3].text and "1:2-3" in got[3].text
    assert ("القرآن الكريم — الاسم 1:1" if out == "ar" else "The Holy Quran — Name 1:1") in got[1].text
    assert (f"(Translation: {VERSES[0][3]})" in got[1].text) == (out == "en")


def test_part_of_a_narration_becomes_its_excerpt(spark, corpus):
    posts = spark.createDataFrame([(1, "قال النبي: «العمل بالنية ولكل امرئ ما نوى»")], "post_id int, text string")
    results, _ = api.verify(posts, corpus)
    r = results.first()
    assert (r.match_type, r.doc_id) == ("partial", 1)
    got = api.prepare(posts, results, corpus).first()
    assert got.validated and "«العمل بالنية ولكل امرئ ما نوى» [1]" in got.text and "main 10 — الحكم: R: Sahih — u1" in got.text


def test_reranker_makes_paraphrases(spark, corpus):
    posts = spark.createDataFrame([(1, "the Prophet said: what counts is the purpose of deeds")], "post_id int, text string")
    without, _ = api.verify(posts, corpus)
    assert without.first().match_type == "not_found"
    found, _ = api.verify(posts, corpus, scorer=lambda q, d: [4.0 if "intention" in x else -4.0 for x in d])
    r = found.first()
    assert (r.match_type, r.doc_id) == ("paraphrase", 1) and r.confidence > 0.9 and "searched_without_reranker" not in r.notes


def test_vectors_bring_candidates(spark, corpus):
    posts = spark.createDataFrame([(1, "the Prophet said: purposes matter above everything else")], "post_id int, text string")
    claims = claims_table(posts).select("claim_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    corpus.vectors = spark.createDataFrame([(1, [0.9, 0.1])], "doc_id long, vec array<double>")
    try:
        r = verify(posts, corpus, dense=claims, scorer=lambda q, d: [3.0] * len(d)).first()
    finally:
        corpus.vectors = None
    assert (r.match_type, r.doc_id) == ("paraphrase", 1)


def test_long_posts_are_read_whole(spark, corpus):
    post = "x " * 4000 + "قال تعالى ﴿هذا كتاب واحد للاختبار﴾"
    df = spark.createDataFrame([(1, post)], "post_id int, text string")
    assert [r.match_type for r in verify(df, corpus).collect()] == ["identical"]
    assert [r.reason for r in api.verify(df, corpus)[1].collect()] == ["text_too_long"]
