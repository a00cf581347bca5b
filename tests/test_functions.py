import sqlite3

import pytest
from pyspark.sql import functions as F

from attestor.functions import keys, labels, text
from attestor.functions.porter import stem


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_normalize(spark):
    got = one(spark, text.normalize(F.col("v")), "إِنَّمَا الأَعْمَالُ بِالنِّيَّاتِ", "قال النبي صلى الله عليه وسلم: «الدين»", "The Prophet (PBUH) said, “Hi_there”!", "٣ ۴ ﷲ", "", "ﬁne TEXT")
    assert got == ["انما الاعمال بالنيات", "قال النبي الدين", "the prophet said hi there", "3 4 الله", "", "fine text"]
    again = one(spark, text.normalize(F.col("v")), *got)
    assert again == got


def test_honorifics_stay_in_verses(spark):
    assert one(spark, text.normalize_ar(F.col("v"), honorifics=False), "عليه السلام") == ["عليه السلام"]
    assert one(spark, text.normalize_ar(F.col("v")), "عليه السلام", "عليه السلامه") == ["", "عليه السلامه"]


def test_language(spark):
    assert one(spark, text.detect_lang(F.col("v")), "abc", "ابج", "ab اب", "", "12") == ["en", "ar", "ar", "ar", "ar"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("v")), "a b", "") == [["a", "b"], []]


def test_body(spark):
    cases = ["حدثنا فلان قال: «نص طويل يكفي للاختبار هنا».", "عن فلان أن رسول الله ﷺ قال: نص آخر طويل بما يكفي", "short", "قال «قصير»"]
    got = one(spark, text.extract_body(F.col("v")), *cases)
    assert got == ["نص طويل يكفي للاختبار هنا", "نص آخر طويل بما يكفي", None, None]
    assert all(g is None or g in c for g, c in zip(got, cases))


def test_excerpt():
    assert text.find_excerpt("قَالَ إِنَّمَا الأَعْمَالُ، بِالنِّيَّاتِ", "انما الاعمال بالنيات".split()) == "إِنَّمَا الأَعْمَالُ، بِالنِّيَّاتِ"
    assert text.find_excerpt("abc", ["x"]) is None and text.find_excerpt(None, ["x"]) is None


EN = {"": "unknown", " - ": "unknown", "Sahih": "sahih", "Hasan Sahih": "sahih", "Daif Isnaad": "daif", "Isnaad Sahih": "sahih", "Maudu": "mawdu", "Da'if (weak)": "daif",
      "Hasan": "hasan", "good": "hasan", "Fabricated; sahih": "mawdu", "other": "unknown", "agreed upon": "sahih", "weak, sahih": "daif"}
AR = {"": "unknown", "صحيح": "sahih", "حسن صحيح": "sahih", "إسناده ضعيف": "daif", "موضوع": "mawdu", "لا أصل له": "mawdu", "حسن": "hasan", "ضعيف جداً": "daif", "[صحيح]": "sahih", "محسن": "unknown"}


def test_labels(spark):
    assert dict(zip(EN, one(spark, labels.bucket_en(F.col("v")), *EN))) == EN
    assert dict(zip(AR, one(spark, labels.bucket_ar(F.col("v")), *AR))) == AR
    assert one(spark, labels.label_to_ar(F.col("v")), " Sahih ", "x", None) == ["صحيح", None, None]


def test_keys(spark):
    assert one(spark, keys.client_key(F.col("v"), F.lit("10.0.0.1")), "1.1.1.1, 2.2.2.2", "", None) == ["1.1.1.1", "10.0.0.1", "10.0.0.1"]
    assert one(spark, keys.narrator(F.col("v")), "Narrated Someone: text", "no") == ["Someone", None]
    assert one(spark, keys.search_key(F.col("v")), "  The   Text ") == ["search:the text"]
    r = spark.sql("SELECT 1.0D a, 0.0D b, 2.5D c, 7.0D d").select(keys.record_number(F.col("a"), F.col("d")), keys.record_number(F.col("b"), F.col("d")), keys.record_number(F.col("c"), F.col("d"))).first()
    assert tuple(r) == ("1", "7", "2.5")
    assert one(spark, keys.record_url("u/", F.lit("c"), F.col("v")), "12.5", "3-4") == ["u/c:12", "u/c:3"]
    ref = one(spark, F.to_json(keys.parse_ref(F.col("v"))), "2:3", "2:3-5", "2:3-4:1")
    assert ref[2] == '{"chapter":2,"first":3,"chapter_end":4,"last":1}' and '"last":5' in ref[1] and '"last":3' in ref[0]
    back = spark.sql("SELECT 2 c, 3 a, 4 d, 1 b").select(keys.passage_ref(F.col("c"), F.col("a"), F.col("d"), F.col("b"))).first()[0]
    assert back == "2:3-4:1"
    assert one(spark, keys.media_type(keys.image_bytes(F.col("v"))), "data:image/png;base64,iVBORw0KGgo=", "R0lGODlh", "?", "YWJj") == ["image/png", "image/gif", None, None]


@pytest.mark.parametrize("words", ["caresses ponies ties cats feed agreed plastered motoring sing conflated troubling sized hopping falling hissing failing filing happy sky relational conditional vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll"])
def test_stems_like_the_database(words):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize = 'porter unicode61')")
    for w in words.split():
        con.execute("INSERT INTO t VALUES (?)", (w,))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = dict(con.execute("SELECT doc, term FROM v"))
    assert [stem(w) for w in words.split()] == [want[i + 1] for i in range(len(words.split()))]
