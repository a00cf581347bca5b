import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as C  # noqa: E402
import test_decontam  # noqa: E402
import test_linededup  # noqa: E402
import test_simhash  # noqa: E402
from attestor.llm import pieces  # noqa: E402

D = "/root/testdata/sf0.001"


def brute(spark, docs, items):
    """The stages in plain Python over (doc_id, text)."""
    docs = [(d, t) for d, t in docs if t and any(ch.isalpha() for ch in t)]
    left = test_linededup.plain(docs, test_linededup.cuts_of(spark, docs))
    docs = [(d, left[t] if len(left[t]) >= (1 - C.MOST_REMOVED) * len(t) else t) for d, t in docs]
    docs = [(d, t) for d, t in docs if t.strip(" ")]
    docs.sort()
    docs = [x for i, (x, c) in enumerate(zip(docs, test_simhash.brute_wide_components(docs))) if i == c]
    bad = {r[0] for r in test_decontam.brute(docs, items) if r[5]}
    return {d: t for d, t in docs if d not in bad}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(spark, [tuple(r) for r in docs], items)
    got = {r.doc_id: r for r in C.run(spark, D).collect()}
    assert {d: r.text for d, r in got.items()} == want
    codec = pieces.codec(pieces.default_model())
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == codec.digest(r.text) for r in got.values())
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert 0 < len(got) < len(docs)


def test_stages_keep_columns_and_take_edge_cases(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash int"
    rows = [(1, None, "en", "s", 0, 1), (2, "", None, None, 0, 1), (3, "12 34", "en", "s", 5, 1), (4, "the cat is here", "en", "s", 15, 1), (4, "the cat is here", "en", "s", 15, 1),
            (5, "the cat is here", "en", "s", 15, 1), (6, "x alpha beta gamma delta y", "en", "s", 26, 1), (None, "der hund ist da und bellt", "de", "s", 25, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == C.STAGES[-1][0] or out.columns == docs.columns
            docs = C.write_table(out, name)
        assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 4] if data else [])
    assert len(C.STAGES) == 5 and docs.select(F.col("hash")).count() == 0


def test_line_stage_spares_no_text(spark):
    """Pure self-repetition, and a short document around a shared passage, lose what repeats."""
    passage = "\n".join(f"a line of the shared passage, number {i}" for i in range(8))
    rows = [(1, "first line\nsecond line\n" * 20 + "end"), (2, f"before it\n{passage}\nafter it"), (3, f"other words\n{passage}\nand here")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in C.lines(spark, docs, "").collect()}
    assert got[3].text == "other words\nand here" and got[2].text == rows[1][1]
    assert got[1].text.count("first line") == 1 and got[1].text.count("second line") == 1
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_line_stage_takes_copies_for_repeats(spark):
    rows = [(3, "the first line\nthe second line"), (1, "the first line\nthe second line"), (2, "before it\nthe first line\nthe second line"), (4, "one line"), (5, "one line")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in C.lines(spark, docs, "").collect()}
    assert got == {1: rows[1][1], 2: "before it", 4: "one line", 5: "one line"}


def test_equal_and_null_ids_are_no_reason_to_drop(spark, tmp_path):
    """Different texts with one id, or none, stay; rows that tie in id and text are one document."""
    spark.createDataFrame([(1, "the passage of a benchmark that nobody should have seen before now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "alpha beta gamma delta epsilon one"), (None, "quite another document with other words"), (None, "a third one that shares nothing at all"), (None, "a third one that shares nothing at all"),
            (5, "five is here with words of its own"), (5, "and the other five says something else"), (5, "and the other five says something else"), (6, "five is here with words of its own"),
            (None, "here is the passage of a benchmark that nobody should have seen before now again")]
    docs = spark.createDataFrame([(*r, {"k": 1}, 7) for r in rows], "doc_id long, text string, none map<string, int>, k1 int")
    near = C.near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    kept = C.write_table(near, "near")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted({(d or 0, t) for d, t in rows if d != 6})
    clean = C.decontaminate(spark, kept, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted({(d or 0, t) for d, t in rows[:7]})
