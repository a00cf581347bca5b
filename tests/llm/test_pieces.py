import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import pieces as P

D = "/root/testdata/sf0.01"
SP = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
C = P.codec(P.default_model())


def same(text):
    want = SP.encode(text)
    back = SP.decode(want)
    assert C.encode(text) == want
    assert C.decode(want) == back
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert C.digest(text) == (len(want), sha(",".join(map(str, want))), sha(back))


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\nb\n\n c\t", "▁x ▁▁ y", "<s>", "</s> <unk> <0x0A>",
     "\U0001f600 中文 é é", "\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaaa", "The  QUICK", "x" * 3000, "the" * 20, "中文é" * 30, "ab" * 24, "ab" * 24 + "c", "1 2 3 " * 500, "  　"],
)
def test_like_the_library(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ▁\nabthe<>0é中", max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12))
def test_decode_any_ids(ids):
    assert C.decode(ids) == SP.decode(ids)


def test_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.op2_sentencepiece(spark, D).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.collect():
        ids = SP.encode(r.text)
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))


def test_operators_and_edge_cases(spark):
    schema = "doc_id long, text string, ids int, n_tokens string"
    df = spark.createDataFrame([(1, None, 1, "x"), (1, None, 1, "x"), (None, "", 2, "y"), (3, "a b", None, None)], schema)
    got = P.decode(P.encode(df, out="tok"), ids="tok").orderBy("doc_id", "text").collect()
    assert [(r.doc_id, r.tok, r.decoded) for r in got] == [(None, [], ""), (1, [], ""), (1, [], ""), (3, SP.encode("a b"), "a b")]
    assert P.token_digests(df).count() == 4
    assert P.token_digests(df.limit(0)).count() == 0


def test_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(P.PieceCodec, "MEMO", 4)
    c = P.PieceCodec(P.default_model())
    for t in ("a b c", "d e f", "a b c d", "a b c d e f g", "h"):
        ids = SP.encode(t)
        assert c.digest(t)[0] == len(ids)
