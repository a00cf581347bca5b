import hashlib
import re

import pytest

from attestor.llm import pii as P

D = "/root/testdata/sf0.01"
RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                  or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15))
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def row(doc_id, text):
    b = brute(text)
    n = [sum(x.startswith(k + ":") for x in b) for k in RAW]
    return (doc_id, *n, hashlib.sha256(",".join(b).encode()).hexdigest())


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = P.op8_personal_data(spark, D).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(row(r.doc_id, r.text) for r in docs)
    text = {r.doc_id: r.text for r in docs}
    for r in got:
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == brute(text[r.doc_id])
    assert sum(r.n_email for r in got) and sum(r.n_card for r in got)


TEXTS = [
    None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x@@y.z a.b@c-d.e.f.", "é€ü a@b.co 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 01.2.3.004",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111 4111111111111111", "+1 (755) 555-3798 +12 +123456789012345 6", "+49.30 12 34 56-78)",
    "1 " * 30000, "a" * 60000, "a." * 30000, "1." * 30000, "1" * 60000, "+" * 30000, "+1 " + "(" * 30000, "a@" + "b." * 20000, "\U0001f600 1.1.1.1 \U0001f600 x@y.zz",
]


def test_edge_cases(spark):
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate([*TEXTS, TEXTS[5]])], "doc_id int, text string, kind string, spans string")
    got = sorted(tuple(r)[:6] for r in P.personal_data(df).collect())
    assert got == sorted(row(i, t) for i, t in enumerate([*TEXTS, TEXTS[5]]))
    assert P.personal_data(df.limit(0)).count() == 0
    assert P.personal_data(spark.createDataFrame([(None, "a@b.cc")], "doc_id long, text string")).first().n_email == 1


def test_unseen_identifiers_are_discovered(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011000990139424", "3530111333300000", "4222222222222", "5105105105105100"]
    rows = [(i, f"please charge account number {c} today") for i, c in enumerate(cards)]
    rows += [(100, "we saw account number 4111111111111112 there"), (101, "it has serial 77777777777777 on it"), (102, "about 1234567 things")]
    got = {r.doc_id: r.spans for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:22:38"
    assert got[101] == "" and got[102] == ""
    assert all(got[i].startswith("card:") and "," not in got[i] for i in range(8))


def test_discoveries_of_other_shapes_make_new_patterns(spark):
    """Two hops: cards teach "number", the tokens found there teach "token =", which no base seed stands in."""
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011000990139424", "3530111333300000", "4222222222222", "5105105105105100"] + [
        c for c in (f"40000000000{i:05d}" for i in range(400)) if luhn(c)
    ]
    tokens = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    tokens = [t for t in tokens if re.match("[0-9]{2}|[a-f]+[0-9]", t)][:7]
    rows = [(i, f"please charge account number {c} today") for i, c in enumerate(cards)]
    rows += [(1000 + i, f"see account number {t} there") for i, t in enumerate(tokens[:6])]
    rows += [(2000 + i, f'set token = "{t}" here') for i, t in enumerate(tokens)]
    rows += [(3000, "see account number +12-345 and"), (3001, "see account number " + "x9" * 60 + " and")]
    got = {r.doc_id: r.spans for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for d in got:
        if d >= 1000:
            (span,) = got[d].split(",")
            kind, start, end = span.split(":")
            assert kind == "id" and text[d][int(start) : int(end)] in [*tokens, "+12-345", "x9" * 60]


@pytest.mark.parametrize("columns", ["Python", "Pandas", "Arrow"])
def test_main_path_is_native(spark, columns, capsys):
    P.op8_personal_data(spark, "/root/testdata/sf0.001").explain()
    assert columns not in capsys.readouterr().out


def test_context_words_of_any_length(spark):
    """A pattern word longer than any fixed context, after line breaks, is learned and used whole."""
    word = "account" * 40
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011000990139424", "3530111333300000", "4222222222222", "5105105105105100"]
    rows = [(i, f"see\n\n{word}\n{c} now") for i, c in enumerate(cards)] + [(100, f"see\n\n{word}\n4111111111111112 now"), (101, f"see\n\nx{word[1:]}\n4111111111111113 now")]
    got = {r.doc_id: r.spans for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = len(f"see\n\n{word}\n")
    assert got[100] == f"id:{at}:{at + 16}" and got[101] == ""
