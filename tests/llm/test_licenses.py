import re

import numpy as np
import pytest

from attestor.llm import licenses as L

D = "/root/testdata/sf0.01"
I = L.TemplateIndex(L.TEMPLATES)


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    run = rng.integers(1, 50, L.GRAM + L.WINDOW - 1)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(50, 99, 9), run, rng.integers(50, 99, 5)]) for _ in range(2))
        assert set(L.winnow(a)[1].tolist()) & set(L.winnow(b)[1].tolist())


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_each_template_in_a_text(name):
    text = f"Über all. Some words (c) 2020, {L.TEMPLATES[name].upper()}; more words. "
    got = I.scan(text)
    assert [m.license for m in got] == [name]
    m = got[0]
    assert m.coverage == 1 and text[m.start : m.end] == L.WORD_IN.search(text[m.start :])[0] + text[m.start : m.end][len(L.WORD_IN.search(text[m.start :])[0]) :]
    assert text[m.start : m.end].rstrip(".") == L.TEMPLATES[name].upper().rstrip(".")


def test_changed_text():
    words = L.TEMPLATES["MIT (text)"].split()
    words[10:12] = ["changed", "some", "words"]
    del words[40]
    m = I.scan("x " * 30 + " ".join(words) + " y" * 30)
    assert [x.license for x in m] == ["MIT (text)"] and 0.9 < m[0].coverage < 1


@pytest.mark.parametrize("text", [None, "", "the license", "under the MIT", "public software is free and released"])
def test_nothing(text):
    assert I.scan(text) == []


def test_documents_against_plain_search(spark):
    want = set()
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    for r in docs:
        for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"):
            for m in re.finditer(re.escape(L.TEMPLATES[name]), r.text):
                want.add((r.doc_id, name, m.start(), m.end()))
    got = {(r.doc_id, r.license, r.start, r.end) for r in L.op6_licenses(spark, D).collect()}
    assert want and want <= got
    assert len(got - want) <= 0.02 * len(want) + 1


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, L.TEMPLATES["MIT"]), (3, L.TEMPLATES["MIT"]), (None, "word " * 20000 + L.TEMPLATES["GPL-3.0"])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, start int")
    got = L.scan(df).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "GPL-3.0"), (3, "MIT"), (3, "MIT")]
    assert L.scan(df.limit(0)).count() == 0


def brute_copies(words, template):
    """Best local alignment over the whole text, without fingerprints or bands, again and again until none covers enough."""
    words, out = list(words), []
    while True:
        best, above = (0.0, 0, 0, 0), [(0.0, 0, 0)] * (len(words) + 1)
        for w in template:
            row = [(0.0, 0, 0)]
            for j, x in enumerate(words):
                decayed = (row[j][0] - L.GAP, row[j][1], row[j][2]) if row[j][0] > L.GAP else (0.0, 0, 0)
                here = max(above[j + 1], decayed)
                if x == w:
                    s, n, f = above[j]
                    for got in ([(s + 1, n - 1, f)] if s > 0 else []) + [(1.0, -1, j)]:
                        if got > here:
                            here = got
                            if (got[0], -j) > (best[0], -best[3]):
                                best = (got[0], -got[1], got[2], j)
                row.append(here)
            above = row
        _, n, a, b = best
        if n < L.COVERAGE * len(template) or n < L.DENSITY * (b - a + 1):
            return sorted(out)
        out.append((n, a, b))
        words[a : b + 1] = [None] * (b - a + 1)


@pytest.mark.parametrize("copies", [1, 3, 50, 3000])
@pytest.mark.parametrize("name", ["MIT", "CC-BY-SA-4.0", "MPL-2.0 (notice)"])
def test_every_copy_has_its_own_span(name, copies):
    text = (L.TEMPLATES[name] + ". ") * copies
    got = I.scan(text)
    assert len(got) == copies and all(m.license == name and m.coverage == 1 for m in got)
    assert all(text[m.start : m.end].rstrip(".") == L.TEMPLATES[name].rstrip(".") for m in got)


def test_against_a_brute_alignment():
    """Copies whole, changed and cut, back to back or apart: the same matches as the brute alignment of each template."""
    rng = np.random.default_rng(8)
    names = ["MIT", "MPL-2.0 (notice)", "GPL (notice)", "ISC (text)"]
    for case in range(40):
        words = []
        for _ in range(rng.integers(1, 5)):
            t = L.TEMPLATES[names[rng.integers(len(names))]].split()
            kind = rng.integers(4)
            if kind == 1 and len(t) > 12:
                t[len(t) // 2] = "changed"
            elif kind == 2 and len(t) > 12:
                del t[len(t) // 2 : len(t) // 2 + 2]
            elif kind == 3:
                t = t[: len(t) // 2]
            words += [*t, *(["filler"] * rng.integers(0, 3))]
        text = " ".join(words)
        ids = np.array([I.vocabulary.get(w, 0) for w in L.WORD.findall(text.encode().lower())], np.int64)
        seeds = I.seeds(ids)
        for name in names:
            t = I.names.index(name)
            assert sorted(I.copies(ids, t, seeds.get(t, []))) == brute_copies(ids.tolist(), I.tokens[t].tolist()), (case, name)
