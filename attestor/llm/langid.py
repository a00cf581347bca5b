"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import read_table, slices

#: N-grams in a profile, of a language and of a document. An n-gram absent from a language's profile is this far off.
PROFILE = 300
#: Characters counted at once: bounds the memory of very long texts.
BLOCK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for all that is not a letter."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the words, each with one blank before and after. Three code points of
    21 bits make one code; grams of blanks alone and those with an inner blank don't count."""
    empty = np.empty(0, np.int64)
    if not text:
        return empty, empty
    codes, counts = [], []
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - 2) : at + BLOCK]
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _letters()[raw]
        first, last = at == 0, at + BLOCK >= len(text)
        c = np.concatenate([[32] if first else [], c, [32] if last else []]).astype(np.int64)
        seen = 0 if first else 2  # characters that the block before has counted
        blank = c == 32
        one = c[seen:][~blank[seen:]]
        two = ((c[:-1] << 21) | c[1:])[max(0, seen - 1) :][~(blank[:-1] & blank[1:])[max(0, seen - 1) :]]
        three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        three = three[~(blank[1:-1] | (blank[:-2] & blank[2:] & blank[1:-1]))]
        u, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        codes.append(u)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    u, inv = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(inv, np.concatenate(counts)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code."""
    if len(codes) > 4 * size:
        keep = counts >= np.partition(counts, -size)[-size]
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Ranked n-grams of each language; languages in the order of their names."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.langs = size, sorted(ranked)
        self.table = {}
        for lang in self.langs:
            order = np.argsort(ranked[lang])
            self.table[lang] = ranked[lang][order], order.astype(np.int64)

    def distance(self, doc: np.ndarray, lang: str) -> int:
        """Sum over the document's n-grams of how far their ranks are out of place."""
        codes, rank = self.table[lang]
        at = np.minimum(np.searchsorted(codes, doc), max(0, len(codes) - 1))
        known = codes[at] == doc if len(codes) else np.zeros(len(doc), bool)
        apart = np.abs(np.arange(len(doc)) - rank[at]) if len(codes) else 0
        return int(np.where(known, np.minimum(apart, self.size), self.size).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the distance as a share of the largest possible; ties to the first name."""
        codes, counts = ngram_counts(text)
        if not len(codes):
            return "und", 0.0
        doc = top(codes, counts, self.size)
        if not self.langs:
            return "und", 0.0
        best, lang = min((self.distance(doc, x), x) for x in self.langs)
        return lang, 1.0 - best / (self.size * len(doc))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Counts n-grams over every labelled document that isn't held out; tasks send sums, never rows for each
    document. What reaches the driver is ``size`` rows for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}

        def rows() -> pa.RecordBatch:
            langs = pa.array([lang for lang, d in held.items() for _ in range(len(d))], pa.string())
            codes, sums = [np.fromiter(chain.from_iterable(x), np.int64) for x in (held.values(), (d.values() for d in held.values()))]
            held.clear()
            return pa.RecordBatch.from_arrays([langs, pa.array(codes), pa.array(sums)], ["lang", "code", "n"])

        for b in slices(batches):
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(ngram_counts(text))
                if len(by[lang]) >= 500:
                    _merge(held.setdefault(lang, {}), by.pop(lang))
            for lang, parts in by.items():
                _merge(held.setdefault(lang, {}), parts)
            if sum(map(len, held.values())) > 200_000:
                yield rows()
        if held:
            yield rows()

    sums = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
        .select("lang", "text").mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    # The ranks are cut in each task before the shuffle, so no task holds all n-grams of a language.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top: dict[str, list[int]] = {}
    for r in sorted(sums.withColumn("place", place).where(F.col("place") <= size).collect(), key=lambda r: r.place):
        top.setdefault(r.lang, []).append(r.code)
    return Profiles({lang: np.array(codes, np.int64) for lang, codes in top.items()}, size)


def _merge(into: dict[int, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)
    for c, n in zip(u.tolist(), sums.tolist()):
        into[c] = into.get(c, 0) + n


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Adds lang_pred and score to every row (they replace columns of these names); nothing but the text is read for
    them. Null texts and those without a letter get ``und`` and 0."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    types, at = dict(docs.dtypes), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [profiles.predict(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "lang_pred string", "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row for each row of docs.

    Learns from text and lang of the rows that aren't held out. Null doc_ids are not held out; null langs are only
    predicted; a table without a labelled row gives ``und`` throughout; other columns are ignored."""
    profiles = learn(docs, size)
    found = predict(docs.select(F.col("doc_id"), held_out().alias("held_out"), "text"), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
