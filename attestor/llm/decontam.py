"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import Written, read_table, slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Most distinct test terms that are broadcast to the tasks as a set, which bounds it to some 100 MB. With more, every
#: token is indexed; the results are the same.
MAX_TERMS = 1_000_000


def words_of(data: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters, digits and all other characters beyond ASCII. Null has none."""
    return WORD.findall(data.lower()) if data else []


def phrases_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), words (array): each window of consecutive words; a shorter item is one phrase, an item
    without words none. Null ids count as the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = [x.decode() for x in words_of(t)]
                for at in range(max(1, len(w) - window + 1) if w else 0):
                    ids.append(i or "")
                    found.append(w[at : at + window])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(found, pa.list_(pa.string()))], ["item_id", "words"]
            )

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, words array<string>")


def _in_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """True where a run of at least so many true values stands."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    out = np.zeros(len(mask), bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= least:
            out[a:b] = True
    return out


def build_index(docs: DataFrame, vocabulary: Broadcast | None, least: int = 1, short: tuple[Broadcast, int] | None = None) -> DataFrame:
    """doc_id (as it is given), n_words, terms, positions: the postings of each document, one entry for each token kept.

    Kept are tokens of the vocabulary (a broadcast set) that stand in a run of at least ``least`` such tokens (``short``: a second
    vocabulary with its own run length); a phrase of that many words can stand nowhere else. No vocabulary keeps
    every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, few = vocabulary and vocabulary.value, short and short[0].value
        for b in slices(batches):
            n_words, terms, positions = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                w = words_of(t)
                n_words.append(len(w))
                if known is None:
                    at = range(len(w))
                else:
                    keep = _in_runs(np.fromiter((x in known for x in w), bool, len(w)), least)
                    if few:
                        keep |= _in_runs(np.fromiter((x in few for x in w), bool, len(w)), short[1])
                    at = np.flatnonzero(keep).tolist()
                terms.append([w[i].decode() for i in at])
                positions.append(list(at))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(positions, pa.list_(pa.int32()))],
                ["doc_id", "n_words", "terms", "positions"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, terms array<string>, positions array<int>"
    )


def _spans(at: dict[int, str], where: dict[str, list[int]], words: list[str], starts: list[int], slop: int) -> list[tuple[int, int]]:
    """Occurrences among the candidate starts: words in order, with at most ``slop`` other words between them."""
    if not slop:
        return [(s, s + len(words)) for s in starts if all(at.get(s + k) == w for k, w in enumerate(words))]
    found = set()
    for s in starts:
        for first in (p for p in where.get(words[0], ()) if s - slop <= p <= s + slop):
            last = first
            for w in words[1:]:
                last = min((p for p in where.get(w, ()) if p > last), default=None)
                if last is None or last - first >= len(words) + slop:
                    break
            else:
                found.add((first, last + 1))
    return sorted(found)


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, matches: array of (start, end, items) in words, for every document.

    ``slop`` 0 finds exact phrases, more finds the words in order with so many others between them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("items", pa.list_(pa.string()))]))
    fields = [("matches", kind, "array<struct<start: int, end: int, items: array<string>>>")]
    return _search(docs, items, window, slop, fields, lambda hits: ([{"start": s, "end": e, "items": i} for s, e, i in hits],))


def _search(docs: DataFrame, items: DataFrame, window: int, slop: int, fields: list[tuple[str, pa.DataType, str]], per_document) -> DataFrame:
    """doc_id, n_words and the fields made of the hits (start, end, items) of each document.

    The training tokens' postings are stored as a table in the shared folder. Each test phrase is looked up by its
    rarest term (by postings in that table); the offset-adjusted positions of that term are candidate starts, which
    are intersected with the postings of the phrase's other terms, document by document."""
    phrases = Written(phrases_of(items, window).groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    long_, short = [
        phrases.df.where(F.size("words") == window if full else F.size("words") < window) for full in (True, False)
    ]
    terms = [x.select(F.explode("words").alias("term")).distinct() for x in (long_, short)]
    few = sum(x.count() for x in terms) <= MAX_TERMS
    shortest = short.agg(F.min(F.size("words"))).first()[0] or 1
    send = docs.sparkSession.sparkContext.broadcast
    v_long, v_short = [{r.term.encode() for r in x.toLocalIterator()} if few else None for x in terms]
    if slop and few:
        v_long, v_short, window_run, shortest = v_long | v_short, set(), 1, 1
    else:
        window_run = window
    index = Written(
        build_index(docs, send(v_long) if few else None, window_run, (send(v_short), shortest) if few else None).withColumn("rid", F.monotonically_increasing_id()),
        "postings",
    )
    postings = index.df.select("rid", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select("rid", F.col("p.terms").alias("term"), F.col("p.positions").alias("pos"))
    counts = Written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    at = phrases.df.select("phrase", "words", F.posexplode("words").alias("off", "term")).join(counts.df, "term")
    # The rarest term of each phrase all of whose terms have postings.
    anchors = Written(
        at.groupBy("phrase").agg(F.min_by(F.struct("term", "off"), F.struct("n", "off")).alias("a"), F.count(F.lit(1)).alias("have"), F.first(F.size("words")).alias("need"))
        .where("have = need").select("phrase", F.col("a.term").alias("term"), F.col("a.off").alias("off")),
        "anchors",
    )
    starts = (
        postings.join(anchors.df, "term").select("rid", "phrase", (F.col("pos") - F.col("off")).alias("start"))
        .where(F.col("start") >= -slop).groupBy("rid", "phrase").agg(F.collect_list("start").alias("starts"))
    )
    wanted = starts.join(phrases.df, "phrase").groupBy("rid").agg(F.collect_list(F.struct("words", "items", "starts")).alias("wanted"))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = []
            for terms, positions, wanted in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                hits = []
                if wanted:
                    at, where = dict(zip(positions, terms)), {}
                    for t, p in zip(terms, positions) if slop else ():
                        where.setdefault(t, []).append(p)
                    for x in wanted:
                        hits += [(s, e, x["items"]) for s, e in _spans(at, where, x["words"], x["starts"], slop)]
                found.append(per_document(hits))
            cols = [pa.array([f[i] for f in found], kind) for i, (_, kind, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "n_words", *(name for name, _, _ in fields)])

    return index.df.join(wanted, "rid", "left").select("doc_id", "n_words", "terms", "positions", "wanted").mapInArrow(
        intersect, ", ".join([f"doc_id {dict(index.df.dtypes)['doc_id']}", "n_words long", *(f"{name} {kind}" for name, _, kind in fields)])
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row for each document row.

    Null and empty texts have no words and are never contaminated; items without words match nothing; repeated rows
    each get their row; an empty table of items leaves every document clean; other columns are ignored. doc_id may be
    of any type (a struct of hashes where ids are null or repeat) and comes back as it is."""

    def digest(hits: list[tuple[int, int, list[str]]]) -> tuple[int, int, str, bool]:
        n, last = 0, 0
        for start, end, _ in sorted(hits, key=lambda h: h[0]):
            n += max(0, end - max(start, last))
            last = max(last, end)
        ids = sorted({i for _, _, found in hits for i in found})
        return n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0

    fields = [("n_hit", pa.int64(), "long"), ("n_items", pa.int64(), "long"), ("items_sha256", pa.string(), "string"), ("contaminated", pa.bool_(), "boolean")]
    return _search(docs, items, window, 0, fields, digest)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return contamination(docs, read_table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS b FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT id, n, array_to_string(list_slice(w, b, b + n - 1), ' ') AS t FROM s),
d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
x AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS b FROM d CROSS JOIN (SELECT DISTINCT n FROM p)),
m AS (SELECT DISTINCT doc_id, b, x.n, id FROM x JOIN p ON x.n = p.n AND array_to_string(list_slice(w, b, b + x.n - 1), ' ') = t),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + n)) AS pos FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT doc_id, id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""
