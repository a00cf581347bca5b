"""SimHash near-duplicates: fingerprints, Golay-code fuzzy keys, verified links, components."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import Written, give_back, read_table, slices, write_table
from attestor.llm.components import connected_components

SEED = 42
#: Bits of the three segments of a fingerprint. Any 4 errors leave two segments with at most one error each, or
#: one segment with none and two errors in each of the others.
SEGMENTS = (21, 21, 22)
MAX_BITS = 4
#: Words of 64 bits of a wide fingerprint: all but two give keys. Those two go with each key: the last names the document,
#: and documents that share a key are linked by the bits of both, in TIERS from near to far.
LANES, TIERS = 5, (6, 10, 14, 18, 22, 27)
#: Bits of 320 in which wide fingerprints of two texts may differ: what a similarity of 0.8 of their shingles gives, as
#: a rule (a cosine of some 0.88 of the shingle vectors).
WIDE_BITS = 52


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further hashes from one: its sum with a constant for each lane, stirred."""
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(data: bytes | None, words: int = 4, lanes: int = 1) -> list[int]:
    """SimHash of the word shingles of a text, 64 bits for each lane; the first is that of XXH64 itself. Only A-Z are
    lower-cased; bytes.split() splits at just the ASCII white space. Null and empty texts give 0; fewer words than a
    shingle form one shingle."""
    norm = b" ".join(data.lower().split()) if data else b""
    if not norm:
        return [0] * lanes
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) < words:
        one = np.array([digest(norm, SEED)], np.uint64)
        return [int((_mixed(one, k) if k else one)[0]) for k in range(lanes)]
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(norm)][words - 1 :]
    total, n = np.zeros((lanes, 64), np.int64), len(ends)
    for at in range(0, n, 1 << 14):
        some = np.array([digest(norm[a:b], SEED) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], np.uint64)
        for k in range(lanes):
            bits = np.unpackbits((_mixed(some, k) if k else some).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprint(data: bytes | None, words: int = 4) -> int:
    """The first 64 bits of wide_fingerprint()."""
    return wide_fingerprint(data, words)[0]


def fingerprints(docs: DataFrame, carried: list[Column], text: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed long; of a wide one fp is the last lane and lane0, lane1
    and so on are the others. One scan, no shuffle."""
    rows = docs.select(*carried, F.col(text).alias("text"))
    kept, names = rows.schema[:-1], [*(f"lane{k}" for k in range(lanes - 1)), "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([wide_fingerprint(x, words, lanes) for x in b.columns[-1].cast(pa.binary()).to_pylist()], np.uint64).view(np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(fps[:, k]) for k in range(lanes))], [*(f.name for f in kept), *names])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} long" for n in names)]))


@functools.cache
def golay_patterns() -> np.ndarray:
    """For each of the 2048 syndromes of the (23, 12) Golay code the error patterns of weight 4 or less: one, or one
    of weight 3 and five of weight 4. Rows with one pattern are filled up with it."""
    weights = [sum(1 << i for i in c) for w in range(5) for c in combinations(range(23), w)]
    pats = np.array(weights, np.uint32)
    out, filled = np.zeros((2048, 6), np.uint32), np.zeros(2048, int)
    for p, s in zip(pats.tolist(), syndrome(pats).tolist()):
        out[s, filled[s]] = p
        filled[s] += 1
    assert set(filled) == {1, 6}
    out[filled == 1] = out[filled == 1][:, :1]
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""
    r = words.astype(np.uint32)
    for i in range(22, 10, -1):
        r ^= ((r >> np.uint32(i)) & np.uint32(1)) * np.uint32(0xC75 << (i - 11))
    return r


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): the 12-bit indices of the codewords within distance 4, nearest first. Words within distance 2 share an
    index; the nearest codeword of a word is among the indices of every word at distance 1."""
    return (words.astype(np.uint32)[:, None] ^ golay_patterns()[syndrome(words)]) >> np.uint32(11)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for uint64 fingerprints: two that differ in 4 bits or fewer share a key."""
    shifts = (0, SEGMENTS[0], SEGMENTS[0] + SEGMENTS[1])
    seg = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.uint32) for s, n in zip(shifts, SEGMENTS)]
    idx = [golay_indices(s).astype(np.int64) for s in seg]
    new = [np.concatenate([np.ones((len(fps), 1), bool), i[:, 1:] != i[:, :1]], axis=1) for i in idx]
    row = np.broadcast_to(np.arange(len(fps))[:, None], (len(fps), 6))
    rows, keys = [], []

    def put(family: int, high: np.ndarray, low: np.ndarray, keep: np.ndarray) -> None:
        k = (np.int64(family) << 40) | (high << 12) | low
        rows.append(row[keep])
        keys.append(np.broadcast_to(k, row.shape)[keep])

    later = [n & (np.arange(6) > 0) for n in new]
    for f, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):  # at most one error in each of the two
        put(f, idx[i], idx[j][:, :1], new[i])
        put(f, idx[i][:, :1], idx[j], later[j])
    for i in range(3):  # no error in one, at most two in the next
        j = (i + 1) % 3
        put(3 + i, seg[i].astype(np.int64)[:, None], idx[j], new[j])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each lane but the last, or of the fingerprint itself where there are none, with the last lane and the
    fingerprint; which lane it is is part of the key."""
    for b in batches:
        *lanes, fps = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        for at in range(0, len(fps), 4096):
            part = slice(at, at + 4096)
            for k, lane in enumerate(lanes[:-1] or [fps]):
                rows, keys = fuzzy_keys(lane[part].view(np.uint64))
                with_key = [x[part][rows] for x in (*lanes[-1:], fps)]
                yield pa.RecordBatch.from_arrays([pa.array(keys | np.int64(k << 44)), *map(pa.array, with_key)], ["key", *["more"] * bool(lanes), "fp"])
    give_back()


def links_in_runs(keys: np.ndarray, fps: np.ndarray, tiers: tuple[int, ...] = (MAX_BITS,), more: np.ndarray | None = None) -> np.ndarray:
    """Rows sorted by key -> (m, 2) verified links that connect all that pairs with an equal key connect. Pairs that
    links found before already connect are skipped, so a run of n fingerprints gives about n links, not n squared.
    With several tiers the links of fewer bits are found first, so those kept are the shortest, as a rule. ``more``: further
    64 bits of each fingerprint."""
    u, first, node = np.unique(fps, return_index=True, return_inverse=True)
    wide = [x.view(np.uint64) for x in ([u] if more is None else [u, more[first]])]
    parent = np.arange(len(u))
    found: list[np.ndarray] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = parent.copy()
    for max_bits in tiers:
        label = _tier(keys, u, wide, node, parent, label, max_bits, root, found)
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _tier(keys, u, wide, node, parent, label, max_bits, root, found) -> np.ndarray:
    """Adds to ``found`` the links of at most so many bits; returns the labels of what is connected now."""
    off, at = 1, np.flatnonzero(keys[1:] == keys[:-1])
    while at.size:
        a, b = node[at], node[at + off]
        m = label[a] != label[b]
        a, b = a[m], b[m]
        m = sum(np.bitwise_count(x[a] ^ x[b]) for x in wide) <= max_bits
        links = []
        for x, y in zip(a[m].tolist(), b[m].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                links.append((x, y))
        if links:
            found.append(u[np.array(links)])
            label = parent
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            parent[:] = label
            label = label.copy()
        off += 1
        at = at[at + off < len(keys)]
        at = at[keys[at + off] == keys[at]]
    return label


def _link(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...] = (MAX_BITS,)) -> Iterator[pa.RecordBatch]:
    """Streams a partition sorted by key; a run of one key is never cut."""

    def out(rows: np.ndarray) -> pa.RecordBatch:
        e = links_in_runs(rows[0], rows[-1], tiers, rows[1] if len(rows) > 2 else None)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    parts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        parts.append(np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        held += batch.num_rows
        if held >= 1 << 17:
            rows = np.concatenate(parts, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if cut:
                yield out(rows[:, :cut])
            parts, held = [rows[:, cut:].copy()], rows.shape[1] - cut
    if held:
        yield out(np.concatenate(parts, axis=1))
    parts.clear()
    give_back()


def _components(fp: DataFrame, least: Column) -> DataFrame:
    """fp, least: for each distinct fingerprint the least value of ``least`` in its component. Tables that only this
    step reads are dropped.

    Plain fingerprints are linked by MAX_BITS. Wide ones are met by the keys of their lanes, and linked where all lanes
    together differ in WIDE_BITS or fewer; those whose last lane is equal are one node. Of what shares a key the nearest
    pairs are verified, as many as connect it, and not all pairs."""
    lanes = [c for c in fp.columns if c.startswith("lane")]
    nodes = Written(fp.groupBy("fp").agg(F.min(least).alias("least"), *([F.min(F.struct(*lanes)).alias("wide")] if lanes else [])), "fp-nodes")
    tiers = TIERS if lanes else (MAX_BITS,)
    keyed = nodes.df.select(*(f"wide.{c}" for c in lanes), "fp").mapInArrow(_keyed, "key long, more long, fp long" if lanes else "key long, fp long")
    edges = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: _link(b, tiers), "a long, b long")
    if lanes:
        met = Written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fp-met")
        one, two = (nodes.df.select(F.col("fp").alias(x), F.col("wide").alias(f"w{x}")) for x in "ab")
        bits = sum((F.bit_count(F.col(f"wa.{c}").bitwiseXOR(F.col(f"wb.{c}"))) for c in lanes), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
        edges = met.df.join(one, "a").join(two, "b").where(bits <= WIDE_BITS).select("a", "b")
    roots = connected_components(edges)
    # Only nodes with links need their component's smallest row; the others are their own component.
    own = F.coalesce("root", "fp").alias("root")
    linked = Written(nodes.df.join(roots.df.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", own, "least"), "fp-roots")
    top = Written(linked.df.groupBy("root").agg(F.min("least").alias("least")), "component-min")
    named = Written(linked.df.select("fp", "root").join(top.df, "root").select("fp", "least"), "fp-components")
    for t in (nodes, roots, linked, top, *([met] if lanes else [])):
        t.drop()
    return named.df


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of 4 bits or fewer).

    One row for each input row. Null and empty texts have fingerprint 0 and link like any other; equal fingerprints
    are one node, so thousands of copies cost one row each and no pairs. An empty table gives an empty result; other
    columns are ignored; null doc_ids keep their row and never name a component unless all of it is null."""
    fp = Written(fingerprints(docs, [F.col("doc_id").cast("long").alias("doc_id")], text, words), "fingerprints")
    named = _components(fp.df, F.col("doc_id"))
    return fp.df.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


#: Names of row_key().
KEY = ["k1", "k2", "none", "id"]


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Two hashes of the text and the doc_id, null or not: never null, so rows meet by plain equality."""
    id_ = F.col(doc_id).cast("long")
    cols = [F.xxhash64(text), F.xxhash64(text, F.lit("second")), id_.isNull(), F.coalesce(id_, F.lit(0))]
    return [c.alias(name) for c, name in zip(cols, KEY)]


def repeated_keys(docs: DataFrame, text: str = "text", words: int = 5, lanes: int = LANES) -> DataFrame:
    """The row_key() of every row but that which stands for its component, as a written table without repeats. Texts are
    linked whose shingles of five words are similar by 0.8 or more, as their wide fingerprints tell (WIDE_BITS of 320
    bits differ at most); with one lane those whose plain fingerprints differ in MAX_BITS at most.

    The key that stays has the least doc_id, nulls last, then the least hashes. Different texts with the same doc_id,
    or with none, are different keys; rows with the same text and doc_id share one. Nothing wider than keys and
    fingerprints is moved; an empty table gives an empty result."""
    fp = Written(fingerprints(docs, row_key(text), text, words, lanes), "fingerprints")
    own = F.struct("none", "id", "k1", "k2")
    gone = fp.df.join(_components(fp.df, own), "fp").where(own != F.col("least")).select(*KEY).distinct()
    out = write_table(gone, "near-gone")
    fp.drop()
    return out


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
