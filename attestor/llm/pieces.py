"""SentencePiece encoding and decoding for merge-type vocabularies with a score-ordered agenda."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import read_table, slices

SPACE = "▁"


class PieceCodec:
    """Encoder and decoder of one model file, with no state of the library's own encoder.

    Covers merge-type models with identity normalisation, a dummy prefix, escaped white space and byte fallback; the
    constructor checks what it can see of that against the library. ``check_new`` compares each batch of words seen
    for the first time with the library and raises where they differ."""

    #: Words in a generation of a worker's memo (it holds two). Characters up to which the agenda is a flat list.
    MEMO, FLAT = 200_000, 48

    def __init__(self, model_file: str):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.text_of = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not covered")
        self.id_of = {p: i for i, (p, s) in enumerate(zip(self.text_of, special)) if not s}
        self.cost = {p: -sp.get_score(i) for p, i in self.id_of.items()}
        self.bytes_of = {i: int(self.text_of[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        if len(self.byte_id) != 256:
            raise ValueError("only models with byte fallback are covered")
        self.surface = [p.replace(SPACE, " ") for p in self.text_of]
        for i in range(n):
            if sp.is_control(i):
                self.surface[i] = ""
            elif sp.is_unknown(i):
                self.surface[i] = " ⁇ "
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("only models whose pieces do not cross white space are covered")
        # Neighbouring characters that no piece holds: no merge ever crosses them.
        self.inside = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        self.number = [str(i) for i in range(n)]
        self.ids: dict[str, str] = {}
        self.old: dict[str, str] = {}  # the generation before, of which words in use come over
        self.odd: dict[str, str] = {}  # words that are not decoded to a blank and themselves, and to what
        self.part: dict[str, list[int]] = {}

    def agenda(self, text: str) -> list[int]:
        """Best-scored adjacent pair first, leftmost of equal ones; entries whose symbols have changed are stale."""
        cost, n = self.cost, len(text)
        sym: list[str] = list(text)
        if n <= self.FLAT:
            return self._flat(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            if (c := cost.get(pair)) is not None:
                heap.append((c, i, i + 1, pair))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, j, pair = pop(heap)
            if not sym[i] or right[i] != j or len(sym[i]) + len(sym[j]) != len(pair):
                continue
            sym[i], sym[j] = pair, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                both = pair + sym[k]
                if (c := cost.get(both)) is not None:
                    push(heap, (c, i, k, both))
            h = left[i]
            if h >= 0:
                both = sym[h] + pair
                if (c := cost.get(both)) is not None:
                    push(heap, (c, h, i, both))
        out: list[int] = []
        for s in sym:
            if s:
                out += self._id(s)
        return out

    def _flat(self, sym: list[str]) -> list[int]:
        """The agenda of a short stretch: a list of the pairs' costs in place, searched for its first least entry."""
        get, none = self.cost.get, float("inf")
        costs = [get(a + b, none) for a, b in zip(sym, sym[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(sym[i] + sym[i + 1], none)
            if i:
                costs[i - 1] = get(sym[i - 1] + sym[i], none)
        try:
            return [self.id_of[x] for x in sym]
        except KeyError:
            return [i for x in sym for i in self._id(x)]

    def _id(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [i] if i is not None else [self.byte_id[b] for b in piece.encode()]

    def unit(self, text: str) -> list[int]:
        """Ids of a stretch that starts with white space (or follows none): agendas between the hard boundaries."""
        if text[1:].isalpha():
            return self._part(text)
        inside, at, out = self.inside, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                out += self._part(text[at:i])
                at = i
        return out + self._part(text[at:]) if at else self._part(text)

    def _part(self, text: str) -> list[int]:
        got = self.part.get(text)
        if got is None:
            got = self.agenda(text)
            if len(text) <= 32:
                if len(self.part) >= self.MEMO:
                    self.part.clear()
                self.part[text] = got
        return got

    def words(self, text: str) -> list[str]:
        """The text as words, each standing for its own white-space mark and what follows it."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or SPACE in text:
            marked = SPACE + text.replace(" ", SPACE)
            words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]
        return words

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.unit(SPACE + w)]

    def compared(self, text: str) -> list[int]:
        """encode(), after a comparison of the whole text with the library."""
        own = self.encode(text)
        if own != self.library.encode(text, num_threads=1):
            raise RuntimeError(f"encoding of {text[:80]!r} differs from the library's")
        return own

    def pieces_text(self, ids: list[int]) -> str:
        """Pieces joined; runs of byte pieces are decoded together, bad ones as U+FFFD each."""
        if self.bytes_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held = bytearray()
            if i >= 0:
                out.append(self.surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Inverse of encode(): the dummy prefix goes."""
        return self.pieces_text(ids).removeprefix(" ")

    def learn(self, words: list[str]) -> None:
        """Memoises words, after one comparison of the whole batch with the library."""
        theirs = self.library.encode(words, num_threads=1)
        for w, expected in zip(words, theirs):
            own = self.unit(SPACE + w)
            if own != expected and w:
                raise RuntimeError(f"encoding of {w[:80]!r} differs from the library's")
            self.ids[w] = ",".join([self.number[i] for i in own])
            if (back := self.pieces_text(own)) != " " + w:
                self.odd[w] = back

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, SHA-256 of the comma-joined ids, SHA-256 of the decoded text."""
        words = self.words(text)
        distinct = set(words)
        if len(distinct) > self.MEMO:  # a very long text goes without the memo of words
            all_ids = self.compared(text)
            return len(all_ids), _sha(",".join(map(str, all_ids))), _sha(self.decode(all_ids))
        ids = self.ids
        if missing := [w for w in distinct if w not in ids]:
            if len(ids) + len(missing) > self.MEMO:
                self.odd = {w: back for w, back in self.odd.items() if w in ids}
                self.old, self.ids, missing = ids, {}, distinct
            ids, old, new = self.ids, self.old, []
            for w in missing:
                if (known := old.get(w)) is None:
                    new.append(w)
                else:
                    ids[w] = known
            if new:
                self.learn(new)
        joined = ",".join(map(self.ids.__getitem__, words))
        if not self.odd or self.odd.keys().isdisjoint(distinct):
            back = " ".join(words)
        else:
            back = "".join([self.odd.get(w) or " " + w for w in words]).removeprefix(" ")
        return (joined.count(",") + 1 if joined else 0), _sha(joined), _sha(back)


def _utf8(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is not part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + _utf8(raw[e.start + 1 :])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each model and worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _by_text(df: DataFrame, text: str, fields: list[tuple[str, pa.DataType, str]], per_text, replace: bool = False) -> DataFrame:
    """Adds fields made from each text in Arrow batches; other columns pass unchanged."""
    names = [c for c in df.columns if c not in {f for f, _, _ in fields}]
    types = dict(df.dtypes)
    at = names.index(text)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [f"`{f}` {s}" for f, _, s in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [per_text(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, (_, t, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, *(f for f, _, _ in fields)])

    return df.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", model_file: str | None = None, out: str = "ids") -> DataFrame:
    """Adds ``out``, array<int>: the ids of each whole text, compared with the library's; a difference stops the job. Null
    and empty texts give an empty array."""
    model = model_file or default_model()
    return _by_text(df, text, [(out, pa.list_(pa.int32()), "array<int>")], lambda t: (codec(model).compared(t or ""),))


def decode(df: DataFrame, ids: str = "ids", model_file: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of each array of ids. Null arrays give an empty text."""
    model = model_file or default_model()
    return _by_text(df, ids, [(out, pa.string(), "string")], lambda i: (codec(model).decode(i or []),))


def with_digests(df: DataFrame, text: str = "text", model_file: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of every whole text, in one scan without a shuffle."""
    model = model_file or default_model()
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _by_text(df, text, fields, lambda t: codec(model).digest(t or ""))


def token_digests(df: DataFrame, text: str = "text", model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row.

    Null texts count as empty (no ids). Each row is on its own: repeated rows, ties and empty tables need no care;
    columns other than doc_id and the text are ignored."""
    return with_digests(df.select("doc_id", F.col(text).alias("__text")), "__text", model_file).drop("__text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))
