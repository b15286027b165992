"""SentencePiece encoding and decoding, by the method that the model file names.

A BPE model's scores are ranks of merges, so a chunk's characters are merged in their order (MergePieces): a Viterbi over
such scores gives other ids than the model's. For a unigram model an Aho-Corasick automaton over the pieces drives a
one-pass Viterbi (Pieces): at each character the automaton's state gives the longest piece that ends there, and output links lead to the
shorter ones; each relaxes the best score of its end from the best score of its start. No piece reaches over
the start of a run of blanks, so the lattice falls into independent chunks (a run of blanks and the word after
it), whose segmentations a worker keeps in a bounded table. Characters without a piece fall back to bytes.

A model file is read on the driver and broadcast (its size is checked); it is never trained here.
Only the identity normaliser is supported. A literal U+2581 is written as bytes, so decoding gives back every text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_MODEL_BYTES = 64 << 20
KEPT_CHUNKS, LONG_CHUNK = 200_000, 48
SPACE = "▁"
# Fixed values of the model file's format: piece types.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
# Model types.
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(data, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Automaton:
    """Trie with failure and output links. A state's own piece, if any, is the longest that ends there."""

    def __init__(self, pieces: list[tuple[str, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.piece, self.depth = [-1], [0]
        for text, i in pieces:
            state = 0
            for ch in text:
                to = self.next[state].get(ch)
                if to is None:
                    to = self.next[state][ch] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                    self.depth.append(self.depth[state] + 1)
                state = to
            self.piece[state] = i
        self.fail, self.out = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for ch, to in self.next[state].items():
                self.fail[to] = self.step(self.fail[state], ch)
                queue.append(to)
            back = self.fail[state]
            self.out[state] = back if self.piece[back] >= 0 else self.out[back]

    def step(self, state: int, ch: str) -> int:
        while (to := self.next[state].get(ch)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return to


class Pieces:
    def __init__(self, data: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix = True
        for field, value in _fields(data):
            if field == 1:
                one = dict(_fields(value))
                self.text.append(one[1].decode())
                self.score.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, NORMAL))
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(1, b"identity") != b"identity" or norm.get(2) or norm.get(4):
                    raise ValueError("only the identity normaliser is supported")
                self.dummy_prefix = bool(norm.get(3, 1))
        kinds = self.kinds
        self.unknown = kinds.index(UNKNOWN)
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == BYTE}
        plain = self.plain = [(t.replace(SPACE, " "), i) for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k in (NORMAL, USER_DEFINED)]
        self.fallback = min(self.score) - 10
        self.out_bytes = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() if k in (NORMAL, USER_DEFINED) else b"" for t, k in zip(self.text, kinds, strict=True)]
        # A chunk may end before a blank, and around a line end, if no piece reaches over that place.
        if any(" " in t.lstrip(" ") for t, _ in plain):
            raise ValueError("a piece goes on over a blank")
        alone = not any("\n" in t and t != "\n" for t, _ in plain)
        self.chunks = re.compile(r"\n+| *[^ \n]+| +" if alone else r" *[^ ]+| +")
        self.kept: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.plain)

    def _units(self, chunk: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte.get(b, self.unknown) for b in chunk.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def segment(self, chunk: str) -> list[int]:
        return self.viterbi(chunk)

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation; among equal scores the longer last piece wins."""
        auto, score = self.automaton, self.score
        piece, depth, out = auto.piece, auto.depth, auto.out
        best, back, state = [0.0], [(0, -1)], 0
        for end, ch in enumerate(chunk, 1):
            state = auto.step(state, ch)
            top, come, single = -np.inf, (end - 1, -1), False
            at = state if piece[state] >= 0 else out[state]
            while at:
                start = end - depth[at]
                single = depth[at] == 1
                if (value := best[start] + score[piece[at]]) > top:
                    top, come = value, (start, piece[at])
                at = out[at]
            if not single and (value := best[end - 1] + self.fallback) > top:
                top, come = value, (end - 1, -1)
            best.append(top)
            back.append(come)
        found, end = [], len(chunk)
        while end:
            start, i = back[end]
            found.append([i] if i >= 0 else self._units(chunk[start]))
            end = start
        return [i for ids in reversed(found) for i in ids]

    def _chunk(self, chunk: str) -> bytes:
        ids = self.kept.get(chunk)
        if ids is None:
            ids = array("i", self.segment(chunk)).tobytes()
            if len(chunk) <= LONG_CHUNK:
                if len(self.kept) >= KEPT_CHUNKS:
                    self.kept.clear()
                self.kept[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = self.chunks.findall(" " + text if self.dummy_prefix else text)
        get = self.kept.get
        return np.frombuffer(b"".join([get(c) or self._chunk(c) for c in chunks]), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        table = self.out_bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class MergePieces(Pieces):
    """A BPE model: of all neighbours whose union is a piece, those of the best score, then the leftmost, merge first."""

    def __init__(self, data: bytes):
        super().__init__(data)
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces of BPE models are not supported")
        self.ids = dict(self.plain)

    def segment(self, chunk: str) -> list[int]:
        ids, score, n = self.ids, self.score, len(chunk)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is named by its start; stop 0: merged away
        heap = [(-score[i], k, k + 2) for k in range(n - 1) if (i := ids.get(chunk[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, a, c = heappop(heap)
            b = stop[a]
            if not b or b >= n or stop[b] != c:
                continue
            stop[a], stop[b] = c, 0
            if c < n:
                before[c] = a
                if (i := ids.get(chunk[a : stop[c]])) is not None:
                    heappush(heap, (-score[i], a, stop[c]))
            if (left := before[a]) >= 0 and (i := ids.get(chunk[left:c])) is not None:
                heappush(heap, (-score[i], left, c))
        out, a = [], 0
        while a < n:
            i = ids.get(chunk[a : stop[a]])
            out += self._units(chunk[a]) if i is None else [i]
            a = stop[a]
        return out


def made(data: bytes) -> Pieces:
    """The model with the method of its type."""
    kind = next((dict(_fields(v)).get(3, UNIGRAM) for field, v in _fields(data) if field == 2), UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return MergePieces(data) if kind == BPE else Pieces(data)


_loaded: dict[str, Pieces] = {}


def _pieces(data: bytes) -> Pieces:
    """One model a worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = made(data)
    return _loaded[key]


def load(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read on the driver."""
    with open(path, "rb") as f:
        data = f.read(MOST_MODEL_BYTES + 1)
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"a model file has at most {MOST_MODEL_BYTES} bytes")
    return data


def _mapped(df: DataFrame, new: dict[str, T.DataType], work) -> DataFrame:
    """df with the columns new (replaced if there) from work, which yields parts of a batch with their new columns."""
    low = {x.lower() for x in new}
    kept = [c for c in df.columns if c.lower() not in low]
    schema = T.StructType([*df.select(*map(quoted, kept)).schema.fields, *[T.StructField(n, kind) for n, kind in new.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in work(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in kept], *made], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text (null for null, empty for empty), and, if a name is given for it, the text
    that they decode to. Existing columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        pieces = _pieces(shared.value)
        for part in slices(batch, text):
            found = [None if t is None else pieces.encode(t) for t in part.column(text).to_pylist()]
            lengths = np.cumsum([0, *[0 if x is None else len(x) for x in found]]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *[x for x in found if x is not None]])
            made = [pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in found]))]
            if decoded:
                made.append(pa.array([None if x is None else pieces.decode(x.tolist()) for x in found], pa.string()))
            yield part, made

    return _mapped(docs, {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {}), work)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of each row's ids (null for null); an existing column of that name is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        pieces = _pieces(shared.value)
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            lists = part.column(ids)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            good = lists.is_valid().to_pylist()
            texts = [pieces.decode(values[offsets[i] : offsets[i + 1]].tolist()) if good[i] else None for i in range(len(lists))]
            yield part, [pa.array(texts, pa.string())]

    return _mapped(encoded, {text: T.StringType()}, work)


def digest(docs: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """Per row: doc_id, n_chars, n_pieces, ids_hash (xxhash64 of the ids) and round_trip."""
    back = encode(docs.select("doc_id", "text"), load(path), decoded="decoded")
    return back.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))
