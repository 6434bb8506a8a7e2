"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are vocabulary entries as a
whole. It is a cascade of bit arrays: a key rests at the first level where no other key falls on its bit,
and its index is the rank of that bit. The entry's length and bytes then confirm the match.
Tier two: a miss starts as linked bytes; a heap gives the pair of lowest rank, leftmost first, until no
neighbouring pair is in the vocabulary.

Defined cases: null text is empty and has no ids; ids outside the vocabulary raise; an empty table gives an
empty result; other columns are ignored; repeated rows are rows like others.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauceda.llm.common import read_table, slices, utf8_column
from cauceda.llm.hashing import mix, ragged, same_spans, span_hashes
from cauceda.llm.pretokens import Encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Tokens by id, laid end to end, and the rank of each."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.by_id: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.by_id[rank] = token
        self.lengths = np.array([len(t) for t in self.by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.by_id), np.uint8)


class PerfectHash:
    """Index 0..n-1 for each of n distinct 64-bit keys, without gaps."""

    def __init__(self, keys: np.ndarray, spread: float = 1.5):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys are equal")
        self.levels, bits, base, left = [], [], 0, keys
        while len(left):
            size = int(len(left) * spread) + 1
            at = self._at(left, len(self.levels), size)
            held = np.bincount(at, minlength=size) == 1
            self.levels.append((base, size))
            bits.append(held)
            base += size
            left = left[~held[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits) - 1

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x1000001)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index where the key is one of the n; for any other key some index or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (base, size) in enumerate(self.levels):
            at = base + self._at(keys[left], level, size)
            held = self.bits[at]
            out[left[held]] = self.rank[at[held]]
            left = left[~held]
            if not len(left):
                break
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: linked bytes, merged by a heap of neighbouring pairs."""
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = []

    def push(a: int, b: int, end: int) -> None:
        rank = ranks.get(piece[a:end])
        if rank is not None:
            heapq.heappush(heap, (rank, a, b, end))

    for i in range(n - 1):
        push(i, i + 1, i + 2)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not (alive[a] and alive[b] and after[a] == b and after[b] == end):
            continue
        alive[b], after[a] = False, end
        if end < n:
            before[end] = a
            push(a, end, after[end])
        if before[a] >= 0:
            push(before[a], a, end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker, kept over its tasks."""
    words = vocabulary(path)
    known = np.flatnonzero(words.lengths > 0)
    keys = span_hashes(words.data, words.starts[known], words.starts[known] + words.lengths[known])
    perfect = PerfectHash(keys)
    order = np.empty(len(known), np.int64)
    order[perfect.index(keys)] = np.arange(len(known))
    key_at, id_at, length_at = keys[order], known[order], words.lengths[known][order]

    def whole(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = perfect.index(hashes)
        likely = np.flatnonzero((at >= 0) & (key_at[at] == hashes) & (length_at[at] == lengths))
        ids, out = id_at[at[likely]], np.full(len(at), -1, np.int64)
        same = same_spans(words.data, words.starts[ids], data, starts[likely], lengths[likely])
        out[likely[same]] = ids[same]
        return out

    return Encoder(lambda pieces: [merge(p, words.ranks) for p in pieces], whole, pattern)


def little_endian(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of each row's ids as little-endian unsigned 32-bit integers."""
    data = np.ascontiguousarray(ids, "<u4")
    offsets = np.append(0, np.cumsum(counts)).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit): ``ranks`` is a file on every machine."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for batch in slices(batches, "text", 2 << 20):
            ids, counts = own.encode(*utf8_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), little_endian(ids, counts)], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the bytes of its ids. A text's bytes are those it had."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields]
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        for batch in slices(batches, "ids", 2 << 20):
            data, offsets = utf8_column(batch.column(at))
            ids = np.frombuffer(data.tobytes(), "<u4")
            if len(ids) and ids.max() >= len(words.lengths):
                raise ValueError("an id is outside the vocabulary")
            sizes = words.lengths[ids]
            out = words.data[ragged(words.starts[ids], sizes)]
            ends = np.append(0, np.cumsum(sizes))[offsets // 4].astype(np.int64)
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.RecordBatch.from_arrays([*batch.columns, column.cast(pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*names, "decoded binary"]))


def op3_byte_bpe(spark, sf_dir):
    out = decode(encode(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
