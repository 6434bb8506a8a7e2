"""Best-fit packing of token pieces into sequences, by vectors of residual capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths of its
pieces). Pieces are cut so that each fits alone; a bin takes a piece only if no capacity is exceeded. Of
the bins that fit, ``dot`` takes the one whose residual vector, weighted, has the smallest dot product with
the piece's vector (the tightest along what the piece needs), ``norm`` the one that leaves the smallest
weighted norm. Pieces come by falling length. At the defaults, which op4 uses because its aim is the fewest
sequences, only tokens bind: 2048 pieces of a token or more fill 2048 tokens, and squares of lengths never sum to
more than the square of their sum. The other two capacities only tilt the choice by their weights there.

Spark deals the pieces to groups of ``group_tokens`` or ``group_rows`` on average, whichever gives more groups, by a
hash of each row's place in the written table, so that rows of one id or of none part too; groups are packed apart and
each leaves less than one sequence of slack or so. Only (id, piece, length) and the
caller's small columns are shuffled. Bins with equal residuals are interchangeable, so a group keeps stacks
of bins by residual vector and scores distinct vectors only.

Defined cases: null text is empty and makes one piece, the end mark alone; a document of more than
``tokens`` ids is cut so that all but its first piece are full; repeated rows are packed each; null ids are
kept; an empty table gives an empty result; other columns of the documents are ignored. The literal text of an
added token of the tokenizer, <|endoftext|>, is the one id of that token, as in the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauceda.llm.bpe import little_endian
from cauceda.llm.common import materialize, read_table, slices, utf8_column
from cauceda.llm.hashing import ragged
from cauceda.llm.pretokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


class Added:
    """Ids of texts that may hold added tokens: texts are cut at those, and what lies between goes to ``encoder``."""

    def __init__(self, encoder: Encoder, added: list[dict]):
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match by more than their content are not supported")
        self.encoder, self.ids = encoder, {x["content"].encode(): x["id"] for x in added}
        longest_first = sorted(self.ids, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest_first))) if added else None

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's count."""
        raw = data.tobytes()
        if not self.pattern or not self.pattern.search(raw):
            return self.encoder.encode(data, offsets)
        parts, special, inside = [], [], np.ones(len(offsets) - 1, np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for m in self.pattern.finditer(raw, a, b):
                parts.append(raw[a : m.start()])
                special.append((len(parts), self.ids[m[0]]))
                inside[i] += 1
                a = m.end()
            parts.append(raw[a:b])
        bounds = np.append(0, np.cumsum([len(x) for x in parts]))
        ids, counts = self.encoder.encode(np.frombuffer(b"".join(parts), np.uint8), bounds)
        sums = np.append(0, np.cumsum(counts))
        ids = np.insert(ids, sums[[k for k, _ in special]], [x for _, x in special]) if special else ids
        return ids, np.diff(sums[np.append(0, np.cumsum(inside))]) + inside - 1


@lru_cache(2)
def encoder(path: str) -> Added:
    """Ids by the tokenizers library with its default setting; each distinct pre-token is encoded once and kept."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    return Added(Encoder(lambda pieces: [x.ids for x in own.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]), added)


def cut(counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, piece, start and length of the pieces of documents of so many ids."""
    pieces = np.maximum(1, -(-counts // tokens))
    row = np.repeat(np.arange(len(counts)), pieces)
    piece = ragged(np.zeros(len(counts), np.int64), pieces)
    head = counts - (pieces - 1) * tokens
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * tokens)
    return row, piece, start, np.where(piece == 0, head[row], tokens)


def tokenize(docs: DataFrame, tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of every piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches, "text", 2 << 20):
            ids, counts = own.encode(*utf8_column(batch.column(1)))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            row, piece, start, length = cut(counts + 1, tokens)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), little_endian(ids, length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: float, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each length; bins are numbered from 0."""
    if len(lengths) and (lengths.max() > tokens or float(lengths.max()) ** 2 > cost or documents < 1):
        raise ValueError("a piece exceeds a capacity alone")
    full = np.array([tokens, documents, cost], float)
    weight = np.array(weights) / full**2
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    slots = np.empty((1024, 3))  # distinct residual vectors, each with a stack of bins
    stacks: list[list[tuple[int, int]]] = []
    where: dict[tuple[int, int, int], int] = {}
    free: list[int] = []
    used = made = 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        need = np.array([n, 1, n * n], float)
        have = slots[:used]
        fits = (have >= need).all(axis=1)
        if fits.any():
            left = have - need
            score = have @ (weight * need) if rule == "dot" else (left * left) @ weight
            slot = int(np.argmin(np.where(fits, score, np.inf)))
            own, fill = stacks[slot].pop()
            rest = tuple((have[slot] - need).tolist())
            if not stacks[slot]:
                del where[tuple(have[slot].tolist())]
                slots[slot] = -1
                free.append(slot)
        else:
            own, fill, rest = made, 0, tuple((full - need).tolist())
            made += 1
        bins[at], offsets[at] = own, fill
        if rest[0] < 1 or rest[1] < 1:
            continue
        slot = where.get(rest)
        if slot is None:
            if free:
                slot = free.pop()
            else:
                if used == len(slots):
                    slots = np.concatenate([slots, np.empty_like(slots)])
                slot, used = used, used + 1
                stacks.append([])
            slots[slot], where[rest] = rest, slot
        stacks[slot].append((own, fill + n))
    return bins, offsets


def pack(pieces: DataFrame, tokens: int = 2048, documents: int = 2048, cost: int | None = None, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.25, 0.25), group_tokens: int = 32 << 20, group_rows: int = 1 << 19) -> DataFrame:
    """The columns of ``pieces``, a written table, with sequence_id and offset. It needs doc_id, piece and length.

    ``cost`` is the attention capacity, by default that of one full piece, tokens squared.
    """
    cost = tokens * tokens if cost is None else cost
    total, rows = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, round((total or 0) / group_tokens), round(rows / group_rows))
    fields = [f for f in pieces.schema.fields]
    out = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group.pop("_group").iloc[0])
        group = group.sort_values(["doc_id", "piece"], kind="stable")
        bins, offsets = best_fit(group["length"].to_numpy(), tokens, documents, cost, rule, weights)
        return group.assign(sequence_id=bins * groups + number, offset=offsets)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, out)


def op4_best_fit_packing(spark, sf_dir):
    pieces = tokenize(read_table(spark, sf_dir, "documents"))
    small = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(small, "pieces"))
