r"""Substring deduplication by level-wise doubling of repeated word windows.

Words are ``[^\x20\x09-\x0D]+``. A word goes if a window of ``window`` words covers it whose words also start
in a document with a smaller id. Lengths start at ``start`` and double up to ``window``. At a shorter length
a full window is stood for by the smallest hash of the runs of that length inside it: equal windows have equal
smallest hashes, so few runs are counted and none that matters is missed. Only windows whose hash occurs in two
documents at one length are extended to the next; at the full length the hash of the window itself (96 bits)
decides, by the smallest id that has it. Copies of whole texts are set aside first: the smallest id stands for
them, and the others lose all their words if they are as long as a window.

Hashes are counted by grouping, with partial sums before the shuffle. What repeats is written before it is joined
back to the places, so that both sides of such a join are plain shuffles and Spark can split a hot passage's places.

Defined cases: null text has no words; texts shorter than a window lose nothing; rows of one id do not count
as smaller than each other; rows with null ids lose nothing and make none lose; repeated rows each get the same
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauceda.llm.common import discard, materialize, read_table, slices, utf8_column
from cauceda.llm.words import inside, run_hashes, word_hashes, words

KEYS = ["doc_id", "text_key"]
SLICE = 1 << 20


def lengths(start: int, window: int) -> list[int]:
    """start, 2 start, ... and window last."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` hashes in a row."""
    out, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def stands_for(hashes: np.ndarray, counts: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where full windows start (word numbers), and the smallest hash of ``length`` words in each."""
    runs = run_hashes(hashes, length)
    width = window - length + 1
    if len(runs) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = smallest(runs, width)
    at = np.flatnonzero(inside(counts, window)[: len(least)])
    return at, least[at]


def stretches(at: np.ndarray, value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each stretch of neighbouring windows of one document with one value."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _marks(batch: pa.RecordBatch, text: pa.Array, length: int, window: int, within: np.ndarray | None) -> pa.RecordBatch:
    """doc_id, text_key, runs (h, lo, n): the stretches of windows, inside ``within`` if given."""
    data, offsets = utf8_column(text)
    starts, ends, counts = words(data, offsets)
    at, least = stands_for(word_hashes(data, starts, ends), counts, length, window)
    doc = np.repeat(np.arange(len(counts)), counts)
    if within is not None and len(at):
        kept = within[at]
        at, least = at[kept], least[kept]
    first, n = stretches(at, least, doc[at])
    lo = at[first] - (np.cumsum(counts) - counts)[doc[at[first]]]
    rows = np.bincount(doc[at[first]], minlength=len(counts))
    flat = pa.StructArray.from_arrays([pa.array(least[first].view(np.int64)), pa.array(lo, pa.int32()), pa.array(n, pa.int32())], ["h", "lo", "n"])
    offsets = pa.array(np.append(0, np.cumsum(rows)), pa.int32())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat)], [*KEYS, "runs"])


def covered(ranges: pa.Array, counts: np.ndarray) -> np.ndarray:
    """For every word of a batch, whether one of its document's ranges (lo, n) of window starts has it."""
    first = np.cumsum(counts) - counts
    flat, sizes = ranges.flatten(), np.diff(ranges.offsets.to_numpy())
    lo = flat.field("lo").to_numpy() + np.repeat(first, sizes)
    end = np.minimum(lo + flat.field("n").to_numpy(), np.repeat(first + counts, sizes))
    edge = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.subtract.at(edge, end, 1)
    return np.cumsum(edge[:-1]) > 0


def marks(docs: DataFrame, length: int, window: int) -> DataFrame:
    """The stretches of all windows; ``docs`` has the keys, text and, from the second level on, ranges that bound the windows."""
    bounded = "ranges" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            within = covered(batch.column(3), words(*utf8_column(batch.column(2)))[2]) if bounded else None
            yield _marks(batch, batch.column(2), length, window, within)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, runs array<struct<h:long,lo:int,n:int>>")


def full_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, at, h, g: each window inside the ranges of its row, with 64 and 32 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8_column(batch.column(2))
            starts, ends, counts = words(data, offsets)
            at = np.flatnonzero(covered(batch.column(3), counts) & inside(counts, window))
            doc = np.repeat(np.arange(len(counts)), counts)[at]
            h = run_hashes(word_hashes(data, starts, ends), window)
            g = run_hashes(word_hashes(data, starts, ends, second=True), window, second=True)
            local = at - (np.cumsum(counts) - counts)[doc]
            for a in range(0, len(at), 1 << 16):
                part = slice(a, a + (1 << 16))
                row = pa.array(doc[part])
                made = [pa.array(local[part], pa.int32()), pa.array(h[at[part]].view(np.int64)), pa.array((g[at[part]] >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *made], [*KEYS, "at", "h", "g"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, at int, h long, g int")


def repeated(places: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and first, the smallest id, of the hashes that occur in two documents."""
    ends = places.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return ends.filter("first < last").drop("last")


def ranges_of(places: DataFrame) -> DataFrame:
    """The ranges of each text, once each and written: rows that repeat id and text name the same ones."""
    return materialize(places.groupBy(*KEYS).agg(F.collect_set(F.struct("lo", "n")).alias("ranges")), "substring-ranges")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept, row. ``docs`` has the keys, text, row, starts of removed windows, and copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n, gone, kept = [], [], []
            for text, starts, copy in zip(batch.column(2).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                own = (text or "").encode().split()  # bytes.split() cuts at \x20 and \x09 to \x0D
                n.append(len(own))
                if copy and len(own) >= window:
                    own = []
                elif starts.is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    at = np.asarray(starts.values)
                    np.add.at(edge, at, 1)
                    np.subtract.at(edge, at + window, 1)
                    own = list(compress(own, np.cumsum(edge[:-1]) == 0))
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own))
            made = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(3)], ["doc_id", "n_words", "n_removed", "kept", "row"])

    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "row")]
    return docs.mapInArrow(run, f"doc_id {kinds[0]}, n_words long, n_removed long, kept string, row {kinds[1]}")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, start: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), row of every row of ``docs``.

    row is a struct of the columns ``keep``, and of an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*(F.col(c) for c in keep), F.lit(0).alias("_"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), row.alias("row"))
    # whole copies: a SHA-256 names a text
    ids = materialize(base.select("doc_id", "text_key", F.sha2("text", 256).alias("name")), "substring-ids")
    firsts = ids.groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = materialize(ids.join(firsts, "name").filter("first < doc_id").select(*KEYS).distinct(), "substring-copies")
    discard(ids)

    *shorter, full = lengths(start, window)
    texts, ranges = base.select(*KEYS, "text"), None
    for i, length in enumerate(shorter):
        found = materialize(marks(texts, length, window), "substring-marks")
        own = found if i else found.join(copies, KEYS, "left_anti")
        places = own.select(*KEYS, F.explode("runs").alias("run")).select(*KEYS, "run.*").filter("doc_id IS NOT NULL")
        hot = materialize(repeated(places, ["h"]).select("h"), "substring-hot")
        ranges = ranges_of(places.join(hot, "h", "left_semi"))
        discard(found, hot)
        # from here on only texts with candidates are read; they move by a shuffle at any size, as the ranges grow with the data
        longer = materialize(texts.select(*KEYS, "text").join(ranges.hint("merge"), KEYS).select(*KEYS, "text", "ranges"), "substring-texts")
        if i:
            discard(texts)
        texts = longer
    if ranges is None:
        every = F.array(F.struct(F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("n")))
        texts = texts.filter("doc_id IS NOT NULL").withColumn("ranges", every)

    places = materialize(full_windows(texts, window), "substring-windows")
    if shorter:
        discard(texts)
    firsts = materialize(repeated(places, ["h", "g"]), "substring-firsts")
    gone = places.join(firsts, ["h", "g"]).filter("first < doc_id")
    removed = gone.groupBy(*KEYS).agg(F.collect_set("at").alias("starts"))
    flags = copies.withColumn("copy", F.lit(True))
    marked = removed.join(flags, KEYS, "full").select(*KEYS, "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    marked = materialize(marked, "substring-marked")
    discard(places, firsts, copies)
    out = base.join(marked.hint("merge"), KEYS, "left").select(*KEYS, "text", "row", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return _kept(out, window)


def op8_substring_dedup(spark, sf_dir):
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
