"""Media columns stored as content-defined chunks.

A text's bytes, padded with 255 to a positive multiple of 576, become the 8-bit mono samples of a WAV file.
A rolling gear hash over the file's bytes cuts it into chunks; a chunk is named by its SHA-256. Every text's list of
digests is written; Spark counts the digests in it, and a join of the lists with those that occur more than once
tells each text which of its chunks are shared. A chunk that is alone stays inside its document's row and never
moves; the shared ones are stored once each in a chunk table, which Spark deduplicates by digest. A row keeps its
ordered chunk list; joining it with the chunk table gives the file back, which must have the digest it had.

Defined cases: null text is empty and gives 576 bytes of 255; equal texts give equal media, rebuilt once;
repeated rows and null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauceda.llm.common import materialize, read_table, slices
from cauceda.llm.hashing import constants

UNIT = 576
#: Texts with shared chunks are marked by a broadcast up to so many (some 100 bytes each), else by a shuffle.
BROADCAST_TEXTS = 250_000
#: Digests that they hold in all; each takes some 50 bytes.
BROADCAST_DIGESTS = 4_000_000
GEAR = (constants(256, 6) >> np.uint64(32)).astype(np.uint32)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM; the payload is of even length, so no pad byte follows it."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    head = HEADER.unpack_from(media)
    if (head[0], head[2], head[3], head[11]) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (head[5], head[6], head[10]) != (1, 1, 8):
        raise ValueError("not 8-bit mono PCM")
    payload = media[HEADER.size : HEADER.size + head[12]]
    if len(payload) != head[12]:
        raise ValueError("the file is shorter than its header says")
    return payload


def cuts(data: bytes, least: int = 1024, bits: int = 12, most: int = 16384) -> list[int]:
    """Ends of the chunks. A chunk ends where the top ``bits`` bits of the gear hash of 32 bytes are 0."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of GEAR[data[i - k]] << k for k below 32
        grown = h.copy()
        grown[step:] += h[:-step] << np.uint32(step)
        h = grown
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, at, n = [], 0, len(data)
    while n - at > least:
        i = int(np.searchsorted(marks, at + least))
        end = min(int(marks[i]) if i < len(marks) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n or not ends:
        ends.append(n)
    return ends


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """Digest and bytes of each chunk, in order."""
    at, out = 0, []
    for end in cuts(media):
        piece = media[at:end]
        out.append((hashlib.sha256(piece).digest(), piece))
        at = end
    return out


def describe(payload: bytes) -> str:
    """Loudness, spread, sign changes and a spectral tilt of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    step = np.diff(x)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"rms={np.sqrt((x * x).mean()):.4f};mean={x.mean():.4f};std={x.std():.4f};crossings={crossings};tilt={np.abs(step).mean():.4f}"


def _each(docs: DataFrame, of: Callable, schema: str) -> DataFrame:
    """``of(doc_id, text bytes, ...)`` gives the rows of each document."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fixed = batch.schema.field(0).type
            rows = [row for own in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in of(*own)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            out = []
            for name, kind, values in zip(names, schema.split(", "), columns, strict=True):
                kind = kind.split(" ", 1)[1]
                to = fixed if name == "doc_id" else pa.list_(pa.binary()) if kind.startswith("array") else kinds[kind]
                out.append(pa.array(values, to))
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.mapInArrow(run, schema)


def shared_chunks(rows: DataFrame) -> DataFrame:
    """key, shared: of each text that has any, the digests that occur more than once among all texts. rows: key, text."""
    listed = _each(rows.select(F.col("key").alias("doc_id"), "text"), lambda key, text: [(key, [d for d, _ in chunks(to_wav(payload_of(text)))])], "doc_id long, digests array<binary>")
    listed = materialize(listed, "media-lists")
    twice = listed.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    twice = materialize(twice, "media-twice")
    each = listed.select(F.col("doc_id").alias("key"), F.explode("digests").alias("digest"))
    return materialize(each.join(twice, "digest").groupBy("key").agg(F.collect_set("digest").alias("shared")), "media-shared")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the media: (objects, chunk table), both read back from the shared folder.

    objects: doc_id, n_bytes, media_sha256, digests (in order), inline (a chunk's bytes, or null if it is in the
    chunk table). chunk table: digest, bytes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = shared_chunks(rows.select("key", "text"))
    size = shared.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("shared")), F.lit(0)).alias("digests")).first()
    if size["texts"] <= BROADCAST_TEXTS and size["digests"] <= BROADCAST_DIGESTS:
        shared = F.broadcast(shared)

    def kept(k, text: bytes, shared: list[bytes] | None):
        media, common = to_wav(payload_of(text)), set(shared or ())
        pieces = chunks(media)
        return [(k, len(text), hashlib.sha256(media).digest(), [d for d, _ in pieces], [None if d in common else b for d, b in pieces])]

    def common(k, text: bytes, shared: list[bytes]):
        own = set(shared)
        return [(d, b) for d, b in chunks(to_wav(payload_of(text))) if d in own]

    objects = _each(rows.join(shared, "key", "left").select("doc_id", "text", "shared"), kept, f"doc_id {kind}, n_bytes long, media_sha256 binary, digests array<binary>, inline array<binary>")
    found = _each(rows.join(shared, "key").select(F.lit(0).cast("long").alias("doc_id"), "text", "shared"), common, "digest binary, bytes binary")
    once = found.groupBy("digest").agg(F.first("bytes").alias("bytes"))
    return materialize(objects, "media-objects"), materialize(once, "media-chunks")


def load(objects: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, media_sha256, pieces) of objects that hold all their chunks, and (media_sha256, pieces) of the others.

    pieces are the chunks' bytes in order. Equal media that need the chunk table are joined once.
    """
    whole = F.forall("inline", lambda x: x.isNotNull())
    alone = objects.filter(whole).select("doc_id", "n_bytes", "media_sha256", F.col("inline").alias("pieces"))
    listed = objects.filter(~whole).groupBy("media_sha256").agg(F.first(F.arrays_zip("digests", "inline")).alias("list"))
    listed = listed.select("media_sha256", F.posexplode("list").alias("at", "chunk")).select("media_sha256", "at", "chunk.*")
    found = listed.join(table, listed["digests"] == table["digest"], "left").select("media_sha256", F.struct("at", F.coalesce("inline", "bytes").alias("bytes")).alias("piece"))
    joined = found.groupBy("media_sha256").agg(F.array_sort(F.collect_list("piece")).alias("list"))
    return alone, joined.select("media_sha256", F.col("list.bytes").alias("pieces"))


def features(pieces: DataFrame) -> DataFrame:
    """The columns of ``pieces`` but for the pieces, and what the media they make up hold. A wrong digest raises."""
    kept = [c for c in pieces.columns if c != "pieces"]
    names = [*kept, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, parts in zip(batch.column(kept.index("media_sha256")), batch.column(len(kept)), strict=True):
                media = b"".join(x.as_py() for x in parts.values)
                if hashlib.sha256(media).digest() != digest.as_py():
                    raise ValueError("the chunks do not make up the media")
                payload = from_wav(media)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), describe(payload)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            made = [pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], names)

    schema = ", ".join([*(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept), "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "feature string"])
    return pieces.select(*kept, "pieces").mapInArrow(run, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row."""
    objects, table = store(docs, id_col, text_col)
    alone, joined = load(objects, table)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    direct = features(alone).select(*names)
    others = objects.filter(F.exists("inline", lambda x: x.isNull())).select("doc_id", "n_bytes", "media_sha256")
    rebuilt = others.join(features(joined), "media_sha256").select(*names)
    out = direct.unionByName(rebuilt)
    return out.withColumn("media_sha256", F.lower(F.hex("media_sha256")))


def op6_chunked_media(spark, sf_dir):
    return media_columns(read_table(spark, sf_dir, "documents"))
