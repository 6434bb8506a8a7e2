r"""Token ids in files of fixed-width bit packing, with block offsets for vectorised unpacking and random access.

Every id takes the least bits that hold the vocabulary: id i of a block is the little-endian bit field at
``i * bits``. A file is a run of documents, ascending by id over all files:

* blocks, each of whole documents and of ``block_ids`` ids or a little more: the packed ids, then the documents' lengths
  (8 bytes each), then their keys (lengths of 4 bytes each, -1 for null, and the UTF-8 of all);
* the footer: three arrays of 8-byte integers, each with one more entry than there are blocks: where blocks begin in
  the file, their first id's and their first document's place in the file;
* the trailer, the last 33 bytes: where the footer begins, the number of blocks, the file's ordinal, the bits (4
  bytes), and the magic.

A line feed follows each block and the trailer, so that Spark's own text sink, with its commit protocol, writes the
files to any store it knows. Listing goes through Spark, reads through ``pyarrow.fs``. A reader of ids [a, b) of a file
fetches only the bytes that hold them (``TokenFile``).

Ids are those of the ``tokenizers`` library at its default setting: the literal text of an added token is the one id of
that token. White space always parts tokens of this vocabulary, so that a text is read in pieces of ``PIECE`` bytes cut at
``[\x20\x09-\x0D]``; of plain Latin text each distinct word or mark, of other text each distinct chunk between white
space, is encoded once by the library and its ids are kept. A chunk itself goes to the library whole, so a text of
many megabytes without any space costs the library's memory.

Defined cases: null text is empty and has the end id alone; null ids of documents come first; rows of one id are
ordered by a digest of their texts, rows alike in that too are each stored, in some order; an empty table gives no
document; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cauceda.llm.common import materialize, new_path, read_table, slices, utf8_column
from cauceda.llm.hashing import ragged
from cauceda.llm.ordering import ascending

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAGIC = b"PACKEDID1"
TRAILER = np.dtype([("footer", "<u8"), ("blocks", "<u4"), ("ordinal", "<u8"), ("bits", "<u4"), ("magic", f"S{len(MAGIC)}")])
#: Blocks that a task reads, on average.
BLOCKS = 16
#: Bytes of text that are cut into chunks at once.
PIECE = 1 << 20
_SPACES = b"\x20\t\n\x0b\x0c\r"


def bits_of(vocabulary: int) -> int:
    """The least bits that hold the ids 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes in which id i is the bit field at ``i * bits``. Eight ids fill ``bits`` bytes; they are laid column by column."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    held = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    held[: len(ids)] = ids
    held = held.reshape(-1, 8)
    out = np.zeros((len(held), bits), np.uint8)
    for i in range(8):
        at, shift = divmod(i * bits, 8)
        wide = held[:, i] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, at + k] |= (wide >> np.uint64(8 * k)).astype(np.uint8)
    return out.reshape(-1)[: -(-len(ids) * bits // 8)]


def unpack_ids(data: np.ndarray, bits: int, skip: int, count: int) -> np.ndarray:
    """``count`` ids whose first field begins ``skip`` bits into ``data``."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", held.data, strides=(1,))
    place = np.arange(count, dtype=np.int64) * bits + skip
    return ((eights[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Chunks(dict):
    """Codes of pieces of text in the order they come; ``settle`` has the library encode those that are new."""

    def __init__(self, path: str, most: int = 1 << 19):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.own, self.most = Tokenizer.from_file(path), most
        self.latin = latin_pieces(path)
        self.ends = ends_of(path) if self.latin else None
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.alone: list[int] = []  # of the new ones, those that may be several words
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.sizes, self.settled = np.empty(1 << 16, np.int64), 0

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code

    def settle(self) -> None:
        if not self.new:
            return
        flat, sizes = self.encoded(self.new)
        self.flat, self.used = appended(self.flat, self.used, flat)
        self.sizes, self.settled = appended(self.sizes, self.settled, sizes)
        self.new = []

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the pieces end to end, and how many each has.

        Single words and marks go to it ``JOINED`` at a time with spaces between: their last tokens say so themselves.
        """
        alone, self.alone = self.alone, []
        if len(alone) < len(pieces):
            apart = set(alone)
            words = [p for i, p in enumerate(pieces) if i not in apart] if alone else pieces
            joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            ids = np.fromiter(chain.from_iterable(x.ids for x in self.own.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
            counts = np.diff(np.append(-1, np.flatnonzero(self.ends[ids])))
            if len(counts) != len(words):
                raise ValueError("the tokenizer joined or split words")
            if not alone:
                return ids, counts
        found = [x.ids for x in self.own.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)]
        sizes, flat = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)
        if len(alone) == len(pieces):
            return flat, sizes
        every = np.empty(len(pieces), np.int64)
        rest = np.setdiff1d(np.arange(len(pieces)), alone)
        every[alone], every[rest] = sizes, counts
        begins, out = np.cumsum(every) - every, np.empty(int(every.sum()), np.uint32)
        out[ragged(begins[alone], sizes)], out[ragged(begins[rest], counts)] = flat, ids
        return out, every

    def codes(self, raw: bytes) -> np.ndarray:
        """The codes of one text's pieces."""
        parts, at = [], 0
        while at < len(raw):
            end = cut_at(raw, at)
            text = raw[at:end].decode("utf-8")
            if self.latin and "<|" not in text and (text.isascii() or not FOREIGN.search(text)):
                pieces = self.latin.findall(text.lower())
                words = self.ends is not None
            else:
                pieces, words = CHUNK.findall(text), False
            before = len(self.new)
            parts.append(np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
            if not words:
                self.alone += range(before, len(self.new))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def encode(self, raw: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts laid end to end, and each text's count."""
        if len(self) > self.most:
            self.forget()
        codes = [self.codes(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.settle()
        sizes = self.sizes[: self.settled]
        begins, every = np.cumsum(sizes) - sizes, np.concatenate(codes) if codes else np.empty(0, np.int64)
        sums = np.append(0, np.cumsum(sizes[every]))
        edges = np.append(0, np.cumsum([len(c) for c in codes])).astype(np.int64)
        return self.flat[ragged(begins[every], sizes[every])], np.diff(sums[edges])


#: What white space surely parts.
CHUNK = re.compile("[^\x20\x09-\x0d]+")
#: Below it no character takes part in composition, and each but U+0130 has one lower-case character of its own class.
LATIN_END = "\u0280"
FOREIGN = re.compile(f"[\u0130{LATIN_END}-\U0010ffff]")
#: Words that the library encodes in one call.
JOINED = 512


def latin_pieces(path: str) -> re.Pattern | None:
    """The pattern of the tokenizer at ``path`` over lower-cased text below LATIN_END, with its classes spelled out.

    It lets distinct words be encoded once, whatever marks stand beside them. None for a tokenizer of another make,
    whose text is cut at white space alone.
    """
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    kinds = [x["type"] for x in (own.get("normalizer") or {}).get("normalizers", [])]
    splits = [x["pattern"]["Regex"] for x in (own.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or any(x["normalized"] or not x["content"].startswith("<|") for x in own["added_tokens"]):
        return None
    every = sorted({x for i in range(ord(LATIN_END)) if chr(i) != "\u0130" for x in (chr(i), chr(i).lower())})
    letters, numbers = ("".join(re.escape(c) for c in every if unicodedata.category(c)[0] == k) for k in "LN")
    spelled = splits[0].replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    spelled = spelled.replace("[^\\s\\p{L}\\p{N}]", f"[^\\t-\\r \x85\xa0{letters}{numbers}]").replace("\\p{L}", f"[{letters}]").replace("\\p{N}", f"[{numbers}]")
    return None if "\\p" in spelled or "\\s" in spelled else re.compile(spelled)


def ends_of(path: str) -> np.ndarray | None:
    """Whether each id ends a word; None where tokens do not say."""
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    suffix = own["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    out = np.zeros(vocabulary_size(path), bool)
    out[[i for token, i in own["model"]["vocab"].items() if token.endswith(suffix)]] = True
    return out


def appended(held: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """``more`` written after ``used`` entries of an array that doubles where it is full."""
    while used + len(more) > len(held):
        held = np.concatenate([held, np.empty_like(held)])
    held[used : used + len(more)] = more
    return held, used + len(more)


def cut_at(raw: bytes, at: int) -> int:
    """Where the piece of ``raw`` that starts at ``at`` ends: at white space, or at the end of the text."""
    end = at + PIECE
    if end >= len(raw):
        return len(raw)
    back = max(raw.rfind(bytes([c]), at, end) for c in _SPACES)
    if back > at:
        return back
    found = [x for c in _SPACES if (x := raw.find(bytes([c]), end)) >= 0]
    return min(found, default=len(raw))


@lru_cache(2)
def chunks_of(path: str) -> Chunks:
    """One a Python worker, kept over its tasks."""
    return Chunks(path)


@lru_cache(2)
def vocabulary_size(path: str) -> int:
    """One more than the largest id, added tokens included."""
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    return 1 + max(max(own["model"]["vocab"].values()), *(x["id"] for x in own.get("added_tokens") or [{"id": 0}]))


class Writer:
    """The bytes of one file: blocks as documents come, then footer and trailer."""

    def __init__(self, bits: int, ordinal: int, block_ids: int):
        self.bits, self.ordinal, self.block_ids = bits, ordinal, block_ids
        self.at, self.ids, self.docs = [0], [0], [0]
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.keys: list[bytes | None] = []
        self.held = 0

    def add(self, key: bytes | None, ids: np.ndarray) -> Iterator[bytes]:
        self.parts.append(ids)
        self.lengths.append(len(ids))
        self.keys.append(key)
        self.held += len(ids)
        if self.held >= self.block_ids:
            yield self.block()

    def block(self) -> bytes:
        sizes = np.array([-1 if k is None else len(k) for k in self.keys], "<i4")
        packed = pack_ids(np.concatenate(self.parts), self.bits)
        out = b"".join([packed.tobytes(), np.array(self.lengths, "<i8").tobytes(), sizes.tobytes(), *(k for k in self.keys if k)])
        self.at.append(self.at[-1] + len(out) + 1)  # the sink's line feed
        self.ids.append(self.ids[-1] + self.held)
        self.docs.append(self.docs[-1] + len(self.keys))
        self.clear()
        return out

    def end(self) -> Iterator[bytes]:
        if self.keys:
            yield self.block()
        tail = np.zeros(1, TRAILER)
        tail[0] = (self.at[-1], len(self.at) - 1, self.ordinal, self.bits, MAGIC)
        yield np.array([self.at, self.ids, self.docs], "<i8").tobytes() + tail.tobytes()


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str = TOKENIZER, file_bytes: int = 64 << 20, file_docs: int = 1 << 20, block_ids: int = 1 << 18) -> None:
    """Write the ids of every text and ``end_id`` to files under ``path``, ascending by id.

    A file has ``file_bytes`` of text and ``file_docs`` documents on average. Texts move once, by ranges that end
    between any two rows, so rows of one id spread too; they are encoded where their file is written.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("place"))
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    files = max(1, -(-(total or 0) // file_bytes), -(-count // file_docs))
    keys = [ascending("doc_id"), F.col("digest"), F.col("place")]
    placed = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    placed = placed.select(F.col("doc_id").cast("string").cast("binary").alias("key"), "text")
    bits = bits_of(vocabulary_size(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = chunks_of(tokenizer), Writer(bits, TaskContext.get().partitionId(), block_ids)
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = utf8_column(batch.column(1))
            ids, counts = own.encode(data.tobytes(), offsets.tolist())
            ids = np.insert(ids, np.cumsum(counts), end_id)
            ends = np.cumsum(counts + 1).tolist()
            for key, a, b in zip(batch.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                for block in writer.add(key, ids[a:b]):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])
        for block in writer.end():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    placed.mapInArrow(run, "block binary").select(F.col("block").cast("string")).write.text(path)


class TokenFile:
    """Random access to one file: only the bytes asked for are read."""

    def __init__(self, uri: str, size: int | None = None):
        store, place = pafs.FileSystem.from_uri(uri)
        self.source = store.open_input_file(place)
        size = self.source.size() if size is None else size
        tail = np.frombuffer(self.source.read_at(TRAILER.itemsize, size - TRAILER.itemsize - 1), TRAILER)[0]
        if tail["magic"] != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        self.bits, self.ordinal, blocks = int(tail["bits"]), int(tail["ordinal"]), int(tail["blocks"])
        arrays = np.frombuffer(self.source.read_at(24 * (blocks + 1), int(tail["footer"])), "<i8").reshape(3, blocks + 1)
        self.at, self.first_id, self.first_doc = arrays

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file, over as many blocks as they take."""
        out, block = [], int(np.searchsorted(self.first_id, start, side="right")) - 1
        while start < end:
            first, last = int(self.first_id[block]), min(end, int(self.first_id[block + 1]))
            low, high = (start - first) * self.bits, (last - first) * self.bits
            data = self.source.read_at(-(-high // 8) - low // 8, int(self.at[block]) + low // 8)
            out.append(unpack_ids(np.frombuffer(data, np.uint8), self.bits, low % 8, last - start))
            start, block = last, block + 1
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def block(self, block: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """All ids of a block, its documents' lengths and their keys."""
        at, ids, docs = (int(x[block + 1] - x[block]) for x in (self.at, self.first_id, self.first_doc))
        data = self.source.read_at(at - 1, int(self.at[block]))
        packed = -(-ids * self.bits // 8)
        lengths = np.frombuffer(data, "<i8", docs, packed)
        sizes = np.frombuffer(data, "<i4", docs, packed + 8 * docs)
        ends = (packed + 12 * docs + np.cumsum(np.maximum(sizes, 0))).tolist()
        keys = [None if n < 0 else data[e - n : e] for n, e in zip(sizes.tolist(), ends, strict=True)]
        return unpack_ids(np.frombuffer(data, np.uint8, packed), self.bits, 0, ids), lengths, keys


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """path, size, block, first_id (over all files) of every block, and n_ids: the footers' contents."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    count = files.count()
    files = files.repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with TokenFile(row["path"], row["size"]) as file:
                    n = len(file.at) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["path"]] * n, pa.string()), pa.array([row["size"]] * n, pa.int64()), pa.array([file.ordinal] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(file.first_id[:-1]), pa.array(np.diff(file.first_id))],
                        ["path", "size", "ordinal", "block", "in_file", "n_ids"],
                    )

    blocks = materialize(files.mapInArrow(run, "path string, size long, ordinal long, block int, in_file long, n_ids long"), "token-blocks")
    totals = blocks.groupBy(F.col("ordinal").alias("file")).agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    bases = totals.select("file", before.alias("before"))
    found = blocks.join(bases, F.col("ordinal") == F.col("file"))
    return found.select("path", "size", "block", (F.col("before") + F.col("in_file")).alias("first_id"), "n_ids")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id (as text), start, n_tokens, ids_crc32 and, where wanted, ids (little-endian unsigned 32-bit) of every document."""
    blocks = block_index(spark, path)
    wanted = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != name:
                    if file:
                        file.source.close()
                    name, file = row["path"], TokenFile(row["path"], row["size"])
                ids, lengths, keys = file.block(row["block"])
                ends = np.cumsum(lengths)
                raw = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array([None if k is None else k.decode() for k in keys], pa.string()), pa.array(row["first_id"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_ids else [])], wanted)
        if file:
            file.source.close()

    kinds = "doc_id string, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    # a number of our own: rows are small whatever their blocks hold, and Spark would join them into one task
    tasks = max(1, -(-blocks.count() // BLOCKS))
    spread = blocks.repartition(tasks, "path", F.floor(F.col("block") / BLOCKS)).sortWithinPartitions("path", "block")
    return spread.mapInArrow(run, kinds)


def op11_packed_token_files(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    path = new_path(spark, "token-files")
    write_token_files(docs, path)
    found = read_token_files(spark, path, with_ids=False)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
