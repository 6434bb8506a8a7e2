"""WARC archives: a writer through Spark's text sink and a splittable reader.

Each record, with the blank lines that end it, is a gzip member of its own. An empty member follows each: that makes
a file rows joined by a fixed separator, so Spark's committed, retry-safe text writer puts it on any file system
Spark knows. Decompressed, a file is a plain WARC/1.1 stream.

The reader gives tasks byte ranges. A task looks for the gzip magic, accepts a place as a record only if
the bytes there inflate to a WARC header and the whole member passes its checksum, and owns the records
that start inside its range, however far they reach. Listing goes through Spark, range reads through
``pyarrow.fs``. Archives of other writers are read too: any record type, with or without digest, page id or HTTP
header, and with or without the blank lines in the member; fields that a record lacks are null.

Payloads of at least ``least`` bytes that are equal are stored once: the smallest id is the response and
the others are revisits that carry only the HTTP header. Defined cases: null payload is empty; null ids
never become the response of a group that has an id; rows that repeat the response's id are responses
too; a null url is left out; an empty table writes no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.llm.common import discard, materialize, new_path, read_table, slices

MAGIC = b"\x1f\x8b\x08"
START = b"WARC/1."
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:page")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


BLANK = b"\r\n\r\n"
SEPARATOR = gzip_member(b"")


def record_uri(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, str(page_id))}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record without the blank lines after it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> None:
    """Write one record per row of ``pages`` to files under ``path``.

    Payloads that repeat are written aside first, so that Spark knows their size and can split a hot one over tasks.
    Rows below ``least`` have no copies: they move by their own page, if at all.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = materialize(copies.filter("n > 1").select(F.col("digest").alias("key"), "first"), "warc-copies")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    key = F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(copies, "key", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            made = [gzip_member(record(*row.values(), date) + BLANK, level) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    discard(copies)


class Member:
    """The gzip member at ``at`` of a file, inflated: ``content`` and where it ends; None if it is no record."""

    STEP = 16 << 10

    @classmethod
    def at(cls, source: pa.NativeFile, size: int, at: int, ahead: memoryview) -> tuple[bytes, int] | None:
        inflate, parts, fed, head = zlib.decompressobj(31), [], at, b""
        held = ahead
        try:
            while not inflate.eof:
                chunk, held = bytes(held[: cls.STEP]), held[cls.STEP :]
                if not chunk:
                    if fed >= size:
                        return None
                    held = memoryview(source.read_at(min(cls.STEP * 16, size - fed), fed))
                    continue
                fed += len(chunk)
                parts.append(inflate.decompress(chunk))
                if len(head) < len(START):
                    head += parts[-1][: len(START) - len(head)]
                    if not START.startswith(head):
                        return None
        except zlib.error:
            return None
        return (b"".join(parts), fed - len(inflate.unused_data)) if head == START else None


def records(source: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end)."""
    held = source.read_at(min(end + len(MAGIC) - 1, size) - start, start)
    view, at = memoryview(held), 0
    while (at := held.find(MAGIC, at)) >= 0:
        found = Member.at(source, size, start + at, view[at:])
        if found is None:
            at += 1
            continue
        yield found[0]
        at = found[1] - start


def header(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name, the first of a name; a line that begins with white space goes on with the one before."""
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += f" {line.strip()}"
        elif ":" in line:
            own, _, value = line.partition(":")
            name = own.strip().lower()
            out.setdefault(name, value.strip())
    return out


def parse(content: bytes) -> dict:
    """type, page_id, url, digest, payload_bytes, payload and refers_to of a record. Checks the payload's SHA-256 if it is given."""
    head, _, rest = content.partition(BLANK)
    fields = header(head.decode("utf-8", "replace").split("\r\n")[1:])
    length = int(fields.get("content-length", len(rest)))
    payload, after = rest[:length], rest[length:]
    if len(payload) != length or after.strip(b"\r\n"):
        raise ValueError("a record's block is not as long as its header says")
    revisit, said = fields.get("warc-type") == "revisit", None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(BLANK)
        said = header(http.decode("latin-1").split("\r\n")[1:]).get("content-length")
    digest = fields.get("warc-payload-digest")
    if digest and digest.startswith("sha256:"):
        digest = digest.removeprefix("sha256:")
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a record's payload is not what its header says")
    size = len(payload) if not revisit else int(said) if said and said.isdigit() else None
    return {"record_type": fields.get("warc-type"), "page_id": fields.get("page-id"), "url": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload, "refers_to": fields.get("refers-to-page-id")}


FIELDS = pa.schema([("record_type", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.string())])


def read_warc(spark: SparkSession, path: str, range_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The fields of every record under ``path``, ids as text; without payloads where they are not wanted."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    start = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes)))
    ranges = files.filter("size > 0").select("path", "size", start.alias("start"))
    # a number of our own: the list is small whatever the files hold, and Spark would join its parts into one
    count = ranges.count()
    ranges = ranges.repartition(max(1, min(count, max(4 * spark.sparkContext.defaultParallelism, count // 16))), "path", "start")
    schema = FIELDS if with_payload else FIELDS.remove(FIELDS.get_field_index("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = pafs.FileSystem.from_uri(row["path"])
                with store.open_input_file(place) as source:
                    rows, held = [], 0
                    for content in records(source, row["size"], row["start"], min(row["start"] + range_bytes, row["size"])):
                        rows.append(parse(content))
                        held += len(content) if with_payload else 0
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = ", ".join(f"{f.name} {({'int64': 'long'}).get(str(f.type), str(f.type))}" for f in schema)
    return ranges.mapInArrow(run, kinds)


def op5_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_warc(spark, path, with_payload=False)
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


ORACLE = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
