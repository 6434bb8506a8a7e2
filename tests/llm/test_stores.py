import gzip
import hashlib
import io
import os
import wave
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cauceda.llm import media, warc
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def pages(spark):
    big = "x" * 300
    html = [(1, "http://a/1", big), (0, None, big), (2, "http://a/ü\r\nX: y", "short"), (3, "http://a/3", "short"), (4, "u", None), (5, "u", ""), (6, "u", os.urandom(30000).hex()), (None, "u", big), (None, "u", "alone " * 40), (7, "u", "WARC/1.1\r\n\r\n" * 20)]
    rows = [*html, *((10 + i, "u", f"<p>page {i % 40}</p>" * 30) for i in range(200))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("range_bytes", [500, 8 << 20])
def test_archives_read_back(spark, pages, tmp_path, range_bytes):
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages.withColumns({"digest": F.lit("x"), "first": F.lit(1)}), path)
    got = {(r["page_id"], r["payload_digest"]): r for r in warc.read_warc(spark, path, range_bytes).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[r["html"]] = min(r["page_id"], first.get(r["html"], r["page_id"]))
    for r in rows:
        data = (r["html"] or "").encode()
        own = got[None if r["page_id"] is None else str(r["page_id"]), hashlib.sha256(data).hexdigest()]
        original = first.get(r["html"]) if len(data) >= 100 else None
        revisit = original is not None and original != r["page_id"]
        assert own["record_type"] == ("revisit" if revisit else "response") and own["payload_bytes"] == len(data)
        assert own["refers_to"] == (str(original) if revisit else None)
        assert (own["payload"] is None) if revisit else (bytes(own["payload"]) == data)


def test_archives_are_plain_warc_once_inflated(pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}/warc")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*"))
    at = n = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = raw[at:end].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        length = int(next(h for h in head if h.startswith("Content-Length"))[15:])
        assert raw[end + 4 + length : end + 8 + length] == b"\r\n\r\n"
        at, n = end + 8 + length, n + 1
    assert n == pages.count()


def test_ranges_own_each_record_once_and_skip_false_magic(tmp_path):
    noise = b"\x1f\x8b\x08" * 5 + b"junk"
    made = [warc.gzip_member(warc.record(i, "u", os.urandom(200) + noise, hashlib.sha256(b"").hexdigest(), 1, "d")) for i in range(30)]
    data = noise + warc.SEPARATOR.join([*made, b""]) + noise
    place = tmp_path / "a.gz"
    place.write_bytes(data)
    for step in (1, 97, 5000):
        with pa.OSFile(str(place)) as source:
            found = [c for s in range(0, len(data), step) for c in warc.records(source, len(data), s, min(s + step, len(data)))]
        assert len(found) == 30


def test_archives_of_other_writers(spark, tmp_path):
    """Blank lines in the member, no digest, no page id, no HTTP header, other record types."""
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n%s\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\r\n\r\nmore"
    made = [
        head % (b"warcinfo", 12, b"Content-Type: application/warc-fields\r\n") + b"software: x\n" + b"\r\n\r\n",
        head % (b"response", len(http), b"content-type: application/http; msgtype=response\r\nWARC-Target-URI: http://a\r\n folded\r\n") + http + b"\r\n\r\n",
        head % (b"resource", 3, b"WARC-Payload-Digest: sha1:ABC\r\n") + b"abc",
        head % (b"revisit", 0, b"") + b"\r\n\r\n",
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    got = {r["record_type"]: r for r in warc.read_warc(spark, f"file://{tmp_path}", 100).collect()}
    assert len(got) == 4 and bytes(got["warcinfo"]["payload"]) == b"software: x\n" and got["warcinfo"]["payload_digest"] is None
    assert bytes(got["response"]["payload"]) == b"body\r\n\r\nmore" and got["response"]["url"] == "http://a folded" and got["response"]["page_id"] is None
    assert (got["resource"]["payload_digest"], got["resource"]["payload_bytes"]) == ("sha1:ABC", 3)
    assert got["revisit"]["payload"] is None and got["revisit"]["payload_bytes"] is None


def test_ranges_are_dealt_to_many_tasks(spark, pages, tmp_path):
    warc.write_warc(pages, f"file://{tmp_path}/warc")
    assert warc.read_warc(spark, f"file://{tmp_path}/warc", 500).rdd.getNumPartitions() >= 8


def test_a_hot_payload_and_small_ones_spread_over_files(spark, tmp_path):
    """Half of the pages share a payload and a quarter are empty, with no broadcast: no file gets half of the records."""
    hot, own = F.repeat(F.lit("hot "), 200), F.concat(F.repeat(F.lit("x"), 150), F.sha2(F.col("page_id").cast("string"), 512))
    made = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.sha2(F.col("id").cast("string"), 512)).alias("url"))
    made = made.withColumn("html", F.when(F.col("page_id") % 2 == 0, hot).when(F.col("page_id") % 4 == 1, "").otherwise(own))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        warc.write_warc(made, f"file://{tmp_path}/warc")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    counts = [r["count"] for r in warc.read_warc(spark, f"file://{tmp_path}/warc").groupBy(F.spark_partition_id()).count().collect()]
    names = [len(gzip.open(f).read().split(b"WARC/1.1\r\n")) - 1 for f in (tmp_path / "warc").glob("part-*")]
    assert sum(counts) == sum(names) == 20_000 and max(names) < 8_000


def test_damaged_payloads_raise():
    content = warc.record(1, "u", b"abc", hashlib.sha256(b"other").hexdigest(), None, "d")
    with pytest.raises(ValueError):
        warc.parse(content)


def test_an_empty_table_writes_no_record(spark, pages, tmp_path):
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/warc")
    assert warc.read_warc(spark, f"file://{tmp_path}/warc").count() == 0


def test_wav_is_what_the_library_reads():
    payload = media.payload_of("ñ text".encode())
    assert len(payload) == 576
    with wave.open(io.BytesIO(media.to_wav(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert media.from_wav(media.to_wav(payload)) == payload
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(payload)[:-1])


def test_cuts_follow_content():
    data = os.urandom(200_000)
    ends = media.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(1024 < s <= 16384 for s in sizes[:-1])
    moved = media.cuts(os.urandom(777) + data)
    assert len({e for e in ends} & {e - 777 for e in moved}) > len(ends) / 2
    slow = [sum(int(media.GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) % 2**32 >> 20 == 0 for i in range(16384)]
    first = next((i + 1 for i in range(1024, 16384) if slow[i]), 16384)
    assert ends[0] in (first, first + 1) or ends[0] == 16384


@pytest.mark.parametrize("most", [250_000, 0])
def test_media_equal_brute_force(clashing, corpus, most, monkeypatch):
    monkeypatch.setattr(media, "BROADCAST_TEXTS", most)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = [tuple(r) for r in media.media_columns(clashing).select(*names).collect()]
    want = []
    for doc, text in corpus:
        data = (text or "").encode()
        p = media.payload_of(data)
        m = media.to_wav(p)
        want.append((doc, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), media.describe(p)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_copies_share_their_chunks(spark):
    text = os.urandom(40_000).hex()
    df = documents(spark, [(i, text) for i in range(5)] + [(9, os.urandom(20_000).hex())])
    objects, table = media.store(df)
    own = {r["doc_id"]: sum(b is not None for b in r["inline"]) for r in objects.collect()}
    assert own[9] == len(media.cuts(media.to_wav(media.payload_of(df.filter("doc_id = 9").first()["text"].encode())))) and all(own[i] == 0 for i in range(5))
    assert table.count() == len(media.chunks(media.to_wav(media.payload_of(text.encode()))))


def test_empty_media(empty):
    assert media.media_columns(empty).count() == 0
