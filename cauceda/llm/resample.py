r"""Importance resampling of documents towards a target: hashed n-grams, array-scored weights, an exact cutoff.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the whole text with A-Z lower-cased. Features are all runs of one and two
words; a feature's bucket is the crc32 of its UTF-8 modulo ``buckets``. One pass counts buckets: every task sums into one
array and gives a row for each bucket, so that ``buckets`` numbers are all that is brought to the driver, whatever the
corpus holds. A bucket's gain is the logarithm of its share in the target over its share in the corpus; a document's weight
is the mean of the gains that its features pick from the array of gains. Gumbel noise from a hash of the id makes the
drawing of the highest scores a weighted drawing without replacement.

The cutoff is found by weighted median-of-medians selection over a written table: each partition gives the median key
of its rows that are still open, with their number; the median of those medians, weighted by the numbers, has at
least a quarter of the open rows on either side; counting one side tells which to discard. It ends on the exact key,
or with ``finish`` open keys at most, which are then sorted. Keys (score, id, place in the written table) are
distinct, so equal rows in any number change nothing. The winners alone are sorted, by ranges.

Defined cases: null text has no words; a document without features has weight 0; without a target or corpus the
counts are 0; null ids take their noise from the empty id and come after other ids in ties; rows of one id and score
are ordered by place; an empty table gives an empty result; other columns are ignored. Long texts are hashed in pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.llm.common import materialize, read_table, slices, utf8_column
from cauceda.llm.manifest import CRC_TABLE, crc_sql
from cauceda.llm.ordering import numbered

#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
#: Spans of more bytes are hashed one by one.
LONG = 64
_ALL = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def extended(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 states (complements of sums) after the bytes of so many spans each."""
    order = np.argsort(-lengths, kind="stable")
    at, left, out = starts[order], lengths[order], states[order]
    long = int(np.searchsorted(-left, -LONG))  # spans of more than LONG bytes come first
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + left[i]], int(out[i] ^ _ALL)) ^ 0xFFFFFFFF
    longest = int(left[long]) if long < len(left) else 0
    ends = np.searchsorted(-left, -np.arange(longest), side="left")  # spans of more than k bytes
    for k in range(longest):
        own = out[long : ends[k]]
        out[long : ends[k]] = _TABLE[(own ^ data[at[long : ends[k]] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket, the bucket of each word with the next (``buckets`` where its text ends), and texts' numbers of words."""
    data = _LOWER[data]
    n = len(data)
    held = np.zeros(n + 2, bool)
    held[1:-1] = _IN_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    now, was = held[1:], held[:-1]
    starts, ends = np.flatnonzero(now & (~was | edge)), np.flatnonzero(was & (~now | edge))
    counts = np.diff(np.searchsorted(starts, offsets))
    one = extended(np.full(len(starts), _ALL), data, starts, ends - starts)
    two = np.full(len(starts), buckets, np.int64)
    if len(starts) > 1:
        spaced = _TABLE[(one[:-1] ^ np.uint32(32)) & np.uint32(255)] ^ (one[:-1] >> np.uint32(8))
        two[:-1] = (extended(spaced, data, starts[1:], (ends - starts)[1:]) ^ _ALL) % np.uint32(buckets)
        last = np.cumsum(counts) - 1
        two[last[counts > 0]] = buckets
    return ((one ^ _ALL) % np.uint32(buckets)).astype(np.int64), two, counts


def pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """A long text in pieces; each but the first begins with the last word of the one before (then True)."""
    raw, at, carry = data.tobytes(), 0, b""
    first = True
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and _IN_WORD[_LOWER[raw[end]]]:
            end += 1
        held = carry + raw[at:end]
        yield np.frombuffer(held, np.uint8), not first and bool(carry)
        inside = np.flatnonzero(_IN_WORD[_LOWER[np.frombuffer(held, np.uint8)]])
        if len(inside):
            last = int(inside[-1]) + 1
            begin = last
            while begin and _IN_WORD[_LOWER[held[begin - 1]]]:
                begin -= 1
            carry = held[begin:last] + b" "
        first, at = False, end


def sums(data: np.ndarray, offsets: np.ndarray, buckets: int, add) -> np.ndarray:
    """Calls ``add(row of each word, its bucket, bucket with the next)`` for all texts; gives their numbers of words."""
    total = np.zeros(len(offsets) - 1, np.int64)
    if len(data) <= 2 * PIECE:
        one, two, counts = features(data, offsets, buckets)
        add(np.repeat(np.arange(len(counts)), counts), one, two)
        return counts
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for piece, carried in pieces(data[a:b]):
            one, two, counts = features(piece, np.array([0, len(piece)]), buckets)
            if carried:
                one[0] = buckets  # counted in the piece before
            add(np.full(len(one), i), one, two)
            total[i] += counts[0] - carried
    return total


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets + 1, np.int64)

        def add(_, one: np.ndarray, two: np.ndarray) -> None:
            np.add(held, np.bincount(one, minlength=buckets + 1) + np.bincount(two, minlength=buckets + 1), out=held)

        for batch in slices(batches, "text", PIECE):
            sums(*utf8_column(batch.column(0)), buckets, add)
        found = np.flatnonzero(held[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, with one added to every count."""
    buckets, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = len(gain)
    shared = rows.sparkSession.sparkContext.broadcast(np.append(gain, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text", PIECE):
            total = np.zeros(batch.num_rows, np.int64)

            def add(row: np.ndarray, one: np.ndarray, two: np.ndarray, total=total) -> None:
                both, edges = np.append(0, np.cumsum(own[one] + own[two])), np.searchsorted(row, np.arange(len(total) + 1))
                total += both[edges[1:]] - both[edges[:-1]]

            words = sums(*utf8_column(batch.column(1)), buckets, add)
            n = words + np.maximum(words - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_column: str, seed: int) -> Column:
    """floor(1000 Gumbel) from the first 32 bits of a SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


ORDER = ("score", "doc_id", "place")


def up_to(key: tuple) -> Column:
    """Whether a row comes no later than ``key`` = (score, doc_id, place): by falling score, then id with nulls last, then place."""
    score, own, place = key
    same = F.col("doc_id").eqNullSafe(F.lit(own)) & (F.col("place") <= place)
    earlier = F.col("doc_id").isNotNull() if own is None else F.coalesce(F.col("doc_id") < F.lit(own), F.lit(False))
    return (F.col("score") >= score) & ((F.col("score") > score) | earlier | same)


def in_order(keys: pa.Table) -> pa.Table:
    return keys.take(pa.compute.sort_indices(keys, [("score", "descending"), ("doc_id", "ascending"), ("place", "ascending")], null_placement="at_end"))


def medians(keys: DataFrame) -> list[tuple[int, tuple]]:
    """The number of rows of each partition that has any, and their median key: a row a partition."""
    kind = keys.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            own = in_order(pa.Table.from_batches(held))
            middle = own.slice((own.num_rows - 1) // 2, 1)
            yield from middle.append_column("n", pa.array([own.num_rows])).to_batches()

    found = keys.mapInArrow(run, f"score long, doc_id {kind}, place long, n long").collect()
    return [(r["n"], (r["score"], r["doc_id"], r["place"])) for r in found]


def sorting(key: tuple) -> tuple:
    return (-key[0], key[1] is None, 0 if key[1] is None else key[1], key[2])


def cutoff(keys: DataFrame, k: int, finish: int = 1 << 16) -> tuple | None:
    """The k-th key of ``keys`` (score, doc_id, place), a written table, in order; None if k is 0."""
    if k < 1:
        return None
    open_, left = keys, k
    while True:
        found = medians(open_)
        total = sum(n for n, _ in found)
        if left > total:
            raise ValueError("fewer keys than are to be drawn")
        if total <= finish:
            rows = sorted(((r["score"], r["doc_id"], r["place"]) for r in open_.collect()), key=sorting)  # ``finish`` rows at most
            return rows[left - 1]
        half = 0
        for n, pivot in sorted(found, key=lambda x: sorting(x[1])):
            half += n
            if 2 * half >= total:
                break
        lower = open_.filter(up_to(pivot)).count()
        if lower == left:
            return pivot
        if lower > left:
            open_ = open_.filter(up_to(pivot))
        else:
            open_, left = open_.filter(~up_to(pivot)), left - lower


def scored(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A written table: doc_id, n_words, n_features, weight, score, place."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = weighed(docs, gain, id_col, text_col)
    return materialize(rows.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("place", F.monotonically_increasing_id()), "resample-scored")


def ranked(rows: DataFrame, percent: int = 25, least_words: int = 20, finish: int = 1 << 16) -> DataFrame:
    """The columns of ``rows``, a table of ``scored``, and rank: from 1 for what is drawn, null for the rest."""
    fit = F.col("n_words") >= least_words
    keys = rows.filter(fit).select(*ORDER)
    last = cutoff(keys, percent * keys.count() // 100, finish)
    drawn = fit & up_to(last) if last else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    winners = numbered(rows.filter(drawn), order, name="resample-drawn")
    rest = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.select(*rows.columns, (F.col("at") + 1).cast("long").alias("rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, place and rank of every row of ``docs``."""
    return ranked(scored(docs, target, **options), percent, least_words)


def op13_importance_resampling(spark, sf_dir):
    out = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH crc AS ({CRC_TABLE}),
worded AS (SELECT 0 AS kind, doc_id AS id, coalesce({_WORDS}, []) AS w FROM documents UNION ALL SELECT 1, item_id, coalesce({_WORDS}, []) FROM benchmark),
listed AS (SELECT kind, id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded),
used AS (SELECT kind, id, unnest(f) AS f FROM listed),
hashed AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM used), crc),
rows_ AS (SELECT kind, id, b FROM used JOIN hashed USING (f)),
counts AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM rows_ GROUP BY b),
totals AS (SELECT count(*) FILTER (kind = 0) AS alls, count(*) FILTER (kind = 1) AS allt FROM rows_),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (alls + 10000) / ((s + 1)::DOUBLE * (allt + 10000))))::BIGINT AS g FROM counts, totals),
weights AS (SELECT id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM rows_ JOIN gain USING (b) WHERE kind = 0 GROUP BY id),
scores AS (SELECT l.id AS doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || l.id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM listed l LEFT JOIN weights w ON w.id = l.id WHERE kind = 0),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS k FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
