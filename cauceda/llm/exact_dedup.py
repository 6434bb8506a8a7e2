"""Exact deduplication with an extendible-hash index on shared files (DataFrame operations only).

The hash key of a text is ``xxhash64``. The directory starts with one bucket and doubles wherever a bucket has more
than ``capacity`` distinct keys; the top bits of the key select the bucket, as many of them as its local depth. It
deepens until every bucket fits or holds one key alone. Every row finds its bucket through the directory. Rows are
pre-aggregated by text, a hot text in ``SALTS`` parts, and go to owner tasks, each with a range of (bucket, key). An
owner merges what is equal, byte by byte where a key occurs more than once, chains the texts that collide in a key by
their SHA-256, and decides there which row stays and how large the group is; what it finds is the index, on shared
files, in which documents look themselves up by bucket, key and digest.

Texts move only where their key occurs more than once. Defined cases: null text counts as empty; null ids lose to any
id; rows that repeat both id and text are all reported, each as kept where its id is; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauceda.llm.common import discard, materialize, read_table

#: Tables of keys or slots up to so many rows (of some 20 bytes) are broadcast, longer ones are shuffled.
BROADCAST_KEYS = 1_000_000
#: Parts in which a text is pre-aggregated.
SALTS = 16
#: Bits by which the directory deepens at once where its buckets are overfull, beyond what even keys need.
DEEPER = 2


def top(key: str | Column, bits: int) -> Column:
    """The top ``bits`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def directory(keys: DataFrame, capacity: int) -> list[tuple[int, DataFrame]]:
    """(bits, slots) from shallow to deep; slots: slot (the top bits of a key), local_depth, bucket.

    ``keys`` has distinct keys. A table of slots covers the keys that the tables before it leave; its buckets fit. At 64
    bits a bucket has one key.
    """
    tables, left = [], keys.select("key")
    n = left.count()
    bits = base = 0
    while n:
        bits = min(64, base + max(0, -(-n // capacity) - 1).bit_length() + DEEPER)
        slots = materialize(left.groupBy(top("key", bits).alias("slot")).agg(F.count("*").alias("n")), "exact-slots")
        levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits))))
        prefix = F.expr(f"shiftrightunsigned(slot, {bits} - depth)")
        loads = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("load"))
        fits = loads.filter((F.col("load") <= capacity) | (F.col("depth") == 64)).select("depth", "prefix")
        local = levels.withColumn("prefix", prefix).join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("local_depth"))
        bucket = F.expr(f"shiftleft(shiftrightunsigned(slot, {bits} - local_depth), {bits} - local_depth)")
        bucket = F.shiftleft(bucket, 64 - bits) if bits else F.lit(0).cast("long")
        local = materialize(local.withColumn("bucket", bucket), "exact-directory")
        discard(slots)
        tables.append((bits, local))
        left = left.withColumn("slot", top("key", bits)).join(small(local), "slot", "left_anti").select("key")
        if bits == 64:
            break
        n, base = left.count(), bits
    return tables


def in_bucket(rows: DataFrame, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows``, which have a key, with the local_depth and bucket that the directory gives it."""
    found = []
    for i, (bits, slots) in enumerate(tables):
        own = slots.select(*(F.col(c).alias(f"{c}_{i}") for c in slots.columns))
        rows = rows.join(small(own), top("key", bits) == F.col(f"slot_{i}"), "left").drop(f"slot_{i}")
        found.append(i)
    made = {c: F.coalesce(*(F.col(f"{c}_{i}") for i in found)) if found else F.lit(0) for c in ("local_depth", "bucket")}
    rows = rows.withColumns(made)
    return reduce(lambda df, i: df.drop(f"local_depth_{i}", f"bucket_{i}"), found, rows)


def build_index(rows: DataFrame, capacity: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """bucket, local_depth, key, chain, text_sha256, keep_id, group_size: one row per distinct text, on shared files; and the directory.

    rows: doc_id, text, key.
    """
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    tables = directory(keys, capacity)
    again = small(keys.filter("n > 1").select("key", F.lit(True).alias("again")))
    body = F.when(F.col("again"), F.col("text")).alias("body")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    routed = in_bucket(rows.join(again, "key", "left").select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"), body, salt), tables)
    names = ["bucket", "local_depth", "key", "text_sha256", "body"]
    parts = materialize(routed.groupBy(*names, "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-parts")
    owned = parts.repartitionByRange("bucket", "key")
    merged = owned.groupBy(*names).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256"))
    index = materialize(merged.withColumn("chain", chain).drop("body"), "exact-index")
    discard(keys, parts)
    return index, tables


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 14) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key, bucket, chain: one row per row of ``docs``.

    The row with the largest id of equal texts stays. ``capacity`` is in distinct keys a bucket.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    index, tables = build_index(rows, capacity)
    placed = in_bucket(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), tables)
    found = placed.drop("local_depth").join(index, ["bucket", "key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "key", "bucket", "chain")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select("doc_id", "key").distinct()
    gone = materialize(gone, "exact-gone")  # its written size decides whether the documents move for the join
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id"]) & (key == gone["key"]), "left_anti")


def op9_exact_dedup(spark, sf_dir):
    out = exact_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
