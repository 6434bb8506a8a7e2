"""Sharding by a two-pass external shuffle (DataFrame operations only).

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of id, text and ordinal: rows that
repeat both id and text are counted first and told apart by an ordinal, so that they part too. Pass two puts each
bucket in a fixed order, applies a Fisher-Yates shuffle to it, whose draws are seeded hashes of bucket and step, and
writes it to the shared folder. Buckets laid end to end are one global permutation; position p goes to shard
``p mod n`` and slot ``p div n``, so shard counts differ by at most one (law ``rows``). The result depends on the
rows, the seed and the bucket sizes alone, not on partitions or machines.

A bucket has ``bucket_bytes`` and ``bucket_rows`` at most on average: hashing evens out hot sources and long documents.
Defined cases: null text has size 1 and the CRC of no bytes; null ids and repeated rows are rows like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cauceda.llm.common import discard, materialize, read_table

#: Buckets whose sizes one task adds up.
RUN = 4096
#: Copies of a row that are made at once: so many rows and bytes, and so many rows and bytes a task.
COPIES, COPIED_BYTES = 4096, 16 << 20
TASK_COPIES, TASK_BYTES = 1 << 17, 128 << 20


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text, size) with an ordinal, from 1, among those that repeat id and text; and a table to discard once that is written.

    Repeated rows are counted into one and made again from the count. The count is cut into runs, which are dealt to
    a number of tasks that grows with the copies, so that no task makes all copies of a row.
    """
    named = rows.withColumn("key", F.xxhash64("text"))
    again = named.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    again = materialize(again.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n", "bytes"), "shuffled-again")
    made = again.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = 1 + (made.n or 0) // TASK_COPIES + (made.bytes or 0) // TASK_BYTES
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    keys = again.select("_id", "_key")
    alone = named.join(keys, same, "left_anti").select("doc_id", "text", "size", F.lit(1).cast("long").alias("ordinal"))
    copies = named.join(keys, same, "left_semi").groupBy("doc_id", "text", "size").agg(F.count("*").alias("n"))
    run = F.greatest(F.lit(1), F.least(F.lit(COPIES), F.floor(F.lit(COPIED_BYTES) / F.col("size")))).cast("long")
    runs = copies.withColumn("run", run).withColumn("first", F.explode(F.expr("sequence(1L, n, run)")))
    dealt = runs.repartition(tasks, F.xxhash64("doc_id", "text", "first"))  # a given number is not coalesced
    made_again = dealt.select("doc_id", "text", "size", F.explode(F.expr("sequence(first, least(n, first + run - 1))")).alias("ordinal"))
    return alone.unionByName(made_again), again


def fisher_yates(seed: int) -> str:
    """SQL: the array ``rows`` shuffled; step i, from the last place down, swaps place i with a drawn one up to it."""
    draws = f"IF(size(rows) > 1, transform(sequence(size(rows) - 1, 1, -1), i -> struct(i AS i, CAST(pmod(xxhash64({seed}, bucket, i), i + 1) AS INT) AS j)), array())"
    swap = "IF(d.i = d.j, a, concat(slice(a, 1, d.j), array(a[d.i]), slice(a, d.j + 2, d.i - d.j - 1), array(a[d.j]), slice(a, d.i + 2, size(a))))"
    return f"transform(aggregate({draws}, sequence(0, size(rows) - 1), (a, d) -> {swap}), k -> rows[k])"


def starts_of(sizes: DataFrame) -> DataFrame:
    """bucket, start: the running sums of ``sizes`` (bucket, n), added up in runs of buckets and then over the runs."""
    runs = sizes.withColumn("run", F.floor(F.col("bucket") / RUN))
    within = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    totals = runs.groupBy("run").agg(F.sum("n").alias("all"))
    before = totals.select("run", (F.sum("all").over(Window.orderBy("run")) - F.col("all")).alias("before"))  # a row for RUN buckets
    return runs.withColumn("within", within).join(before, "run").select("bucket", (F.col("before") + F.col("within")).alias("start"))


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 4 << 20, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, text, size, bucket, position: ``docs`` in a seeded random order; position is gapless from 0."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes), -(-count // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "ordinal"), F.lit(buckets)).alias("bucket")
    parted, again = told_apart(rows)
    held = parted.select("*", bucket).groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "ordinal", "size", "text")).alias("rows"))
    dealt = held.select("bucket", F.array_sort("rows").alias("rows"))
    drawn = dealt.select("bucket", F.posexplode(F.expr(fisher_yates(seed))).alias("at", "row"))
    drawn = materialize(drawn.select("bucket", "at", "row.doc_id", "row.size", "row.text"), "shuffled")
    discard(again)
    starts = starts_of(drawn.groupBy("bucket").agg(F.count("*").alias("n")))
    return drawn.join(starts, "bucket").select("doc_id", "text", "size", "bucket", (F.col("start") + F.col("at")).alias("position"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **sizes: int) -> DataFrame:
    """doc_id, text, size, shard, slot for every row of ``docs``."""
    rows = shuffled(docs, id_col, text_col, seed, **sizes)
    at = F.col("position")
    return rows.select("doc_id", "text", "size", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its rows in slot order over files whose ranges of slots do not overlap."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_two_pass_shuffle(spark, sf_dir):
    out = shard(read_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
