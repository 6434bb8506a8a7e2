"""Versioned upsert of re-read windows: new rows in, changed rows replaced, nothing deleted.

Parquet tables have no MERGE: the result is the old rows without a match, plus the new side, and goes to the
table by a swap. Old rows move once, to be joined by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import hashing
from cauceda.operators.cut import written
from cauceda.operators.identity import Identity, resolve

STAMPS = ("version_hash", "run_id", "seen_at")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of highest ``position`` for each key: a grouped ``max_by``, summed before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def stamped(df: DataFrame, content: list[str], run_id: str, seen_at: Column) -> DataFrame:
    return df.withColumns({"version_hash": hashing.content_hash(*content), "run_id": F.lit(run_id), "seen_at": seen_at})


def blank_value(col: Column) -> Column:
    return F.trim(F.coalesce(col.cast("string"), F.lit(""))).isin("", "[]", "{}")


def merged(met: DataFrame, content: list[str], run_id: str, seen_at: Column, tombstone: Column | None, keep: tuple[str, ...]) -> DataFrame:
    """Incoming rows beside the stored ones they replace (``_old``, or null), stamped, with ``action``."""
    if tombstone is not None:
        met = met.withColumns({c: F.when(tombstone & blank_value(F.col(c)) & F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c)) for c in keep})
    met = stamped(met, content, run_id, seen_at)
    action = F.when(F.col("_old").isNull(), "new").when(F.col("_old.version_hash") == F.col("version_hash"), "unchanged").otherwise("updated")
    return met.withColumn("action", action)


def given(new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key by ``position``; a null key raises."""
    for k in keys:
        new = new.withColumn(k, F.coalesce(k, F.raise_error(F.lit(f"{k} is null")).cast(dict(new.dtypes)[k])))
    return last_wins(new, keys, position) if position else new


def upsert(old: DataFrame, new: DataFrame, keys: list[str], content: list[str], run_id: str, seen_at: Column, position: str = "", tombstone: Column | None = None, keep: tuple[str, ...] = (), identities: list[Identity] | None = None, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """All rows after the upsert, with ``action``: kept, unchanged, updated or new.

    ``new`` has keys and content. Of rows of one key the last by ``position`` counts; a null key raises. Where
    ``tombstone`` holds for an incoming row, its blank columns among ``keep`` take the stored values.
    ``identities`` are further keys, in order of priority, by which a stored row is known where ``keys`` fail: see
    ``identity``, also for ``cut``. Stored rows that such a key shows to be one with another go.
    """
    new = given(new, keys, position)
    columns = [*keys, *(c for c in content if c not in keys)]
    if identities:
        newest = F.col(position) if position else F.lit(0)
        found = resolve(old, new, [Identity(tuple(keys)), *identities], newest, F.col("seen_at"), cut)
        fresh = merged(found.met, content, run_id, seen_at, tombstone, keep).select(*columns, *STAMPS, "action")
        return found.kept.select(*columns, *STAMPS, F.lit("kept").alias("action")).unionByName(fresh)
    new = new.drop(position) if position else new
    old_side = old.select(*keys, F.struct(*content, "version_hash").alias("_old"))
    met = new.join(old_side, keys, "left")
    fresh = merged(met, content, run_id, seen_at, tombstone, keep).select(*columns, *STAMPS, "action")
    kept = old.join(new.select(*keys), keys, "left_anti").select(*columns, *STAMPS, F.lit("kept").alias("action"))
    return kept.unionByName(fresh)


def counts(result: DataFrame) -> DataFrame:
    return result.groupBy("action").agg(F.count("*").alias("rows"))


def latest_detail(runs: DataFrame, last: int = 20) -> DataFrame:
    """source_id, table, columns, rows: the newest detail of each table among the last OK runs of its source.

    runs: source_id, status, finished, detail (JSON map of table to columns and rows).
    """
    from pyspark.sql import Window

    ok = runs.filter(F.col("status").startswith("ok"))
    newest = ok.withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("finished")))).filter(F.col("_n") <= last)
    shape = "map<string,struct<columns:array<string>,rows:bigint>>"
    flat = newest.select("source_id", "finished", F.explode(F.from_json("detail", shape)).alias("table", "info"))
    picked = flat.groupBy("source_id", "table").agg(F.max_by("info", "finished").alias("info"))
    return picked.select("source_id", "table", F.col("info.columns").alias("columns"), F.col("info.rows").alias("rows"))
