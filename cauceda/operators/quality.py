"""Guards on what is about to be written, and the log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import text

DROP = 0.5


def review(previous: DataFrame, current: DataFrame) -> DataFrame:
    """table, blocked, dropped, added, missing for every table of ``current``. Both: table, columns, rows.

    A table that had rows and now has none is blocked; one that lost over half of them is reported; columns that
    came or went are listed.
    """
    was = previous.select("table", F.col("columns").alias("_columns"), F.col("rows").alias("_rows"))
    met = current.join(was, "table", "left")
    before = F.coalesce("_rows", F.lit(0))
    known = F.col("_columns").isNotNull()
    none = F.array().cast("array<string>")
    return met.select(
        "table",
        ((F.col("rows") == 0) & (before > 0)).alias("blocked"),
        ((F.col("rows") > 0) & (F.col("rows") < DROP * before)).alias("dropped"),
        F.when(known, F.array_sort(F.array_except("columns", "_columns"))).otherwise(none).alias("added"),
        F.when(known, F.array_sort(F.array_except("_columns", "columns"))).otherwise(none).alias("missing"),
    )


def fresh(runs: DataFrame, now: Column, minutes: Column) -> DataFrame:
    """source_id, last_ok, fresh: whether the last OK run is younger than ``minutes``; 0 is never fresh."""
    last = runs.filter(F.col("status").startswith("ok")).groupBy("source_id").agg(F.max("finished").alias("last_ok"), F.max(minutes).alias("_minutes"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_ok").cast("timestamp"))
    return last.select("source_id", "last_ok", ((F.col("_minutes") > 0) & (age < F.col("_minutes") * 60)).alias("fresh"))


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"))


def state(blocked: bool, alerts: list[str], wrote: bool = True) -> str:
    """The state a source's run ends in."""
    if not wrote:
        return "skipped"
    return "ok_with_block" if blocked else "ok_with_alerts" if alerts else "ok"


def mixed(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The first ``most`` distinct filled values of a column in order, and whether there is more than one."""
    first = df.filter(~text.is_blank(F.col(column))).select(column).distinct().orderBy(column).limit(max(most, 2))
    values = F.array_sort(F.collect_list(column))  # ``most`` at most
    return first.agg(F.slice(values, 1, most).alias("values"), (F.size(values) > 1).alias("mixed"))


def visible_rows(catalog: DataFrame, loaded: list[str], every: bool) -> DataFrame:
    """Catalog rows whose listed tables were loaded: all of them, or any."""
    named, have = text.items(F.col("table"), ";"), F.array(*map(F.lit, loaded)).cast("array<string>")
    fits = F.forall(named, lambda t: F.array_contains(have, t)) if every else F.arrays_overlap(named, have)
    return catalog.filter((F.size(named) > 0) & fits)
