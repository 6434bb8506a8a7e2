"""Lookups in auxiliary tables: first match wins, by a transformed key, maybe within a validity interval.

The auxiliary side is reduced to one row per key before the join, so the join never multiplies rows. With intervals a
key is a key and a day: intervals are cut into blocks of 1, 16, 256 ... days, of each block the first interval is kept,
and every distinct day of a key looks its six blocks up. A key with n rows and m intervals thus costs n + m rows and not
n x m. Whether a side is broadcast is Spark's choice by its measured size; where it is not, a hot key can be split.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import dates, text

KEYS = {"exact": lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))), "folded": text.fold, "last4": text.last_digits}
#: Days of a block of each level over those of the level below, and the levels: 16^6 days are more than a date can reach.
WIDTH, LEVELS = 16, 6


@dataclass
class Lookup:
    """Where to look, by what, for what. ``order`` decides which of several matches is first."""

    table: str
    base: str
    key: str
    outputs: list[str]
    order: str
    transform: str = "exact"
    base_date: str = ""
    valid_from: str = ""
    valid_to: str = ""
    active: str = ""


def _day(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.to_date(column) if kind in ("date", "timestamp", "timestamp_ntz") else F.to_date(dates.parse_date(F.col(column)))


def per_key(side: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """One row a key, grouped by the keys as one struct: a join by the keys shuffles these few rows once more.

    A join that takes over the partitions of a grouping is never split by adaptive execution; one with a shuffle on
    either side is, so that a key which holds a third of the other side is read by many tasks.
    """
    found = side.groupBy(F.struct(*keys).alias("_by")).agg(*values)
    return found.select(*(F.col(f"_by.{k}").alias(k) for k in keys), *(c for c in found.columns if c != "_by"))


def _run(low: Column, end: Column) -> Column:
    return F.when(low < end, F.sequence(low, end - 1)).otherwise(F.array().cast("array<int>"))


def _at(level: int, block: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), block.alias("block"))


def blocks(low: Column, end: Column) -> Column:
    """array of struct(level, block): the days from ``low`` to before ``end`` as whole blocks of 16^level days, the largest that fit.

    An interval makes at most 30 blocks a level, none where it ends before it begins.
    """
    out = []
    for level in range(LEVELS):
        inner = [(F.ceil(low / w).cast("int"), F.floor(end / w).cast("int")) for w in (WIDTH**level, WIDTH ** (level + 1))]
        (first, last), (a, b) = inner
        cells = _run(first, last)
        if level + 1 < LEVELS:  # what the level above covers is left to it
            cells = F.when(a < b, F.concat(_run(first, a * WIDTH), _run(b * WIDTH, last))).otherwise(cells)
        out.append(F.transform(cells, partial(_at, level)))
    return F.concat(*out)


def _number(day: Column) -> Column:
    return F.datediff(day, F.lit("0001-01-01").cast("date"))


def _valid(base: DataFrame, side: DataFrame) -> DataFrame:
    """_key, _day, _out: the first interval of ``side`` that holds on each distinct day of each key of ``base``."""
    first = (F.min_by("_out", "_order").alias("_out"), F.min("_order").alias("_order"))
    low, end = F.coalesce(_number(F.col("_from")), F.lit(0)), F.coalesce(_number(F.col("_to")) + 1, F.lit(WIDTH**LEVELS))
    cut = side.select("_key", "_out", "_order", F.inline(blocks(low, end))).groupBy("_key", "level", "block").agg(*first)
    days = base.filter("_key IS NOT NULL AND _day IS NOT NULL").select("_key", "_day").distinct()
    own = F.array(*(_at(k, F.floor(_number(F.col("_day")) / WIDTH**k).cast("int")) for k in range(LEVELS)))
    met = days.select("_key", "_day", F.inline(own)).join(cut, ["_key", "level", "block"])
    return per_key(met, ["_key", "_day"], first[0])


def lookup(df: DataFrame, aux: DataFrame, how: Lookup, row_id: str, only_missing: bool = False) -> DataFrame:
    """``df`` with the outputs of the first matching row of ``aux``; ``row_id`` names its rows.

    With ``only_missing`` rows that already have all outputs keep them; other rows keep what they have where
    nothing matches. Blank keys and unreadable days match nothing; an interval without an end is open there.
    """
    side = aux.filter(text.is_yes(F.col(how.active), blank=True)) if how.active else aux
    key = KEYS[how.transform]
    outputs = F.struct(*(F.col(c) for c in how.outputs)).alias("_out")
    side = side.withColumn("_key", key(F.col(how.key))).filter("_key <> ''")
    base = df.withColumn("_key", F.nullif(key(F.col(how.base)), F.lit("")))
    if how.base_date:
        interval = [(_day(aux, c) if c else F.lit(None).cast("date")).alias(n) for c, n in ((how.valid_from, "_from"), (how.valid_to, "_to"))]
        side = side.select("_key", outputs, F.col(how.order).alias("_order"), *interval)
        base = base.withColumn("_day", _day(df, how.base_date))
        found = base.join(_valid(base, side), ["_key", "_day"], "left")
    else:
        first = per_key(side.select("_key", outputs, F.col(how.order).alias("_order")), ["_key"], F.min_by("_out", "_order").alias("_out"))
        found = base.join(first, "_key", "left")
    kept = []
    for c in how.outputs:
        new = F.col(f"_out.{c}")
        if c in df.columns:
            whole = F.lit(True)
            for o in how.outputs:
                whole = whole & ~text.is_blank(F.col(o)) if o in df.columns else F.lit(False)
            new = F.when(whole, F.col(c)).otherwise(F.coalesce(new, F.col(c))) if only_missing else F.coalesce(new, F.col(c))
        kept.append(new.alias(c))
    return found.select(*(c for c in df.columns if c not in how.outputs), *kept)


def chain(df: DataFrame, tables: dict[str, DataFrame], lookups: list[Lookup], row_id: str, only_missing: bool = False) -> DataFrame:
    """Lookups in order of declaration: each sees the outputs of those before it."""
    for how in lookups:
        df = lookup(df, tables[how.table], how, row_id, only_missing)
    return df


def by_any_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str, out: str) -> DataFrame:
    """The ``value`` of the first of several alternative keys that matches: one equi-join a key, no OR-join.

    Blank keys match nothing; of equal keys on the right the smallest value counts.
    """
    found = []
    for i, (a, b) in enumerate(keys):
        side = per_key(right.filter(~text.is_blank(F.col(b))).withColumn(f"_k{i}", F.col(b)), [f"_k{i}"], F.min(value).alias(f"_v{i}"))
        left = left.join(side, left[a] == side[f"_k{i}"], "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return left.withColumn(out, F.coalesce(*found)).drop(*found)
