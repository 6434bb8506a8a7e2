"""Numbering rows in a global order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauceda.llm.common import materialize

_ROWS = 33  # bits of monotonically_increasing_id() that number the rows of a partition


def ascending(column: str) -> Column:
    return F.col(column).asc_nulls_first()


def numbered(rows: DataFrame, order: list[Column], group: str | None = None, name: str = "numbered") -> DataFrame:
    """The columns of ``rows`` with ``at``, the place (from 0) in its group by ``order``, and ``of``, the group's size.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks; each partition numbers its
    own rows, and a row for each partition and group says how many precede it. A null is a group like others. Rows
    that tie in ``order`` are numbered in some order: what is written holds for all later reads. ``rows`` is read
    twice, once to sample the ranges, so it should be a written table. It may not have columns named ``at``, ``of`` or ``run``.
    """
    keys = ([ascending(group)] if group else []) + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    written = materialize(placed, name).withColumn("run", F.shiftrightunsigned("at", _ROWS))
    own = [F.col(group).alias("group")] if group else []
    runs = written.groupBy(F.col("run").alias("part"), *own).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("group") if group else Window.partitionBy()
    before = F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = runs.select("part", *(["group"] if group else []), (before - F.col("first")).alias("base"), F.sum("n").over(every).alias("of"))
    same = F.col("run") == F.col("part")
    if group:
        same &= F.col(group).eqNullSafe(F.col("group"))
    found = written.join(bases, same)
    return found.select(*rows.columns, (F.col("at") + F.col("base")).alias("at"), "of")
