"""What a chart of a result would show: its axis, the series that share a scale, and the rows that fit.

One grouping profiles every column of the result; one row of it comes to the driver and decides. The points are the
last 90 periods or the 25 largest categories, a take-ordered plan over the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scales may differ by so much, series, categories, periods and letters of a label.
TOLERANCE, SERIES, CATEGORIES, PERIODS, LETTERS = 20.0, 3, 25, 90, 22
#: Parts of names that tell of time, how periods are written, the label of what has none.
TEMPORAL = ("fecha", "dia", "día", "mes", "semana", "periodo", "período", "año", "anio", "date")
PERIOD = r"^\s*\d{4}-\d{2}(-\d{2})?\s*$"
EMPTY = "(vacío)"
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


@dataclass(frozen=True)
class Chart:
    """``points``: position, label, values (one double for each of ``series``), kind (line, columns, or bars for long labels)."""

    axis: str
    series: tuple[str, ...]
    apart: tuple[str, ...]  # series of another scale, left out
    temporal: bool
    rows: int
    cut: bool
    points: DataFrame


@dataclass(frozen=True)
class Seen:
    """A column by its place: how many cells are filled, how many of them are written as periods, the largest size of a number."""

    place: int
    name: str
    type: T.DataType
    filled: int
    periods: int
    scale: float

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType) and self.filled > 0

    @property
    def temporal(self) -> bool:
        named = any(word in self.name.lower() for word in TEMPORAL)
        return named or isinstance(self.type, TIMES) or 2 * self.periods > self.filled


def number(column: Column) -> Column:
    """A cell as a double; what is not finite counts as absent."""
    value = column.cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN is above all numbers here


def profile(result: DataFrame) -> tuple[int, list[Seen]]:
    """The number of rows and what was seen of each column, in one pass that shuffles one row a task."""
    fields = result.schema.fields
    placed = result.toDF(*(f"c{i}" for i in range(len(fields))))
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        cell = F.col(f"c{i}")
        numeric = isinstance(field.dataType, T.NumericType)
        sums.append(F.count(number(cell) if numeric else cell).alias(f"filled{i}"))
        if numeric:
            sums.append(F.max(F.abs(number(cell))).alias(f"scale{i}"))
        elif isinstance(field.dataType, T.StringType):
            sums.append(F.count_if(F.rlike(cell, F.lit(PERIOD))).alias(f"periods{i}"))
    row = placed.agg(*sums).first().asDict()
    return row["rows"], [Seen(i, f.name, f.dataType, row[f"filled{i}"], row.get(f"periods{i}", 0), row.get(f"scale{i}") or 1.0) for i, f in enumerate(fields)]


def label(seen: Seen, cell: Column) -> Column:
    if isinstance(seen.type, (T.TimestampType, T.TimestampNTZType)):
        told = F.date_format(cell, "yyyy-MM-dd HH:mm")
    elif isinstance(seen.type, T.DecimalType):
        told = F.format_number(cell, 2)
    else:
        told = cell.cast("string")
    cut = F.left(told, F.lit(LETTERS))
    return F.when(F.coalesce(cut, F.lit("")) == "", EMPTY).otherwise(cut)


def plan(result: DataFrame, order: tuple[str, ...] = ()) -> Chart | None:
    """The chart of a result, or None where it has fewer than two rows or columns or no series.

    The axis is the first column that is not all numbers, else the first; the first three other numeric columns are
    candidates, and those within 20 times of the first one's scale stay. Periods go by the axis, or by ``order``, and
    the last 90 stay; categories go by the size of the first series and the 25 largest stay. Ties go by the axis, then by
    the values; rows alike in both are alike in the chart. Absent numbers, NaN and infinities are 0, absent and empty
    labels are told as such, equal names of columns are told apart by their place, an empty result has no chart.
    """
    rows, seen = profile(result)
    if rows < 2 or len(seen) < 2:
        return None
    axis = next((s for s in seen if not s.numeric), seen[0])
    drawn = [s for s in seen if s.numeric and s is not axis][:SERIES]
    if not drawn:
        return None
    near = [s for s in drawn if 1 / TOLERANCE <= s.scale / drawn[0].scale <= TOLERANCE]

    cell, keys = F.col(f"c{axis.place}"), [F.col(f"o{i}") for i in range(len(order))]
    placed = result.select("*", *(F.col(c) for c in order)).toDF(*(f"c{s.place}" for s in seen), *(f"o{i}" for i in range(len(order))))
    values = F.array(*(F.coalesce(number(F.col(f"c{s.place}")), F.lit(0.0)) for s in near))
    by_axis = cell.cast("string") if isinstance(axis.type, NESTED) else cell
    slim = placed.select(by_axis.alias("_x"), label(axis, cell).alias("label"), values.alias("values"), *keys)
    if axis.temporal:
        ranks, most = [*keys, F.col("_x")], PERIODS
        kept = slim.orderBy(*(k.desc_nulls_last() for k in ranks), F.desc("values")).limit(most)
        ranks = [k.asc_nulls_first() for k in ranks] + [F.asc("values")]
    else:
        ranks, most = [F.abs(F.col("values")[0]).desc(), F.col("_x").asc_nulls_first(), F.asc("values")], CATEGORIES
        kept = slim.orderBy(*ranks).limit(most)
    # both windows run over the 90 rows at most that are left
    long = F.max(F.length("label")).over(Window.partitionBy()) > 10
    kind = F.lit("line") if axis.temporal else F.when(long, "bars").otherwise("columns")
    points = kept.select(F.row_number().over(Window.orderBy(*ranks)).cast("long").alias("position"), "label", "values", kind.alias("kind"))
    return Chart(axis.name, tuple(s.name for s in near), tuple(s.name for s in drawn if s not in near), axis.temporal, rows, rows > most, points)
