"""Period series, rates and reductions for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def monthly(df: DataFrame, date: str, value: Column) -> DataFrame:
    """period, total: one row a month. The rows are summed before anything is shuffled."""
    return df.groupBy(F.to_date(F.date_trunc("month", F.col(date))).alias("period")).agg(value.alias("total"))


def variation(series: DataFrame, period: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``series`` with the difference and percent change to the period before. It has one row a period and group."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(period))
    change = F.round(100 * F.try_divide(F.col(value) - before, F.nullif(before, F.lit(0.0))), 2)
    return series.withColumns({"difference": F.round(F.col(value) - before, 2), "variation": change})


def summary(series: DataFrame, period: str, value: str) -> DataFrame:
    """One row: how often the value rose, fell and stayed, its first and last, and the change between them."""
    step = F.col(value) - F.lag(value).over(Window.orderBy(period))
    marked = series.withColumn("_step", step)
    first, last = F.min_by(value, period), F.max_by(value, period)
    return marked.agg(
        F.count_if(F.col("_step") > 0).alias("rises"), F.count_if(F.col("_step") < 0).alias("falls"), F.count_if(F.col("_step") == 0).alias("equal"),
        first.alias("first"), last.alias("last"), F.round(100 * F.try_divide(last - first, F.nullif(first, F.lit(0.0))), 2).alias("change"),
    )


def recent_count(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``df`` with the number of events of the same key in the ``seconds`` before each, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("_at", at).withColumn("recent", F.count("*").over(span)).drop("_at")


def last_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def top_by_size(df: DataFrame, value: str, n: int = 25, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows of largest absolute value; a take-ordered plan, no full sort."""
    return df.orderBy(F.abs(F.col(value)).desc(), *ties).limit(n)


def last_periods(df: DataFrame, period: str, n: int = 90) -> DataFrame:
    return df.orderBy(F.desc(period)).limit(n).orderBy(period)


def within_budget(df: DataFrame, order: str, text: str, most: int) -> DataFrame:
    """The first rows whose texts, a line break after each, come to at most ``most`` characters.

    Meant for results that are capped already: the running sum is one ordered pass.
    """
    used = F.sum(F.length(text) + 1).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).filter(F.col("used") <= most)


def with_subtotals(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group and grand totals beside each row: grouped sums joined back, so no group is one task."""
    parts = df.groupBy(group).agg(F.sum(value).alias("group_total"))
    whole = parts.agg(F.sum("group_total").alias("grand_total"))
    return df.join(parts, group).crossJoin(F.broadcast(whole))  # one row
