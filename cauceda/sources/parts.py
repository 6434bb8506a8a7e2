"""Sources of several parts (calendars, accounts), each a folder of JSON texts, one record a line: one that fails stops no other.

A part fails whose path does not exist or cannot be read, or which holds a damaged record: a line that is not blank and
no JSON object. All parts are counted by one grouping; only where Spark cannot read some file are they counted one by
one, to know whose it is. With ``damaged="part"`` a part with a damaged record is left out whole, so that what is stored
of it is not taken for gone; with ``"record"`` only those records are, and how many they were is observed while the rows
are written, without a pass of its own. A source without one good part raises; with ``may_be_empty`` it has no rows where
parts could be read and all of them were left out as damaged, and the alerts tell so.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

HOW = ("part", "record")
#: What a job raises that fails in its planning or in a task.
FAULTS = (PySparkException, Py4JJavaError)


@dataclass
class Parts:
    """part, record: the good records. ``alerts`` is what was known when the parts were opened."""

    rows: DataFrame
    alerts: list[str]
    names: list[str]
    seen: Observation | None = field(default=None, repr=False)

    def told(self) -> list[str]:
        """All alerts; with ``damaged="record"`` only once an action has read ``rows``, for which it waits."""
        if self.seen is None:
            return self.alerts
        found = self.seen.get
        return self.alerts + [a for i, name in enumerate(self.names) for a in _said(name, found[f"records_{i}"], found[f"damaged_{i}"], "record")]


def is_damaged(record: Column) -> Column:
    """Whether a line is neither blank nor a JSON object."""
    whole = F.try_parse_json(record).isNotNull() & F.ltrim(record).startswith("{")
    return (F.trim(record) != "") & ~whole


def _said(name: str, records: int, damaged: int, how: str) -> list[str]:
    if damaged:
        return [f"{name}: {damaged} of {records} records are damaged, " + ("the whole part is left out" if how == "part" else "they are left out")]
    return [] if records else [f"{name}: no record came"]


def _short(error: Exception) -> str:
    return f"{type(error).__name__}: {' '.join(str(error).split())[:200]}"


def _counted(lines: DataFrame) -> dict[str, tuple[int, int]]:
    rows = lines.groupBy("part").agg(F.count("*").alias("n"), F.count_if(is_damaged(F.col("record"))).alias("damaged")).collect()
    return {r["part"]: (r["n"], r["damaged"]) for r in rows}


def read_parts(spark: SparkSession, paths: dict[str, str], damaged: str = "part", may_be_empty: bool = False) -> Parts:
    """The records of the parts that can be read. paths: name of a part -> path of its files. Blank lines are no records."""
    if damaged not in HOW:
        raise ValueError(f"damaged is one of {', '.join(HOW)}")
    opened, alerts = {}, []
    for name, path in paths.items():
        try:
            lines = spark.read.text(path).select(F.lit(name).alias("part"), F.col("value").alias("record"))
            opened[name] = lines.filter(F.trim("record") != "")
        except FAULTS as error:
            alerts.append(f"{name}: cannot be read: {_short(error)}")

    def together() -> DataFrame:
        if not opened:
            raise RuntimeError(f"none of the {len(paths)} parts could be read: {'; '.join(alerts)}")
        return reduce(DataFrame.unionByName, opened.values())

    if damaged == "record":
        seen = Observation()
        own = list(opened)
        bad = is_damaged(F.col("record"))
        counts = [c for i, n in enumerate(own) for c in (F.count_if(F.col("part") == n).alias(f"records_{i}"), F.count_if((F.col("part") == n) & F.col("_bad")).alias(f"damaged_{i}"))]
        rows = together().withColumn("_bad", bad).observe(seen, *counts).filter(~F.col("_bad")).drop("_bad")
        return Parts(rows, alerts, own, seen)
    try:
        counts = _counted(together())
    except FAULTS:  # some file cannot be read: whose?
        counts = {}
        for name in list(opened):
            try:
                counts |= _counted(opened[name])
            except FAULTS as error:
                alerts.append(f"{name}: cannot be read: {_short(error)}")
                del opened[name]
    readable = list(opened.values())
    for name in list(opened):
        records, bad = counts.get(name, (0, 0))
        alerts += _said(name, records, bad, "part")
        if bad:
            del opened[name]
    if readable and not opened and may_be_empty:
        return Parts(readable[0].limit(0), alerts, [])
    return Parts(together(), alerts, list(opened))
