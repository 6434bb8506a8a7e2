"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauceda.llm.common import discard, materialize

#: Nodes of a task's own edges that it holds at once, about.
NODES = 250_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour, itself included. ``edges`` are removed."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")
    linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    made = materialize(linked.distinct(), "edges")
    discard(edges, least)
    return made


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the smallest of them. Here b < a. ``edges`` are removed."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    linked = below.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b")
    made = materialize(linked.distinct(), "edges")
    discard(edges, least)
    return made


def _stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node at most, and none that is linked so has nodes above it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    found = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return found.filter("below > 1 OR below + above > 1").isEmpty()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars, so many nodes at a time as bound its memory."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    def out() -> pa.RecordBatch:
        linked = [(x, r) for x in list(above) if (r := root(x)) != x]
        a, b = zip(*linked, strict=True) if linked else ((), ())
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
        if len(above) > NODES:
            yield out()
    yield out()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b) that is not its own smallest.

    Each task first turns its own edges into stars. Each round is two groupings with partial minima and two joins.
    Minima are written before they are joined, so that a join's sides are plain shuffles and Spark can split the one
    of a hub, whatever its degree. The number of rounds grows with the logarithm of the longest path.
    """
    now = edges.filter("a <> b").select("a", "b").mapInArrow(forest, "a long, b long")
    now = materialize(now.distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = _small_star(_large_star(now))
    raise RuntimeError("the components did not settle")
