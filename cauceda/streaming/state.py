"""State that depends on the order of a key's events: throttling and delivery, in batch and as streams.

In batch Spark sorts the events of each partition by key and time and the fold goes through them batch by batch, so
a key may have any number of events. As a stream the same folds run on state that Spark keeps by key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Delivery states by rank.
RANK = {"aceptado": 0, "sent": 1, "delivered": 2, "read": 3}


def admit(times: list[float], held: deque, most: int, seconds: float) -> list[bool]:
    """Which of a key's events pass: at most ``most`` admitted ones in any ``seconds``; denied ones do not count."""
    out = []
    for t in times:
        while held and held[0] <= t - seconds:
            held.popleft()
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out


def same(a, b) -> bool:
    """Whether two keys are one, as Spark groups them: a NaN equals a NaN."""
    return a == b or (a != a and b != b)


def throttle(events: DataFrame, key: str, ts: str, row_id: str, most: int = 12, seconds: float = 60) -> DataFrame:
    """row_id, admitted for every event. A task holds one batch, its key and the key's last admitted times.

    Events without a time come last, events without a key are one key's.
    """
    rows = events.select(F.col(key).alias("key"), F.col(row_id).alias("row_id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, deque()
        for batch in batches:
            keys, times, passed = batch.column(0).to_pylist(), [float("nan") if t is None else t for t in batch.column(2).to_pylist()], []
            while len(passed) < len(keys):
                begin = end = len(passed)
                if not same(keys[begin], now):
                    now, held = keys[begin], deque()
                while end < len(keys) and same(keys[end], now):
                    end += 1
                passed += admit(times[begin:end], held, most, seconds)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(passed, pa.bool_())], ["row_id", "admitted"])

    order = [F.col("key"), F.col("at").asc_nulls_last(), F.col("row_id").asc_nulls_last()]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, f"row_id {kind}, admitted boolean")


def throttle_stream(events: DataFrame, key: str, ts: str, row_id: str, most: int = 12, seconds: float = 60, late: str = "1 hour") -> DataFrame:
    """As ``throttle`` over a stream, in which events come at most ``late``. A key's state goes once the watermark has
    passed its last admitted event by ``seconds``."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(row_id).alias("row_id"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.withColumn("at", F.unix_micros("ts") / 1e6).withWatermark("ts", late)
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        group = pd.concat(list(batches)).sort_values(["at", "row_id"])
        passed = admit(group["at"].tolist(), held, most, seconds)
        state.update((list(held),))
        last = max((t for t in held if t == t), default=0.0)
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"row_id": group["row_id"], "admitted": passed})

    return rows.groupBy("key").applyInPandasWithState(run, f"row_id {kind}, admitted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def delivery(events: DataFrame) -> DataFrame:
    """message_id, state: never back to a lower one; failed is final, unless delivery was known before it.

    events: message_id, position, status. One grouping with partial aggregates: what decides is whether the first
    failure comes before the first delivery, and the highest rank otherwise.
    """
    ranks = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))
    rank = F.try_element_at(ranks, F.col("status"))
    failed = F.min(F.when(F.col("status") == "failed", F.col("position")))
    arrived = F.min(F.when(rank >= 2, F.col("position")))
    out = events.filter((F.col("status") == "failed") | rank.isNotNull()).groupBy("message_id")
    out = out.agg(failed.alias("_failed"), arrived.alias("_arrived"), F.max(F.coalesce(rank, F.lit(0))).alias("_rank"))
    lost = F.col("_failed").isNotNull() & (F.col("_arrived").isNull() | (F.col("_failed") < F.col("_arrived")))
    names = F.array(*map(F.lit, RANK))
    return out.select("message_id", F.when(lost, F.lit("failed")).otherwise(F.get(names, F.col("_rank"))).alias("state"))


def admitted_by_day(events: DataFrame, key: str, ts: str, order: str, most: int) -> DataFrame:
    """The first ``most`` events of each key and day."""
    place = F.row_number().over(Window.partitionBy(key, F.to_date(ts)).orderBy(ts, order))
    return events.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
