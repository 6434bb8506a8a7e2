"""Drafts that are sent once, on a confirmation that comes in time and within quotas: in batch and as a stream.

A sender's events are drafts and confirmations. A confirmation sends its draft if there is one, it was not sent yet, it
has not lapsed, and the sender has confirmed fewer than ``hourly`` in the hour and ``daily`` in the day before. Every
event has an outcome: ``drafted``, ``sent``, ``repeated``, ``unknown``, ``expired``, ``hour`` or ``day``; a draft that a quota
holds back may be confirmed again. A draft that lapses unsent has an outcome of its own, ``lapsed``, at its last moment.

In batch Spark sorts each partition by sender and time and the fold goes through it batch by batch, so a sender may have
any number of events; what is remembered of a sender is its open drafts and a day of confirmations. As a stream
the same fold runs on state that Spark keeps by sender, and a timer at each draft's last moment ends it. A sent
draft is remembered until it would have lapsed, and a confirmation of it after that is ``unknown``, as of any that is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR, DAY = 3_600_000, 86_400_000
OUT = "sender string, message string, at long, outcome string"


@dataclass(frozen=True)
class Rules:
    """Times in milliseconds. A null quota allows any number."""

    ttl: int
    hourly: int | None = None
    daily: int | None = None


@dataclass
class Held:
    """What is remembered of a sender: drafts (message to last moment, and whether it was sent) and confirmation times."""

    drafts: dict[str, tuple[int, bool]] = field(default_factory=dict)
    sent: list[int] = field(default_factory=list)

    def lapse(self, now: int) -> list[tuple[str, int]]:
        """Forget drafts whose last moment is before ``now``; those that were not sent, by that moment."""
        over = sorted((end, m) for m, (end, _) in self.drafts.items() if end < now)
        out = [(m, end) for end, m in over if not self.drafts[m][1]]
        for _, m in over:
            del self.drafts[m]
        return out

    def meet(self, kind: str, message: str, at: int, rules: Rules) -> str:
        """The outcome of one event, once drafts that lapsed before it are forgotten."""
        known = self.drafts.get(message)
        if kind == "draft":
            if known:
                return "repeated"
            self.drafts[message] = (at + rules.ttl, False)
            return "drafted"
        if known is None:
            return "unknown"
        if known[1]:
            return "repeated"
        self.sent = [t for t in self.sent if t > at - DAY]
        if rules.hourly is not None and sum(t > at - HOUR for t in self.sent) >= rules.hourly:
            return "hour"
        if rules.daily is not None and len(self.sent) >= rules.daily:
            return "day"
        if rules.hourly is not None or rules.daily is not None:
            self.sent.append(at)
        self.drafts[message] = (known[0], True)
        return "sent"


def events_of(df: DataFrame, sender: str, message: str, kind: str, ts: str, order: str) -> DataFrame:
    """sender, message, kind, at, place: the columns that the fold reads; rows without a sender, message or time are left out."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    rows = df.select(F.col(sender).cast("string").alias("sender"), F.col(message).cast("string").alias("message"), F.col(kind).alias("kind"), at.alias("at"), F.col(order).cast("long").alias("place"))
    return rows.filter("sender IS NOT NULL AND message IS NOT NULL AND at IS NOT NULL")


def settle(events: DataFrame, rules: Rules, until: int | None = None) -> DataFrame:
    """sender, message, at, outcome for every event of ``events_of``, and for every draft that lapsed before ``until`` or a later event."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Held()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["sender", "message", "at", "outcome"])

        def ended() -> list[tuple]:
            return [(now, m, end, "lapsed") for m, end in held.lapse(until)] if until is not None else []

        for batch in batches:
            out = []
            for sender, message, kind, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if sender != now:
                    out += ended()
                    now, held = sender, Held()
                out += [(now, m, end, "lapsed") for m, end in held.lapse(at)]
                out.append((sender, message, at, held.meet(kind, message, at, rules)))
            yield table(out)
        yield table(ended())

    return events.repartition("sender").sortWithinPartitions("sender", "at", "place").mapInArrow(run, OUT)


class Settling(StatefulProcessor):
    """The fold on Spark's state: a map of drafts, the confirmations of a day, and a timer for each draft."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.drafts = handle.getMapState("drafts", "message string", "last long, sent boolean")
        self.sent = handle.getValueState("sent", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = Held({k[0]: (v[0], v[1]) for k, v in self.drafts.iterator()}, list(self.sent.get()[0]) if self.sent.exists() else [])
        before, out = dict(held.drafts), []
        group = pd.concat(list(rows)).sort_values(["at", "place"])
        for message, kind, at in zip(group["message"], group["kind"], group["at"].tolist(), strict=True):
            out += [(key[0], m, end, "lapsed") for m, end in held.lapse(at)]
            out.append((key[0], message, at, held.meet(kind, message, at, self.rules)))
        for m in before.keys() - held.drafts.keys():
            self.drafts.removeKey((m,))
        for m, value in held.drafts.items():
            if before.get(m) != value:
                self.drafts.updateValue((m,), value)
                self.handle.registerTimer(value[0] + 1)
        self.sent.update((held.sent,))
        yield pd.DataFrame(out, columns=["sender", "message", "at", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = Held({k[0]: (v[0], v[1]) for k, v in self.drafts.iterator()})
        before = list(held.drafts)
        out = [(key[0], m, end, "lapsed") for m, end in held.lapse(expiredTimerInfo.getExpiryTimeInMs())]
        for m in before:
            if m not in held.drafts:
                self.drafts.removeKey((m,))
        if not held.drafts and self.sent.exists():  # nothing is open, but a day's confirmations may still count
            last = max(self.sent.get()[0], default=0)
            if last + DAY < expiredTimerInfo.getExpiryTimeInMs():
                self.sent.clear()
            elif last:
                self.handle.registerTimer(last + DAY + 1)
        yield pd.DataFrame(out, columns=["sender", "message", "at", "outcome"])

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame, rules: Rules, late: str = "1 hour") -> DataFrame:
    """As ``settle`` over a stream of ``events_of`` whose events come at most ``late``; needs the state store that has columns (RocksDB)."""
    rows = events.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return rows.groupBy("sender").transformWithStateInPandas(Settling(rules), outputStructType=OUT, outputMode="append", timeMode="eventTime")
