"""Runs of sources: read, compare with the last good run, write or hold back, log. One source's fault stops no other."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.functions import naming
from cauceda.operators import quality, upsert
from cauceda.sources.sinks import RUN_LOG, with_lineage


@dataclass
class Growing:
    """A table that is read by windows: its rows are upserted, and an empty window is nothing to hold back."""

    keys: list[str]
    content: list[str]
    options: dict = field(default_factory=dict)


@dataclass
class Source:
    """``load`` gives tables by name and what there is to tell about the reading."""

    source_id: str
    load: Callable[[SparkSession], tuple[dict[str, DataFrame], list[str]]]
    fresh_minutes: int = 0
    growing: dict[str, Growing] = field(default_factory=dict)


@dataclass
class Run:
    run_id: str
    source_id: str
    started: dt.datetime
    status: str = "error"
    rows: int = 0
    detail: dict = field(default_factory=dict)
    alerts: list[str] = field(default_factory=list)
    error: str = ""


def runs_of(house, source_id: str) -> DataFrame:
    name = f"{house.meta}.runs"
    runs = house.spark.table(name) if house.exists(name) else house.spark.createDataFrame([], RUN_LOG)
    return runs.filter(F.col("source_id") == source_id)


def told(found, before: int, rows: int) -> list[str]:
    """What a review says about one table, in words."""
    out = []
    if found["added"] or found["missing"]:
        out.append(f"{found['table']}: columns came: {', '.join(found['added']) or 'none'}; went: {', '.join(found['missing']) or 'none'}")
    if found["blocked"]:
        out.append(f"{found['table']}: empty, it had {before} rows; not written")
    if found["dropped"]:
        out.append(f"{found['table']}: from {before} rows to {rows}")
    return out


def run_source(house, source: Source, force: bool = False, dry: bool = False) -> Run:
    """One run of one source. A fresh source is not read. ``dry`` counts and writes nothing, not even the log.

    A table is written aside, counted and compared with the newest good run that saw it. If it is empty and was not,
    the old one stays, and so does its entry in the detail: the guard holds however often the source comes back empty.
    """
    spark = house.spark
    run = Run(uuid.uuid4().hex[:12], source.source_id, dt.datetime.now(dt.UTC))
    asides: dict[str, str] = {}
    try:
        log = runs_of(house, source.source_id)
        seen = quality.fresh(log, F.lit(run.started), F.lit(source.fresh_minutes)).first()
        if seen and seen["fresh"] and not (force or dry):
            run.status = "skipped"
            return run
        before = {r["table"]: {"columns": r["columns"], "rows": r["rows"]} for r in upsert.latest_detail(log).collect()}
        tables, alerts = source.load(spark)
        run.alerts += alerts
        blocked = False
        for table, df in tables.items():
            name = naming.raw_table(source.source_id, table)
            full, growing = f"{house.raw}.{name}", source.growing.get(table)
            if growing:
                rows = df.count() if dry else sum(n for action, n in house.upsert(df, full, growing.keys, growing.content, run.run_id, **growing.options).items() if action != "kept")
            elif dry:
                rows = df.count()
            else:
                asides[full] = house.stage(with_lineage(df, run.run_id, source.source_id, F.lit(run.started)), full)
                rows = spark.table(asides[full]).count()
            shape = "table string, columns array<string>, rows long"
            old = spark.createDataFrame([(name, before[name]["columns"], before[name]["rows"])] if name in before and not growing else [], shape)
            found = quality.review(old, spark.createDataFrame([(name, df.columns, rows)], shape)).first()
            run.alerts += told(found, before.get(name, {}).get("rows", 0), rows)
            if found["blocked"]:
                blocked = True
                run.detail[name] = before[name]
                continue
            if full in asides:
                house.publish(asides.pop(full), full)
            run.detail[name] = {"columns": df.columns, "rows": rows}
            run.rows += rows
        run.status = quality.state(blocked, run.alerts)
    except Exception as error:  # a source's fault stops no other
        run.status, run.error = "error", f"{type(error).__name__}: {' '.join(str(error).split())[:300]}"
    finally:
        for aside in asides.values():
            house.drop(aside)
        if not dry:
            note = {"error": run.error} if run.error else run.detail
            house.log_run(run_id=run.run_id, source_id=run.source_id, status=run.status, started=run.started, finished=dt.datetime.now(dt.UTC), rows=run.rows, detail=json.dumps(note), alerts="\n".join(run.alerts))
    return run


def run_all(house, sources: list[Source], force: bool = False, dry: bool = False) -> list[Run]:
    """Every source in turn; of sources with one id only the first runs, and the others are errors."""
    out, seen = [], set()
    for source in sources:
        if source.source_id in seen:
            out.append(Run("", source.source_id, dt.datetime.now(dt.UTC), error="another source has this id"))
            continue
        seen.add(source.source_id)
        out.append(run_source(house, source, force, dry))
    return out
