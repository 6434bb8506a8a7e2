"""Paged JSON as a Spark data source: a task for each page, an end that is an empty page, a cap that tells when it cuts.

The payloads of a service's pages lie under a folder, one file a page; a page's number follows the word ``page`` in its
path (``page=7/...``, ``page-0007.json``). Spark plans a partition for each page up to the cap and each task gives its
page's records as JSON texts. A page that holds no record gives one row without a record, a page that cannot be read
one row with the error, so that what ends the reading and what was lost is known from the rows themselves: the first
empty or absent page ends the list, whatever comes after it, and one damaged page does not lose the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cauceda.sources.files import flat

NUMBER = re.compile(r"page[=_-]?0*(\d+)", re.I)
SCHEMA = "page long, place int, record string, error string"
#: Records that one batch of a task has at most.
BATCH = 2000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Page(InputPartition):
    def __init__(self, page: int, files: list[str]):
        super().__init__(page)
        self.page, self.files = page, files


def list_at(payload, path: str) -> list:
    """The records at a dotted path: a list as it is, a single object as one record, nothing as none."""
    for part in filter(None, path.split(".")):
        if not isinstance(payload, dict):
            raise ValueError(f"{part!r} of the path {path!r} is not in an object")
        payload = payload.get(part)
    return [] if payload is None else payload if isinstance(payload, list) else [payload]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], options.get("records", "")
        self.first, self.cap = int(options.get("first", 1)), int(options.get("maxpages", 1000))
        self.low, self.high = self.first, self.first + self.cap - 1

    def partitions(self) -> list[InputPartition]:
        """A page each, from the first to the cap or to the one after the last file, which then is the empty end."""
        store, root = pafs.FileSystem.from_uri(self.path)
        found: dict[int, list[str]] = {}
        for info in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path[len(root) :]
            if info.is_file and not re.search(r"/[._][^/]*$", name) and (m := NUMBER.search(name)):
                found.setdefault(int(m[1]), []).append(info.path)
        end = min(max(found, default=self.first - 1) + 1, self.high)
        return [Page(n, sorted(found.get(n, []))) for n in range(self.low, max(end, min(self.low, self.high)) + 1)]

    def read(self, partition: Page | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there is no partition
            return
        kinds = pa.schema([("page", pa.int64()), ("place", pa.int32()), ("record", pa.string()), ("error", pa.string())])

        def rows(records: list[str | None], error: str | None = None, at: int = 0) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays([pa.array([partition.page] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), pa.array(records, pa.string()), pa.array([error] * n, pa.string())], schema=kinds)

        records: list = []
        try:
            store, _ = pafs.FileSystem.from_uri(self.path)
            for file in partition.files:
                with store.open_input_stream(file) as source:
                    records += list_at(json.loads(source.readall()), self.records)
        except (ValueError, OSError) as error:
            yield rows([None], f"{type(error).__name__}: {error}"[:300])
            return
        if not records:
            yield rows([None])
        for at in range(0, len(records), BATCH):
            yield rows([json.dumps(r, ensure_ascii=False) for r in records[at : at + BATCH]], at=at)


class ChoosingReader(Reader):
    """For sessions that push filters to data sources written in Python; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``page`` choose the pages that are planned; the others are Spark's."""
        for f in filters:
            kind, whole = type(f), isinstance(getattr(f, "value", None), int)
            if getattr(f, "attribute", None) != ("page",) or not whole or kind not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                self.low = max(self.low, f.value + (kind is GreaterThan))
            if kind in (EqualTo, LessThan, LessThanOrEqual):
                self.high = min(self.high, f.value - (kind is LessThan))


class JsonPages(DataSource):
    """Options: ``path``, ``records`` (dotted path of the list), ``first`` (number of the first page), ``maxPages``, ``pushed``."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        if not self.options.get("path"):
            raise ValueError("json_pages needs a path")
        options = {k.lower(): v for k, v in self.options.items()}
        return (ChoosingReader if options.get("pushed") == "true" else Reader)(options)


@dataclass
class Read:
    rows: DataFrame
    alerts: list[str]


def raw_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """page, place, record (JSON text), error: all pages up to the cap, with the rows that mark empty and damaged ones."""
    spark.dataSource.register(JsonPages)
    return spark.read.format("json_pages").options(path=path, pushed=spark.conf.get(PUSHDOWN, "false"), **options).load()


def read_pages(spark: SparkSession, path: str, schema: T.StructType | str, records: str = "", first: int = 1, max_pages: int = 1000, damaged: str = "raise") -> Read:
    """The records of all pages before the first empty one, flattened, with ``page``; and what there is to tell.

    ``damaged``: ``raise`` fails on a page that cannot be read, ``skip`` leaves it out and tells how many there were.
    """
    found = raw_pages(spark, path, records=records, first=first, maxPages=max_pages)
    blank = F.col("record").isNull()
    marks = found.filter(blank).select("page", "error")  # a row for each empty or damaged page
    ends = marks.filter("error IS NULL").agg(F.min("page")).first()[0]
    inside = F.lit(True) if ends is None else F.col("page") < ends
    lost = marks.filter("error IS NOT NULL").filter(inside).agg(F.count("*").alias("n"), F.min_by("error", "page").alias("what"), F.min("page").alias("page")).first()
    alerts = []
    if lost["n"] and damaged == "raise":
        raise ValueError(f"page {lost['page']}: {lost['what']}")
    if lost["n"]:
        alerts.append(f"{lost['n']} damaged pages are left out, the first is {lost['page']}: {lost['what']}")
    if ends is None:
        alerts.append(f"the cap of {max_pages} pages is reached and the last one still has records: some are missing")
    elif ends == first:
        alerts.append("no record came")
    rows = found.filter(inside & ~blank).select("page", F.from_json("record", schema).alias("item"))
    return Read(flat(rows.select("page", "item.*")), alerts)
