"""Spreadsheet workbooks: every sheet's cells as text, many files at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.functions import naming

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def cells_of(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Sheet name, row number and cells of every row that has a filled cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(f"{_LINK}id")].lstrip("/")
            rows = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row")
            for number, row in enumerate(rows, 1):
                cells: list[str] = []
                for cell in row:
                    letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                    at = len(cells)
                    if letters:
                        at = 0
                        for c in letters:
                            at = at * 26 + ord(c) - 64
                        at -= 1
                    cells += [""] * (at + 1 - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    text = "" if value is None else value.text or ""
                    kind = cell.get("t")
                    cells[at] = shared[int(text)] if kind == "s" and text else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if kind == "inlineStr" else text
                if any(c.strip() for c in cells):
                    yield sheet.get("name"), int(row.get("r", number)), cells


def cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells of the workbooks under ``path``; a workbook is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, *row) for row in cells_of(content)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row long, cells array<string>")


def sheets(spark: SparkSession, path: str, only: tuple[str, ...] = (), without: tuple[str, ...] = (), most_rows: int | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """A table for each sheet whose name does not begin with an underscore, and the alerts.

    Sheets without a data row are left out with an alert; a sheet over ``most_rows`` is cut with one.
    """
    every = cells(spark, path)
    found = every.groupBy("sheet").agg(F.count("*").alias("rows"), F.min_by("cells", "row").alias("head"), F.min("row").alias("at"), F.max(F.size("cells")).alias("width")).orderBy("sheet").collect()
    out, alerts = {}, []
    for s in found:
        name = s["sheet"]
        if name.startswith("_") or name in without or (only and name not in only):
            continue
        if s["rows"] < 2:
            alerts.append(f"{name}: the sheet is empty")
            continue
        names = naming.headers([*s["head"], *[None] * (s["width"] - len(s["head"]))])
        body = every.filter((F.col("sheet") == name) & (F.col("row") > s["at"]))
        if most_rows is not None and s["rows"] - 1 > most_rows:
            alerts.append(f"{name}: {s['rows'] - 1} rows, cut to {most_rows}")
            body = body.orderBy("row").limit(most_rows)
        out[naming.identifier(name)] = body.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
    return out, alerts
