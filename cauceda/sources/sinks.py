"""Tables in the Spark catalog: full refresh by a swap, versioned upsert, catalog rows, comments, the run log."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import uuid
import zipfile
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauceda.functions import naming, text
from cauceda.operators import upsert as versions
from cauceda.sources.commits import VERSION, Claims, Conflict

RUN_LOG = "run_id string, tenant string, source_id string, status string, started timestamp, finished timestamp, rows bigint, detail string, alerts string"

#: What the table that is being replaced is called meanwhile, and the ends of names that users do not see.
WAS = "__was"
HIDDEN = r"__(rechazos|was|[0-9a-f]{8})$"


def with_lineage(df: DataFrame, run_id: str, source_id: str, at: Column) -> DataFrame:
    """Where a row came from; one constant timestamp for the run."""
    return df.withColumns({"_run_id": F.lit(run_id), "_source_id": F.lit(source_id), "_ingested_at": at})


def contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; those that ``df`` lacks are null, NaN is null."""
    out = []
    for f in schema.fields:
        col = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in df.columns and dict(df.dtypes)[f.name] in ("double", "float"):
            col = F.when(~F.isnan(col), col)
        out.append(col.cast(f.dataType).alias(f.name))
    return df.select(*out)


class Warehouse:
    """Writes to catalog tables of one tenant. A table is written aside and then shown under its name.

    Every write is a commit of the table's next version (``commits``): it is claimed first and shown then, so of two
    writers one wins and the other starts over, and a writer that dies in between leaves a claim that the next one to
    open the table carries out. Where the columns stay the same, showing is one change of the table's location;
    where a window touches some partitions, of theirs; where columns change, the old table is renamed, the new one takes
    the name and the old one goes, and ``exists`` gives it its name back if a crash came in between. Tables do not own their
    folders, so that dropping one deletes no rows; the rows that a commit replaces go with the commit after it.
    """

    def __init__(self, spark: SparkSession, tenant: str):
        self.spark = spark
        self.raw, self.semantic, self.meta = naming.raw_schema(tenant), naming.semantic_schema(tenant), f"meta_{naming.identifier(tenant)}"
        self.claims = Claims(spark)
        for schema in (self.raw, self.semantic, self.meta):
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")

    def exists(self, name: str) -> bool:
        """Whether there is such a table, once what was claimed and not carried out is."""
        found = self.spark.catalog.tableExists(name)
        if not found and self.spark.catalog.tableExists(f"{name}{WAS}"):
            self._rename(f"{name}{WAS}", name)
            found = True
        if found:
            self.version(name)
        return found

    def version(self, name: str) -> int:
        """The table's version; a claim that its writer did not carry out is carried out first."""
        taken = self.claims.versions(name)
        last = taken[-1] if taken else 0
        if last and self.spark.catalog.tableExists(name) and self._shown(name) < last:
            self._show(name, last, self.claims.read(name, last))
        return last

    def _shown(self, name: str) -> int:
        found = self.spark.sql(f"SHOW TBLPROPERTIES {name}").filter(F.col("key") == VERSION).first()
        return int(found["value"]) if found else 0

    def _show(self, name: str, version: int, what: dict) -> None:
        """Carry a claim out; doing so again changes nothing."""
        if "partitions" in what:
            for spec, place in what["partitions"].items():
                if place is None:
                    self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
                elif self.claims.exists(place):
                    self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{place}'")
                    self.spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION '{place}'")
        elif self.claims.exists(what["location"]) and what.get("same"):
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{what['location']}'")
        elif self.spark.catalog.tableExists(what.get("aside", "")):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}{WAS}")
            self._rename(name, f"{name}{WAS}")
            self._rename(what["aside"], name)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}{WAS}")
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{VERSION}' = '{version}')")
        self.spark.catalog.refreshTable(name)

    def tables(self, schema: str) -> list[str]:
        """The tables that users see: none of the library's own, no rejects, none written aside."""
        return sorted(t.name for t in self.spark.catalog.listTables(schema) if not t.isTemporary and not t.name.startswith("_") and not re.search(HIDDEN, t.name))

    def location(self, name: str) -> str:
        return self.spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]

    def stage(self, df: DataFrame, name: str, partition: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> str:
        """Write ``df`` beside ``name``, to be published or dropped; returns where."""
        aside = f"{name}__{uuid.uuid4().hex[:8]}"
        writer = (df.sortWithinPartitions(*sort) if sort else df).write.format("parquet").option("path", self._beside(aside))
        (writer.partitionBy(*partition) if partition else writer).saveAsTable(aside)
        return aside

    def _beside(self, name: str) -> str:
        schema, _, table = name.rpartition(".")
        return f"{self.spark.catalog.getDatabase(schema).locationUri.rstrip('/')}/{table}"

    def drop(self, name: str) -> None:
        """Drop a table and the folder that its rows are in."""
        if self.spark.catalog.tableExists(name):
            place = self.location(name)
            self.spark.sql(f"DROP TABLE {name}")
            self.claims.delete(place)

    def _rename(self, old: str, new: str) -> None:
        """A renamed table may still look for its partitions in the old folder: those go and are found anew."""
        self.spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
        if any(c.isPartition for c in self.spark.catalog.listColumns(new)):
            self.spark.sql(f"MSCK REPAIR TABLE {new} SYNC PARTITIONS")

    def publish(self, aside: str, name: str, version: int | None = None) -> None:
        """Show what was written aside as ``name``. Conflict if ``version``, which it was made from, is not the last."""
        there = self.exists(name)
        last = self.version(name) if version is None else version
        new = self.location(aside)
        if not there:
            self.claims.claim(name, last + 1, {"location": new, "aside": aside})
            self._rename(aside, name)
            self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{VERSION}' = '{last + 1}')")
            return
        shapes = [[(f.name, f.dataType) for f in self.spark.table(t).schema.fields] for t in (name, aside)]
        same = shapes[0] == shapes[1] and not any(c.isPartition for t in (name, aside) for c in self.spark.catalog.listColumns(t))
        self._commit(name, last + 1, {"location": new, "aside": aside, "same": same, "before": [self.location(name)]})
        self.spark.sql(f"DROP TABLE IF EXISTS {aside}")  # its folder is the table's now

    def _commit(self, name: str, version: int, what: dict) -> None:
        self.claims.claim(name, version, what)
        self._show(name, version, what)
        if version - 1 in self.claims.versions(name):  # readers of the version before may still be at it
            shown = {self.location(name)}
            for place in self.claims.read(name, version - 1).get("before", []):
                if place not in shown:
                    self.claims.delete(place)

    def swap(self, df: DataFrame, name: str, partition: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> None:
        """Full refresh. ``df`` may read the table that it replaces."""
        self.publish(self.stage(df, name, partition, sort), name)

    def refresh(self, df: DataFrame, source: str, table: str, run_id: str) -> str:
        name = f"{self.raw}.{naming.raw_table(source, table)}"
        self.swap(with_lineage(df, run_id, source, F.current_timestamp()), name)
        return name

    def empty(self, name: str, schema: T.StructType) -> None:
        """A table of the declared columns before there is a row; columns that are new to it are added."""
        if not self.exists(name):
            self.swap(self.spark.createDataFrame([], schema), name)
            return
        have = {c.name for c in self.spark.catalog.listColumns(name)}
        if new := [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name not in have]:
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")

    def upsert(self, new: DataFrame, name: str, keys: list[str], content: list[str], run_id: str, tries: int = 5, **options) -> dict[str, int]:
        """Versioned upsert into a table; the counts of rows kept, unchanged, updated and new.

        Where another writer comes first, the rows are met with what it wrote, ``tries`` times at most.
        """
        shape = self._shape(new, keys, content)
        for left in reversed(range(tries)):
            self.empty(name, shape)
            version = self.version(name)
            out = versions.upsert(self.spark.table(name), new, keys, content, run_id, F.current_timestamp(), **options)
            aside = self.stage(out, name)
            try:
                found = {r["action"]: r["rows"] for r in versions.counts(self.spark.table(aside)).collect()}
                self.publish(aside, name, version)
                return found
            except Conflict:
                self.drop(aside)
                if not left:
                    raise

    def _shape(self, new: DataFrame, keys: list[str], content: list[str]) -> T.StructType:
        fields = ", ".join(f"{c} {dict(new.dtypes)[c]}" for c in dict.fromkeys([*keys, *content]))
        return T.StructType.fromDDL(f"{fields}, version_hash string, run_id string, seen_at timestamp, action string")

    def upsert_days(self, new: DataFrame, name: str, keys: list[str], content: list[str], run_id: str, day: str, moves: bool = True, most_days: int = 4000, tries: int = 5, **options) -> dict[str, int]:
        """Versioned upsert into a table that is partitioned by ``day``, a date among keys or content.

        Only the days that the window has are read and written; the others keep their files. With ``moves`` a stored row
        may have another day than the incoming one: the stored keys, and nothing else, are read to find those days too.
        The counts are of the rows of these days. A window of more than ``most_days`` days raises: that is a refresh.
        """
        shape = self._shape(new, keys, content)
        for left in reversed(range(tries)):
            if not self.exists(name):
                empty = self.spark.createDataFrame([], shape)
                self.swap(empty, name, partition=(day,))
            version = self.version(name)
            held = self.spark.table(name)
            days = new.select(day).distinct()
            if moves:
                days = days.unionByName(held.join(new.select(*keys).distinct(), keys, "left_semi").select(day)).distinct()
            touched = [r[0] for r in days.limit(most_days + 1).collect()]
            if len(touched) > most_days:
                raise ValueError(f"a window of more than {most_days} days")
            dated = [d for d in touched if d is not None]
            old = held.filter(F.col(day).isin(dated) | (F.col(day).isNull() if None in touched else F.lit(False)))
            out = versions.upsert(old, new, keys, content, run_id, F.current_timestamp(), **options)
            place = f"{self._beside(name)}__{uuid.uuid4().hex[:8]}"
            out.repartition(day).write.partitionBy(day).parquet(place)
            made = self.spark.read.schema(shape).parquet(place)
            found = {r["action"]: r["rows"] for r in versions.counts(made).collect()}
            full = {r[0] for r in made.select(day).distinct().collect()}
            before = self._partitions(name, day)
            spec = {d: f"{day} = {'null' if d is None else repr(str(d))}" for d in touched}
            folder = {d: f"{place}/{day}={'__HIVE_DEFAULT_PARTITION__' if d is None else d}" for d in touched}
            what = {"partitions": {spec[d]: folder[d] if d in full else None for d in touched}, "before": [before[str(d)] for d in touched if str(d) in before]}
            try:
                self._commit(name, version + 1, what)
                return found
            except Conflict:
                self.claims.delete(place)
                if not left:
                    raise

    def _partitions(self, name: str, day: str) -> dict[str, str]:
        """Where each partition's rows are, by its day as text."""
        schema, _, table = name.rpartition(".")
        jvm = self.spark._jvm.org.apache.spark.sql.catalyst
        found = self.spark._jsparkSession.sessionState().catalog().listPartitions(jvm.TableIdentifier(table, self.spark._jvm.scala.Option.apply(schema)), self.spark._jvm.scala.Option.empty())
        parts = [found.apply(i) for i in range(found.size())]
        return {("None" if p.spec().apply(day) == "__HIVE_DEFAULT_PARTITION__" else p.spec().apply(day)): p.location().toString() for p in parts}

    def replace_rows(self, df: DataFrame, name: str, column: str, values: list) -> None:
        """The rows of some sources, replaced; those of others stay."""
        if self.exists(name):
            kept = self.spark.table(name).filter(~F.col(column).isin(values))
            df = kept.unionByName(df, allowMissingColumns=True)
        self.swap(df, name)

    def comment(self, name: str, notes: dict[str, str]) -> list[str]:
        """Comments on a table (key ``*``) and those of its columns that exist; returns the keys not found."""
        have, missing = {c.name for c in self.spark.catalog.listColumns(name)}, []
        for column, note in notes.items():
            quoted = "'" + note.replace("\\", "\\\\").replace("'", "\\'") + "'"
            if column == "*":
                self.spark.sql(f"COMMENT ON TABLE {name} IS {quoted}")
            elif column in have:
                self.spark.sql(f"ALTER TABLE {name} ALTER COLUMN {column} COMMENT {quoted}")
            else:
                missing.append(column)
        return missing

    def log_run(self, **run) -> None:
        """Append one run; columns that are not given are null."""
        row = self.spark.createDataFrame([run], T.StructType([f for f in T.StructType.fromDDL(RUN_LOG).fields if f.name in run]))
        contract(row, T.StructType.fromDDL(RUN_LOG)).write.mode("append").format("parquet").saveAsTable(f"{self.meta}.runs")

    def purge(self, name: str, column: str, days: int) -> None:
        """Drop rows older than ``days``."""
        self.swap(self.spark.table(name).filter(F.col(column) >= F.current_timestamp() - F.make_interval(days=F.lit(days))), name)


def kpi_collisions(new: DataFrame, held: DataFrame) -> DataFrame:
    """KPI names that another source has, compared trimmed and in lower case."""
    other = held.select(F.lower(F.trim("kpi")).alias("_k"), F.col("source_id").alias("_s"))
    return new.join(other, (F.lower(F.trim("kpi")) == F.col("_k")) & (F.col("source_id") != F.col("_s")), "left_semi")


def csv_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """A capped result as CSV with a byte order mark, for spreadsheets."""
    out = io.StringIO()
    csv.writer(out).writerows([columns, *rows])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


#: The parts of a workbook of one sheet, beside the sheet. Styles: plain, head, number, date.
_OFFICE, _PACKAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
_SHEET, _TYPES = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "application/vnd.openxmlformats-officedocument.spreadsheetml"
BOOK = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets><sheet name="datos" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_SHEET}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="4" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def column_letters(at: int) -> str:
    """The name of a sheet's column, counted from 0."""
    out = ""
    while at >= 0:
        at, here = at // 26 - 1, at % 26
        out = chr(65 + here) + out
    return out


def xlsx_bytes(columns: list[str], rows: list[tuple], most: int = 5000) -> bytes:
    """At most ``most`` rows as a workbook: numbers and dates as such, a bold head that stays in sight, filters."""
    rows = rows[:most]
    epoch = dt.datetime(1899, 12, 30)

    def written(value, place: str, style: int) -> str:
        if value is None:
            return ""
        if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) and Decimal(str(value)).is_finite():
            return f'<c r="{place}" s="2"><v>{value}</v></c>'
        if isinstance(value, dt.date):
            moment = value.replace(tzinfo=None) if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())
            return f'<c r="{place}" s="3"><v>{(moment - epoch) / dt.timedelta(days=1)}</v></c>'
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))  # signs that XML cannot hold
        return f'<c r="{place}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    lines = [[str(c) for c in columns], *rows]
    body = "".join(f'<row r="{i}">{"".join(written(v, f"{column_letters(j)}{i}", int(i == 1)) for j, v in enumerate(line))}</row>' for i, line in enumerate(lines, 1))
    span = quoteattr(f"A1:{column_letters(max(len(columns) - 1, 0))}{len(lines)}")
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    sheet = f'<worksheet xmlns="{_SHEET}">{pane}<sheetData>{body}</sheetData>{f"<autoFilter ref={span}/>" if rows else ""}</worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in {**BOOK, "xl/worksheets/sheet1.xml": sheet}.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{part}')
    return out.getvalue()


def mask(url: str) -> Column:
    return text.mask_secrets(F.lit(url))
