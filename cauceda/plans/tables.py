"""The tables of Spark's catalog described for whoever writes queries: which of them the catalog's rows allow, their
columns with what is said of each, and two rows of each.

Lists of tables and columns are of the size of the catalog, so names and types come to the driver; of a table's rows
no more than ``samples`` do, each read by an action that starts with one partition and stops when it has them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.functions import naming
from cauceda.plans import policy
from cauceda.sources.sinks import HIDDEN

DESCRIBED = "name string, schema string, columns array<struct<column:string,type:string>>, samples array<string>, failed string"
LINEAGE = ("_run_id", "_source_id", "_ingested_at")
#: So many characters of a cell are shown in a sample.
CELL = 200


def register(spark: SparkSession, df: DataFrame, name: str, source_id: str) -> str:
    """A view of ``df`` under a name of its own, which is returned: the cleaned name, else with the source before it, else numbered."""
    own = naming.identifier(name) or "table"
    with_source = naming.identifier(f"{source_id}_{name}") or own
    tried = [own, with_source]
    while spark.catalog.tableExists(tried[0]):
        tried = tried[1:] or [f"{with_source[:50]}_{_number(spark, with_source[:50])}"]
    df.createOrReplaceTempView(tried[0])
    return tried[0]


def _number(spark: SparkSession, base: str) -> int:
    n = 2
    while spark.catalog.tableExists(f"{base}_{n}"):
        n += 1
    return n


def scan(spark: SparkSession, schemas: Sequence[str] = (), views: bool = True) -> DataFrame:
    """name, schema of the tables of these schemas and of the session's views (schema null).

    What starts with an underscore, rejects and tables that are being replaced are left out. Of one name in two places
    the view counts, then the schema named first.
    """
    found = []
    for place, schema in enumerate(schemas, 1):
        own = spark.sql(f"SHOW TABLES IN {quoted(schema)}").filter("NOT isTemporary")
        found.append(own.select(F.col("tableName").alias("name"), F.lit(schema).alias("schema"), F.lit(place).alias("_place")))
    if views:
        shown = spark.sql("SHOW VIEWS").filter("isTemporary AND namespace = ''")
        found.append(shown.select(F.col("viewName").alias("name"), F.lit(None).cast("string").alias("schema"), F.lit(0).alias("_place")))
    if not found:
        return spark.createDataFrame([], "name string, schema string")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    kept = rows.filter(~F.startswith("name", F.lit("_")) & ~F.rlike("name", F.lit(HIDDEN)))
    return kept.groupBy("name").agg(F.min_by("schema", "_place").alias("schema"))


def quoted(*parts: str | None) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts if p is not None)


def _described(spark: SparkSession, name: str, schema: str | None, withheld: frozenset[str], samples: int) -> tuple:
    """A row of ``DESCRIBED``; a table that cannot be read says why, and the others are described all the same."""
    try:
        df = spark.table(quoted(schema, name))
        columns = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    except PySparkException as error:
        return name, schema, None, None, type(error).__name__
    placed = df.toDF(*(f"c{i}" for i in range(len(columns))))
    shown = [(i, c) for i, (c, _) in enumerate(columns) if c not in withheld and c not in LINEAGE]
    cells = F.struct(*(_cell(F.col(f"c{i}")).alias(c) for i, c in shown)) if shown else F.struct()
    try:
        rows = placed.select(F.to_json(cells).alias("row")).head(samples)
    except PySparkException as error:
        return name, schema, columns, None, type(error).__name__
    return name, schema, columns, [r.row for r in rows], None


def _cell(column):
    """A cell as text of at most ``CELL`` characters; null stays null and so is left out of the sample."""
    text = column.cast("string")
    return F.when(F.length(text) > CELL, F.concat(F.left(text, F.lit(CELL)), F.lit("…"))).otherwise(text)


def _listed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of the size of the catalog, held as a list so that they are made once."""
    return spark.createDataFrame(rows.collect(), rows.schema)


def describe(spark: SparkSession, catalog: DataFrame, schemas: Sequence[str] = (), views: bool = True, samples: int = 2) -> DataFrame:
    """table, name, schema, description, text, columns, samples, failed of each table that the catalog's rows allow.

    ``catalog`` is as ``policy.decide`` reads it. A logical table that two physical ones serve is blocked, one that none
    serves is left out. ``columns`` holds column, type and what the first of the catalog's rows says of it; a sample is one
    row as JSON without nulls, without lineage and without the cells of columns that a row of their own forbids. An empty table has no
    samples; a catalog that allows nothing gives no rows.
    """
    found = scan(spark, schemas, views)
    decided = policy.decide(catalog).filter("allowed").select("table", "description")
    allowed = policy.resolve(decided, found)
    named = _listed(spark, allowed.join(decided, "table").join(found, "name"))

    of_columns = catalog.select(F.trim("table").alias("table"), F.trim("column").alias("column"), "description", "instruction", "position")
    of_columns = of_columns.filter("column NOT IN ('', '*')").join(named.select("table", "name"), "table")
    told = of_columns.groupBy("name", "column").agg(F.min_by("description", "position").alias("said"), F.bool_and(policy.allowed(F.col("instruction"), True)).alias("open"))
    told = _listed(spark, told)
    closed: dict[str, set[str]] = {}
    for row in told.filter("NOT open").select("name", "column").collect():
        closed.setdefault(row.name, set()).add(row.column)
    rows = [_described(spark, r.name, r.schema, frozenset(closed.get(r.name, ())), samples) for r in named.select("name", "schema").distinct().collect()]
    described = spark.createDataFrame(rows, DESCRIBED)

    says = told.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("column", F.coalesce("said", F.lit(""))))).alias("_says"))
    lineage = F.array(*map(F.lit, LINEAGE))

    def with_words(c):
        said = F.when(F.array_contains(lineage, c.column), "lineage").otherwise(F.coalesce(F.try_element_at("_says", c.column), F.lit("")))
        return F.struct(c.column.alias("column"), c.type.alias("type"), said.alias("description"))

    out = named.join(described.drop("schema"), "name").join(says, "name", "left")
    out = out.withColumn("columns", F.transform("columns", with_words))
    line = F.transform("columns", lambda c: F.concat(F.lit("    - "), c.column, F.lit(" ("), c.type, F.lit(")"), F.when(c.description != "", F.concat(F.lit(": "), c.description)).otherwise("")))
    head = F.concat(F.lit("Tabla "), "name", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(""))
    return out.select("table", "name", "schema", "description", F.concat_ws("\n", F.array(head), line).alias("text"), "columns", "samples", "failed")
