"""Delimited files, JSON payloads and tables of other databases. Everything textual lands as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauceda.functions import naming


def csv_tables(spark: SparkSession, paths: dict[str, str], separator: str = ",", encoding: str = "UTF-8") -> dict[str, DataFrame]:
    """A table for each path, all columns text, headers made into column names. Short rows are filled with null."""
    out = {}
    for name, path in paths.items():
        how = {"sep": separator, "encoding": encoding, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}
        first = spark.read.csv(path, header=False, **how).first()  # as data: a reader of headers renames repeated ones itself
        names = naming.headers(list(first or ()))
        kinds = T.StructType([T.StructField(n, T.StringType()) for n in names])
        out[naming.identifier(name)] = spark.read.schema(kinds).csv(path, header=True, enforceSchema=True, **how)
    return out


def flat(df: DataFrame) -> DataFrame:
    """Nested structs as columns ``a_b``; lists and maps as JSON text."""

    def leaves(kind: T.StructType, at: Column | None, path: list[str]):
        for f in kind.fields:
            here = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here, [*path, f.name])
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield [*path, f.name], F.to_json(here)
            else:
                yield [*path, f.name], here

    found = list(leaves(df.schema, None, []))
    names = naming.headers([".".join(p) for p, _ in found])
    return df.select(*(c.alias(n) for n, (_, c) in zip(names, found, strict=True)))


def json_records(spark: SparkSession, path: str, records: str = "", schema: T.StructType | None = None) -> DataFrame:
    """The records of JSON documents, flattened: the list at the dotted path ``records``, or each document itself."""
    read = spark.read.option("multiLine", True)
    docs = (read.schema(schema) if schema else read).json(path)
    if records:
        kind = docs.select(records).schema[0].dataType
        item = F.explode(F.col(records)) if isinstance(kind, T.ArrayType) else F.col(records)
        docs = docs.select(item.alias("item"))
        docs = docs.select("item.*") if isinstance(docs.schema["item"].dataType, T.StructType) else docs
    return flat(docs)


def json_column(df: DataFrame, column: str, schema: T.StructType | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A column of JSON texts as columns of a declared schema, flattened."""
    return flat(df.select(*keep, F.from_json(column, schema).alias("item")).select(*keep, "item.*"))


def jdbc_table(spark: SparkSession, url: str, table: str, where: str = "", partition: dict | None = None, **options: str) -> DataFrame:
    """A table of another database. The filter goes to that database; ``partition`` has column, lower, upper, parts."""
    if ";" in url or "\n" in url:
        raise ValueError("the address has characters that do not belong there")
    read = spark.read.format("jdbc").option("url", url).options(**options)
    read = read.option("dbtable", f"(SELECT * FROM {table} WHERE {where}) t" if where else table)
    if partition:
        read = read.options(partitionColumn=partition["column"], lowerBound=partition["lower"], upperBound=partition["upper"], numPartitions=partition["parts"])
    return read.load()


def capped(df: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The first ``most`` rows and an aggregate that tells whether there were more (over one row beyond)."""
    return df.limit(most), F.count("*") > most


def grid_table(rows: DataFrame, key: str) -> DataFrame:
    """A table out of a sheet's cells. rows: row (number), cells (array of text).

    The header is the first row that has the cell ``key``; notes may stand above it. Rows without a key go.
    """
    folded = F.transform("cells", lambda c: F.lower(F.trim(c)))
    head = rows.filter(F.array_contains(folded, key.lower())).agg(F.min_by("cells", "row").alias("cells"), F.min("row").alias("row")).first()
    if head is None or head["cells"] is None:
        raise ValueError(f"no row has the header {key}")
    names = naming.headers(head["cells"])
    at = [str(c).strip().lower() for c in head["cells"]].index(key.lower())
    body = rows.filter(F.col("row") > head["row"]).select(*(F.trim(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)))
    return body.filter(F.coalesce(F.col(names[at]), F.lit("")) != "")
