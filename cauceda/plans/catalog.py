"""The catalog of tables: what its rows name, and its text for whoever writes queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import text

#: How a table and a column are told.
TABLE = "Tabla '%s': %s. Sistema de origen: %s. Frecuencia de actualizacion: %s. Dueño del dato: %s."
COLUMN = "Columna '%s' (tabla '%s'): %s. Origen: %s. Actualizacion: %s. Dueño: %s."
TOLD = ("table", "column", "description", "instruction", "system", "frequency", "owner")


def named_tables(rows: DataFrame) -> DataFrame:
    """A row for each table that a catalog or KPI row names; rows that name none go."""
    return rows.withColumn("table", F.explode(text.items(F.col("table"), ";")))


def line(columns: list[str]) -> Column:
    """The text of one catalog row; absent cells are empty."""
    cell = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in columns else F.lit("") for c in TOLD}
    origin = [cell[c] for c in ("description", "system", "frequency", "owner")]
    whole = cell["column"].isin("*", "")
    told = F.when(whole, F.format_string(TABLE, cell["table"], *origin)).otherwise(F.format_string(COLUMN, cell["column"], cell["table"], *origin))
    return F.concat(told, F.when(cell["instruction"] != "", F.concat(F.lit(" Instruccion: "), cell["instruction"], F.lit("."))).otherwise(""))


def lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("line", line(rows.columns))
