"""Which tables may be asked about: rules over the catalog's instructions, decided per table in one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that decide by themselves, whole or as a prefix with a colon.
YES, NO = ("si", "sí", "true", "1", "x", "habilitada", "habilitado"), ("no", "false", "0", "bloqueada", "bloqueado")
#: Words that forbid, checked first.
FORBID = (
    "no debe", "no se debe", "no usar", "no la use", "no leer", "no exponer", "no publicar", "no bot", "prohib", "restringid", "confidencial",
    "sensible", "uso interno", "solo interno", "interno", "privad", "oculta",
)
#: Words that allow.
ALLOW = (
    "puede ser usada por el bot", "puede usarse por el bot", "puede usar el bot", "puede ser usada", "puede usar", "usar por el bot",
    "disponible para el bot", "expone", "publica", "si bot", "habilitad",
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def allowed(instruction: Column, blank: bool = False) -> Column:
    """What an instruction says; ``blank`` decides where it says nothing. Anything unclear is closed by default."""
    t = F.lower(F.trim(F.coalesce(instruction, F.lit(""))))
    head = F.regexp_extract(t, r"^([^:\s]+):", 1)
    return (
        F.when(t.isin(*NO) | head.isin("no"), False)
        .when(t.isin(*YES) | head.isin("si", "sí"), True)
        .when(_any(t, FORBID), False)
        .when(_any(t, ALLOW), True)
        .otherwise(blank)
    )


def decide(catalog: DataFrame, blank: bool = False) -> DataFrame:
    """table, allowed, description. A row for the whole table (column ``*`` or blank) decides; without one every column must allow."""
    rows = catalog.filter("trim(coalesce(table, '')) <> ''").withColumn("_ok", allowed(F.col("instruction"), blank))
    whole = F.coalesce(F.trim("column"), F.lit("")).isin("*", "")
    first = F.struct("_ok", "description")
    out = rows.groupBy(F.trim("table").alias("table")).agg(F.min_by(F.when(whole, first), F.when(whole, F.col("position"))).alias("_whole"), F.bool_and("_ok").alias("_every"))
    return out.select("table", F.coalesce("_whole._ok", "_every").alias("allowed"), F.coalesce("_whole.description", F.lit("")).alias("description"))


def resolve(logical: DataFrame, physical: DataFrame) -> DataFrame:
    """table, name of the logical tables that exactly one physical table serves: of that name, else ending in ``__name``.

    Both lists are schema-sized. Two candidates block a table; none leaves it out.
    """
    suffix = F.lower(F.element_at(F.split("name", "__"), -1))
    keys = physical.select("name", F.explode(F.array_distinct(F.array(F.lower("name"), suffix))).alias("_key"))
    met = logical.select("table").join(keys, F.lower("table") == F.col("_key")).withColumn("_exact", F.lower("table") == F.lower("name"))
    out = met.groupBy("table").agg(F.max_by("name", "_exact").alias("name"), F.count("*").alias("_n"), F.bool_or("_exact").alias("_exact"))
    return out.filter("_exact OR _n = 1").select("table", "name")
