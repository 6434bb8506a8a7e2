"""Which configured sources run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells that switch a source off. Any other cell leaves it on.
OFF = ("no", "false", "0", "", "inactivo", "off")


def states(sources: DataFrame, tenants: DataFrame) -> DataFrame:
    """``sources`` with ``state``: active, inactive, repeated (an earlier row has the tenant's source id) or unknown_tenant.

    sources: tenant, source_id, active, position. A blank source id is ``fuente``. Nothing is dropped in silence: rows
    that do not run stay in the result.
    """
    tenant = F.trim(F.coalesce("tenant", F.lit("")))
    source = F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.lit("fuente"))
    named = sources.withColumns({"tenant": tenant, "source_id": source})
    known = tenants.select(F.trim("tenant").alias("tenant")).distinct().withColumn("_known", F.lit(True))
    place = F.row_number().over(Window.partitionBy("tenant", "source_id").orderBy("position"))
    met = named.join(known, "tenant", "left").withColumn("_place", place)
    off = F.lower(F.trim(F.coalesce("active", F.lit("")))).isin(*OFF)
    state = F.when(F.col("_known").isNull(), "unknown_tenant").when(F.col("_place") > 1, "repeated").when(off, "inactive").otherwise("active")
    return met.withColumn("state", state).drop("_known", "_place")
