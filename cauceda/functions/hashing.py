"""Hashes that name rows and their contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with nulls written out; key order is the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def identity_hash(*columns: Column) -> Column:
    """SHA-256 of a natural key, its parts joined by NUL; null is the empty text."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def row_key(columns: list[str], candidates: tuple[str, ...]) -> Column:
    """The first non-empty candidate column, else the hash of the whole row."""
    own = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates if c in columns]
    return F.coalesce(*own, content_hash(*sorted(columns)))


def breakdown(parts: dict[str, Column]) -> Column:
    """``k=v;k=v`` by key; absent values are left out."""
    return F.concat_ws(";", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in sorted(parts.items())))
