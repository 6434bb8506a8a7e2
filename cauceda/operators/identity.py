"""Rows that go by several alternative keys: which incoming row is which stored one.

A stored row and an incoming one that share the value of any key are the same thing read twice; a message that moved
to another folder, an event whose calendar was renamed. Keys are tried in order: by the first all pairs are made that
it can make, the next one sees only rows that are still without a partner. Within a key pairs are one to one: where
several rows share its value, the newest incoming one takes the newest stored one, the second the second, and so on.
Incoming rows without a partner are new. Stored rows without one that still share a key with an incoming row have
been read under another name, so they are merged: they go. Rows that share nothing are kept.

Only the incoming rows' keys move to the stored table (Spark broadcasts them where they are small), so a large
table is read once and not shuffled for a small window; what it shares with the window is cut out and paired apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauceda.functions import text
from cauceda.operators.cut import written


@dataclass(frozen=True)
class Identity:
    """Columns that name a row together, where none is blank. ``where``: which stored rows go by them (SQL)."""

    columns: tuple[str, ...]
    where: str = "true"


def key_of(identity: Identity, columns: list[str], stored: bool) -> Column:
    """The key as text; where it is blank or does not apply, a hash of the row's ``columns``: it spreads, and matches nothing."""
    whole = reduce(lambda a, b: a & b, (~text.is_blank(F.col(c)) for c in identity.columns))
    if stored:
        whole &= F.coalesce(F.expr(identity.where), F.lit(False))
    return F.when(whole, F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in identity.columns)))).otherwise(F.concat(F.lit("-"), F.xxhash64(*columns).cast("string")))


@dataclass
class Resolved:
    """``met``: incoming rows with ``_old``, the stored row as a struct or null; ``kept`` and ``merged``: stored rows."""

    met: DataFrame
    kept: DataFrame
    merged: DataFrame


def resolve(old: DataFrame, new: DataFrame, identities: list[Identity], newest: Column, stored_newest: Column, cut: Callable[[DataFrame], DataFrame] = written) -> Resolved:
    """Pairs ``new``, whose first key is given and distinct, with ``old``.

    ``newest`` and ``stored_newest`` say which of several rows of one key comes first (the largest; ties by the
    first key's text). ``cut`` writes a small intermediate table and gives it back, to be read again.
    """
    names = [f"_k{i}" for i in range(len(identities))]
    new = cut(new.withColumns({n: key_of(x, new.columns, False) for n, x in zip(names, identities, strict=True)}))
    keyed = old.withColumns({n: key_of(x, old.columns, True) for n, x in zip(names, identities, strict=True)})
    for n in names:
        seen = new.select(n).filter(F.col(n).startswith("{")).distinct().withColumn(f"{n}_met", F.lit(True))
        keyed = keyed.join(seen, n, "left")
    met_any = reduce(lambda a, b: a | b, (F.col(f"{n}_met").isNotNull() for n in names))
    kept = keyed.filter(~met_any).select(*old.columns)
    row = F.struct(*old.columns)
    held = cut(keyed.filter(met_any).select(*names, row.alias("_old"), stored_newest.alias("_newest"), F.sha2(F.to_json(row), 256).alias("_row")))
    free_new, free_old, pairs = new.select(*names, newest.alias("_newest"), F.col(names[0]).alias("_id")), held.select(*names, "_newest", "_row"), []
    for n in names:
        ranked = []
        for side, last in ((free_new, "_id"), (free_old, "_row")):
            order = Window.partitionBy(n).orderBy(F.desc("_newest"), names[0], last)
            ranked.append(side.filter(F.col(n).startswith("{")).select(n, F.row_number().over(order).alias("_place"), last))
        found = cut(ranked[0].join(ranked[1], [n, "_place"]).select("_id", "_row"))
        pairs.append(found)
        free_new, free_old = free_new.join(found, "_id", "left_anti"), free_old.join(found, "_row", "left_anti")
    every = reduce(DataFrame.unionByName, pairs)
    stored = every.join(held.select("_row", "_old").dropDuplicates(["_row"]), "_row").select("_id", "_old")
    met = new.join(stored, new[names[0]] == stored["_id"], "left").drop("_id", *names)
    return Resolved(met, kept, free_old.join(held.select("_row", "_old").dropDuplicates(["_row"]), "_row").select("_old.*"))
