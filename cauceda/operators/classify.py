"""Classification in layers: override, then learned mapping, then rule, then unclassified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauceda.functions import text
from cauceda.operators.lookup import per_key

UNCLASSIFIED = "unclassified"


@dataclass
class Rule:
    pattern: str
    value: str
    columns: tuple[str, ...] = ()
    priority: int | None = None


def by_rule(rules: list[Rule], default: str) -> Column:
    """The value of the first rule that fits: lowest priority number, 100 if none, then order of declaration."""
    out = None
    for r in sorted(rules, key=lambda r: 100 if r.priority is None else r.priority):
        subject = F.concat_ws(" | ", *(F.col(c).cast("string") for c in (r.columns or (default,))))
        fits = text.like_folded(subject, F.lit(r.pattern))
        out = F.when(fits, F.lit(r.value)) if out is None else out.when(fits, F.lit(r.value))
    return F.lit(None).cast("string") if out is None else out


def composite_key(columns: list[str]) -> Column:
    """``column: value | column: value`` of the filled columns."""
    return F.concat_ws(" | ", *(F.when(~text.is_blank(F.col(c)), F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns))


def pivot_overrides(overrides: DataFrame, columns: list[str]) -> DataFrame:
    """row_key and one column a target; of repeated overrides the one with the highest ``position`` counts."""
    picked = [F.max_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, F.col("position"))).alias(f"_o_{c}") for c in columns]
    return overrides.filter(F.col("column").isin(columns)).groupBy("row_key").agg(*picked)


def correct(df: DataFrame, overrides: DataFrame, columns: list[str], key: str = "row_key") -> DataFrame:
    """``df`` with the values given by hand in ``columns``; one that is not of the column's type changes nothing."""
    if not columns:
        return df
    picked, kinds = pivot_overrides(overrides, columns).withColumnRenamed("row_key", "_row_key"), dict(df.dtypes)
    met = df.join(picked, df[key] == picked["_row_key"], "left")
    return met.select(*(F.coalesce(F.col(f"_o_{c}").try_cast(kinds[c]), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def classify(df: DataFrame, column: str, target: str, rules: list[Rule], mapping: DataFrame | None = None, overrides: DataFrame | None = None, dimension: str = "", key: str = "row_key") -> DataFrame:
    """``df`` with ``target``. mapping: dimension, folded, label. A mapping of blank dimension serves any."""
    out = df.withColumn("_folded", text.fold(F.col(column)))
    layers = []
    if overrides is not None:
        picked = pivot_overrides(overrides, [target]).withColumnRenamed("row_key", "_row_key")
        out = out.join(picked, out[key] == picked["_row_key"], "left").drop("_row_key")
        layers.append(F.nullif(F.trim(f"_o_{target}"), F.lit("")))
    if mapping is not None:
        for i, own in enumerate(dict.fromkeys((dimension, ""))):
            side = per_key(mapping.filter(F.coalesce("dimension", F.lit("")) == own).withColumn("_f", F.col("folded")), ["_f"], F.max("label").alias(f"_m{i}"))
            out = out.join(side, out["_folded"] == side["_f"], "left").drop("_f")
            layers.append(F.col(f"_m{i}"))
    layers += [by_rule(rules, column), F.lit(UNCLASSIFIED)]
    return out.withColumn(target, F.coalesce(*layers)).select(*df.columns, target)


def pending(df: DataFrame, column: str, target: str, mapping: DataFrame, dimension: str = "") -> DataFrame:
    """folded, example: distinct values that are unclassified and have no label yet."""
    open_ = df.filter((F.col(target) == UNCLASSIFIED) & ~text.is_blank(F.col(column)))
    values = open_.groupBy(text.fold(F.col(column)).alias("folded")).agg(F.min(column).alias("example"))
    return values.join(mapping.filter(F.coalesce("dimension", F.lit("")) == dimension).select("folded"), "folded", "left_anti")


def batches(df: DataFrame, order: str, size: int = 25) -> DataFrame:
    """``df`` with batch numbers of ``size`` rows. Pending values are few: distinct ones of one dimension."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long"))


def accept_labels(proposed: DataFrame, asked: DataFrame, categories: DataFrame) -> DataFrame:
    """folded, label: proposals for values that were asked, with labels of the closed set, in its spelling."""
    known = categories.select(F.col("category").alias("label"), text.fold(F.col("category")).alias("_c")).dropDuplicates(["_c"])
    named = proposed.select("folded", text.fold(F.col("label")).alias("_c")).join(known, "_c").join(asked.select("folded"), "folded", "left_semi")
    return named.groupBy("folded").agg(F.min("label").alias("label"))


def merge_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest wins by (dimension, folded); what ``new`` does not name stays."""
    return old.join(new, ["dimension", "folded"], "left_anti").unionByName(new, allowMissingColumns=True)


def unclassified_counts(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(t) == UNCLASSIFIED).alias(t) for t in targets))


def orphans(overrides: DataFrame, df: DataFrame, key: str = "row_key") -> DataFrame:
    """Overrides whose row no longer exists."""
    return overrides.join(df.select(F.col(key).alias("row_key")), "row_key", "left_anti")
