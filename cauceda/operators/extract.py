"""Columns from text, declared as fields: labelled lines, flattened labels, patterns and JSON paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauceda.functions import dates, hashing, numbers, text

#: A label is no longer than this.
LABEL = 60
#: Logical types: the SQL types of the columns a field makes, by suffix.
TYPES = {
    "text": {"": "string"},
    "integer": {"": "bigint"},
    "decimal": {"": "double"},
    "date_es": {"": "timestamp_ntz"},
    "date_iso": {"": "timestamp_ntz"},
    "amount": {"": "double", "_currency": "string"},
    "label": {"": "string", "_label": "string"},
}
#: Columns that name a row of a source, in the order in which they are looked for.
KEYS = ("correo_id", "insight_id", "evento_id", "id")


@dataclass
class Field:
    """One declared field. ``labels`` are alternatives for labelled text; ``pattern`` is a regex or a path."""

    column: str
    type: str = "text"
    labels: tuple[str, ...] = ()
    pattern: str = ""
    required: bool = False


@dataclass
class Model:
    """Fields in order, the extractor that reads them, and a SQL filter on the raw rows."""

    fields: list[Field]
    extractor: str
    filter: str = ""
    key_columns: tuple[str, ...] = KEYS
    context: tuple[str, ...] = field(default=())

    def check(self) -> None:
        """Raise for what would fail only when rows come."""
        for f in self.fields:
            if f.type not in TYPES:
                raise ValueError(f"{f.column}: unknown type {f.type}")
            if not re.fullmatch(r"[a-z_][a-z0-9_]*", f.column):
                raise ValueError(f"{f.column}: not an identifier")
        names = [n for f in self.fields for n in columns_of(f)]
        if len(set(names)) != len(names):
            raise ValueError("two fields make one column")
        if self.extractor not in EXTRACTORS:
            raise ValueError(f"unknown extractor {self.extractor}")

    def schema(self) -> T.StructType:
        """The accepted table's columns, known before any row is read."""
        made = ", ".join(f"{n} {k}" for f in self.fields for n, k in columns_of(f).items())
        return T.StructType.fromDDL(f"row_key string, {made}")

    @staticmethod
    def reject_schema() -> T.StructType:
        return T.StructType.fromDDL("row_key string, reason string, extracted string")


def columns_of(f: Field) -> dict[str, str]:
    return {f"{f.column}{suffix}": kind for suffix, kind in TYPES[f.type].items()}


def merge_fields(preset: list[Field], own: list[Field]) -> list[Field]:
    """Own fields replace preset ones of the same column; new ones come after."""
    mine = {f.column: f for f in own}
    return [mine.pop(f.column, f) for f in preset] + list(mine.values())


def _labelled(body: Column) -> Column:
    """array of struct(label, value): lines with a colon whose left side is short enough to be a label."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    parts = F.transform(lines, lambda x: F.struct(text.fold_lower(F.substring_index(x, ":", 1)).alias("label"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return F.filter(parts, lambda x: (F.length(x["label"]) <= LABEL) & (x["label"] != ""))


def _flattened(body: Column, fields: list[Field]) -> Column:
    """array of struct(label, value) of a text whose line breaks were lost: what follows each declared label, up to the next."""
    every = sorted({n for o in fields for n in o.labels}, key=lambda n: (-len(n), n))
    any_label = "|".join(map(re.escape, every))
    pattern = F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])({any_label})\s*:(.*?)(?=(?<![\p{{L}}\p{{N}}_])(?:{any_label})\s*:|$)")
    found = F.arrays_zip(*(F.regexp_extract_all(body, pattern, F.lit(g)).alias(n) for g, n in ((1, "label"), (2, "value"))))
    found = F.transform(found, lambda x: F.struct(F.lower(x["label"]).alias("label"), F.trim(x["value"]).alias("value")))
    one_line = F.size(F.split(F.trim(body), r"\r?\n")) <= 1
    return F.when(one_line, found) if every else F.lit(None).cast("array<struct<label:string,value:string>>")


def _first(found: Column, names: tuple[str, ...], form) -> list[Column]:
    """For each name, struct(value, label) of the first entry under it."""
    out = []
    for name in names:
        hit = F.get(F.filter(found, lambda x: x["label"] == form(name)), F.lit(0))  # noqa: B023 (built at once)
        out.append(F.when(hit.isNotNull(), F.struct(hit["value"].alias("value"), F.lit(name).alias("label"))))
    return out


def by_lines(body: Column, f: Field) -> Column:
    """struct(value, label): the first line under one of the labels, in the labels' order. Empty values count."""
    return F.coalesce(*_first(F.col("_lines"), f.labels, lambda n: F.lit(text.folded_lower(n))), by_flat(body, f))


def by_flat(body: Column, f: Field) -> Column:
    """The text between a label and the next declared label, where line breaks were lost."""
    return F.coalesce(*_first(F.col("_flat"), f.labels, lambda n: F.lower(F.lit(n))), F.lit(None).cast("struct<value:string,label:string>"))


def by_pattern(body: Column, f: Field) -> Column:
    """Group 1 of the pattern, or all of it without groups; case is ignored and ^ and $ are line ends."""
    own = "(?im)" + f.pattern.replace("(?P<", "(?<")
    try:
        group = 1 if re.compile(f.pattern).groups else 0
    except re.error:
        return F.lit(None).cast("struct<value:string,label:string>")
    return F.when(body.rlike(own), F.struct(F.trim(F.regexp_extract(body, own, group)).alias("value"), F.lit(None).cast("string").alias("label")))


def by_path(body: Column, f: Field) -> Column:
    """The value at a dotted path of a JSON text; numbers in the path are list places; objects stay JSON."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in f.pattern.split("."))
    found = F.get_json_object(body, f"${steps}")
    return F.when(found.isNotNull(), F.struct(found.alias("value"), F.lit(None).cast("string").alias("label")))


#: What an extractor reads once a row, before its fields are looked up in it.
PREPARED = {"lines": {"_lines": lambda body, fields: _labelled(body), "_flat": _flattened}, "flat": {"_flat": _flattened}}
EXTRACTORS = {"lines": by_lines, "flat": by_flat, "pattern": by_pattern, "path": by_path}


def convert(f: Field, found: Column) -> list[Column]:
    """The columns of a field from its struct(value, label), and of an amount from what was read of it in ``_m_<column>``."""
    value = found["value"]
    if f.type == "amount":
        both = F.col(f"_m_{f.column}")
        return [both["amount"].alias(f.column), both["currency"].alias(f"{f.column}_currency")]
    if f.type == "label":
        return [value.alias(f.column), found["label"].alias(f"{f.column}_label")]
    one = {"text": lambda v: v, "integer": numbers.parse_integer, "decimal": numbers.parse_number, "date_es": dates.parse_spanish_date, "date_iso": dates.parse_date}
    return [one[f.type](value).alias(f.column)]


def once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, with those columns computed once a row: no filter or projection above repeats their expressions."""
    if not columns:
        return rows
    return rows.select(*(c for c in rows.columns if c not in columns), F.inline(F.array(F.struct(*columns))))


def extract(raw: DataFrame, model: Model, body: str) -> DataFrame:
    """row_key, the typed columns, missing (required columns without a value) and extracted (JSON) of each raw row."""
    model.check()
    rows = raw.filter(F.expr(model.filter)) if model.filter.strip() else raw
    read = EXTRACTORS[model.extractor]
    key = hashing.row_key(rows.columns, model.key_columns)
    ready = {name: make(F.col(body), model.fields) for name, make in PREPARED.get(model.extractor, {}).items()}
    context = [F.trim(F.col(c).cast("string")).alias(c) for c in model.context]
    found = once(rows.select(key.alias("row_key"), *context, F.col(body).alias("_body"), *(c.alias(n) for n, c in ready.items())), list(ready))
    values = [read(F.col("_body"), f).alias(f"_f_{f.column}") for f in model.fields]
    found = once(found.select("row_key", *model.context, *values), [f"_f_{f.column}" for f in model.fields])
    amounts = {f"_m_{f.column}": numbers.parse_amount(F.col(f"_f_{f.column}.value")) for f in model.fields if f.type == "amount"}
    found = once(found.select("*", *(c.alias(n) for n, c in amounts.items())), list(amounts))
    columns = [c for f in model.fields for c in convert(f, F.col(f"_f_{f.column}"))]
    typed = found.select("row_key", *model.context, *columns, F.to_json(F.struct(*(F.col(f"_f_{f.column}.value").alias(f.column) for f in model.fields))).alias("extracted"))
    missing = [F.when(text.is_blank(F.col(f.column)), F.lit(f.column)) for f in model.fields if f.required]
    return typed.withColumn("missing", F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"))


def accepted(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.size("missing") == 0).drop("missing", "extracted")


def rejected(extracted: DataFrame) -> DataFrame:
    reason = F.concat(F.lit("missing: "), F.concat_ws(", ", "missing"))
    return extracted.filter(F.size("missing") > 0).select("row_key", reason.alias("reason"), "extracted")
