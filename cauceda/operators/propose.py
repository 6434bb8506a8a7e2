"""A model proposed from the texts themselves: frequent labels, the types their values read as, and a trial of the result.

All texts are read, none is sampled. One grouping counts, for every label, in how many texts it stands, in how many it is
filled and as what its values read; a second one counts which frequent labels meet in a text, so that labels that stand
for each other (one of several card brands, two names of an amount) become one field. What comes to the driver is a row
for each label of at least ``least`` of the texts, at most ``most`` of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.functions import dates, naming, numbers, text
from cauceda.operators import build, extract
from cauceda.operators.extract import LABEL, Field, Model

#: Of the filled values of a field, the share that must read as its type; of all texts, the share in which it is filled if it is required.
READS, REQUIRED = 0.95, 0.9
#: Of all texts, the share that labels which never meet must have between them to be names of one field.
COVER = 0.95
#: Parts of names of columns that identify something, whose digits are no number.
IDENTIFIERS = ("id", "autoriza", "referencia", "codigo", "telefono", "cedula", "consecutivo", "clave", "numero", "num_", "factura", "cuenta", "tarjeta", "serie", "folio")


@dataclass
class Label:
    """What one pass says about a label."""

    label: str
    spelled: str
    support: int
    filled: int
    zeros: int
    reads: dict[str, int]


@dataclass
class Proposal:
    extractor: str
    fields: list[Field]
    texts: int
    support: dict[str, int]
    preset: str = ""
    accepted: int = 0
    rejected: int = 0
    blank: list[str] = field(default_factory=list)
    alerts: list[str] = field(default_factory=list)


def _lines(body: Column) -> Column:
    """array of struct(label, at, spelled, value): lines with a label that has a letter; addresses of the web are none."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))

    def parts(x: Column, at: Column) -> Column:
        name = F.trim(F.substring_index(x, ":", 1))
        return F.struct(text.fold_lower(name).alias("label"), at.alias("at"), name.alias("spelled"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))

    return F.filter(F.transform(lines, parts), lambda x: (F.length(x["label"]) <= LABEL) & x["label"].rlike(r"\p{L}") & ~x["value"].startswith("//"))


def _keys(body: Column) -> Column:
    """The same of the keys of a JSON object; null where the text is none. Keys that no path can name are left out."""
    read = F.map_entries(F.from_json(body, "map<string,string>"))
    every = F.transform(read, lambda x, at: F.struct(x["key"].alias("label"), at.alias("at"), x["key"].alias("spelled"), F.trim(x["value"]).alias("value")))
    return F.when(F.ltrim(body).startswith("{"), F.filter(every, lambda x: x["label"].rlike("^[A-Za-z_][A-Za-z0-9_]*$")))


def _given(body: str) -> Column:
    """A text; a null one is empty."""
    return F.coalesce(F.col(body).cast("string"), F.lit(""))


def _is_json(body: str) -> Column:
    return F.ltrim(_given(body)).startswith("{")


def _every(body: str) -> Column:
    """All entries of a text, as they stand in it."""
    return F.when(_is_json(body), F.coalesce(_keys(_given(body)), F.array())).otherwise(_lines(_given(body)))


def entries(bodies: DataFrame, body: str) -> DataFrame:
    """is_json, entries of each text: the first of each label, in the labels' order. A null text has none."""
    found = extract.once(bodies.select(_is_json(body).alias("is_json"), F.sort_array(_every(body)).alias("_sorted")), ["_sorted"])
    first = F.filter("_sorted", lambda x, i: (i == 0) | (F.get(F.col("_sorted"), i - 1)["label"] != x["label"]))
    return extract.once(found.select("is_json", first.alias("entries")), ["entries"])


def trials(value: Column) -> dict[str, Column]:
    """As what a filled value reads, the narrowest first. Costly readings are tried where a cheap look allows them."""
    digit, money = value.rlike("[0-9]"), lambda x: x["amount"].isNotNull() & x["currency"].isNotNull()
    return {
        "integer": value.rlike("^-?[0-9]{1,18}$"),
        "date_iso": F.when(value.rlike("^[0-9]{1,4}[/.-][0-9]"), dates.parse_date(value).isNotNull()).otherwise(False),
        "date_es": F.when(digit & (value.rlike(dates.SPANISH) | value.rlike("^[0-9]{1,4}[/.-][0-9]")), dates.parse_spanish_date(value).isNotNull()).otherwise(False),
        "decimal": F.when(value.rlike("^-?[0-9]+([.,][0-9]+)*$"), numbers.parse_number(value).isNotNull()).otherwise(False),
        "amount": F.when(value.rlike("[A-Z]{3}|[$₡€]") & digit, numbers.bound(numbers.parse_amount(value), money)).otherwise(False),
        "label": value.rlike("^[*xX]{2,}[-* xX]*[0-9]{2,6}$"),
    }


def frequent(bodies: DataFrame, body: str, least: float, most: int) -> tuple[int, bool, list[Label], bool]:
    """How many texts, whether they are JSON, their frequent labels, and whether ``most`` cut some off."""
    kinds = bodies.groupBy(_is_json(body).alias("is_json")).count().collect()  # without the entries, which would be made for it
    texts = sum(r["count"] for r in kinds)
    json = 2 * sum(r["count"] for r in kinds if r["is_json"]) > texts
    filled, value = ~text.is_blank(F.col("value")), F.col("value")
    tests = {f"as_{k}": F.when(filled, t).otherwise(False) for k, t in trials(value).items()} | {"filled": filled, "zeros": value.rlike("^0[0-9]")}
    rows = entries(bodies, body).filter(F.col("is_json") == json).select(F.inline("entries"))
    rows = extract.once(rows.select("label", "spelled", *(t.alias(n) for n, t in tests.items())), list(tests))
    # by spelling first: only counts, so that rows are hashed and not sorted, as a smallest text among them would have it
    rows = rows.groupBy("label", "spelled").agg(F.count("*").alias("support"), *(F.count_if(n).alias(n) for n in tests))
    counts = {n: F.sum(n) for n in (*tests, "support")} | {"spelled": F.min("spelled")}
    rows = rows.groupBy("label").agg(*(c.alias(n) for n, c in counts.items()))
    kept = rows.filter(F.col("support") >= max(1, least * texts)).orderBy(F.desc("support"), "label").limit(most + 1).collect()
    found = [Label(r["label"], r["spelled"], r["support"], r["filled"], r["zeros"], {k[3:]: r[k] for k in counts if k.startswith("as_")}) for r in kept[:most]]
    return texts, json, found, len(kept) > most


def meetings(bodies: DataFrame, body: str, labels: list[str]) -> set[tuple[str, str]]:
    """The pairs of those labels, the smaller first, that stand in one text somewhere."""
    own = F.array_intersect(F.transform(_every(body), lambda x: x["label"]), F.array(*map(F.lit, labels)))
    bound = extract.once(bodies.select(own.alias("own")), ["own"]).filter(F.size("own") > 1)
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter(F.col("own"), lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return {(r["a"], r["b"]) for r in bound.select(F.inline(pairs)).distinct().collect()}


def kind_of(found: Label, column: str) -> tuple[str, str]:
    """The type of a label's values and what to tell about it."""
    kind = next((k for k, n in found.reads.items() if found.filled and n >= READS * found.filled), "text")
    if kind == "integer" and (found.zeros or any(part in column for part in IDENTIFIERS)):
        return "text", f"{column}: digits that identify something stay text, as zeros in front would be lost"
    return kind, ""


def together(labels: list[Label], kinds: dict[str, str], met: set[tuple[str, str]], texts: int) -> list[list[Label]]:
    """Labels of one type that never meet and stand in nearly all texts between them are one field; others stay alone."""
    groups, taken = [], set()
    for first in labels:
        if first.label in taken:
            continue
        group = [first]
        for other in labels if kinds[first.label] != "text" else []:
            apart = all((*sorted((other.label, g.label)),) not in met for g in group)
            if other.label not in taken and other not in group and kinds[other.label] == kinds[first.label] and apart:
                group.append(other)
        if len(group) == 1 or sum(g.support for g in group) < COVER * texts:
            group = [first]
        taken |= {g.label for g in group}
        groups.append(sorted(group, key=lambda g: g.spelled))
    return groups


def propose(bodies: DataFrame, body: str, presets: dict[str, str] | None = None, least: float = 0.02, most: int = 200) -> Proposal:
    """Fields for the texts in ``body``, tried on all of them. presets: name -> a mark that each of its texts has.

    Where every text has a preset's mark, its name is told as well: the texts can be read without new fields. Labels
    that are always empty are left out. Raises ValueError where no label is frequent.
    """
    texts, json, labels, cut = frequent(bodies, body, least, most)
    alerts = [f"more than {most} labels are frequent: the others are left out"] if cut else []
    alerts += [f"{x.spelled}: always empty, left out" for x in labels if not x.filled]
    labels = [x for x in labels if x.filled]
    if not labels:
        raise ValueError("no field that could be used")
    names = {x.label: naming.identifier(x.spelled) for x in labels}
    said = {x.label: kind_of(x, names[x.label]) for x in labels}
    kinds = {k: kind for k, (kind, _) in said.items()}
    alerts += [told for _, told in said.values() if told]
    alike = [k for k, kind in kinds.items() if kind != "text" and list(kinds.values()).count(kind) > 1]  # no others can become one field
    groups = [[x] for x in labels] if json else together(labels, kinds, meetings(bodies, body, alike) if alike else set(), texts)
    out = Proposal("path" if json else "lines", [], texts, {}, alerts=alerts)
    used: set[str] = set()
    for group in groups:
        kind, base = kinds[group[0].label], re.sub(r"^(?=[^a-z_])", "c_", names[group[0].label])
        kind = "text" if kind == "label" and len(group) == 1 else kind
        made = lambda name: set(extract.columns_of(Field(name, kind)))  # noqa: B023, E731 (called at once)
        column = next(n for n in (base, *(f"{base}_{i}" for i in range(2, most + 2))) if not made(n) & used)
        used |= made(column)
        required = sum(x.filled for x in group) >= REQUIRED * texts
        out.fields.append(Field(column, kind, () if json else tuple(x.spelled for x in group), group[0].spelled if json else "", required))
        out.support[column] = sum(x.support for x in group)
    if presets:
        lower = F.lower(F.coalesce(F.col(body).cast("string"), F.lit("")))
        row = bodies.agg(*(F.count_if(F.contains(lower, F.lit(mark.lower()))).alias(name) for name, mark in presets.items())).first()
        out.preset = next((name for name in presets if texts and row[name] == texts), "")
    return tried(bodies, body, out)


def tried(bodies: DataFrame, body: str, out: Proposal) -> Proposal:
    """The proposal with how many texts it accepts, how many it rejects, and its columns that no accepted text fills."""
    columns = [n for f in out.fields for n in extract.columns_of(f)]
    good = F.size("missing") == 0
    found = extract.extract(bodies, Model(out.fields, out.extractor), body)
    row = found.agg(F.count_if(good).alias("_accepted"), F.count_if(~good).alias("_rejected"), *(F.count_if(good & ~text.is_blank(F.col(c))).alias(c) for c in columns)).first()
    out.accepted, out.rejected = row["_accepted"], row["_rejected"]
    out.blank = [c for c in columns if out.accepted and not row[c]]
    return out


def tab_rows(out: Proposal, model_id: str, source: str, body: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """The rows of the tabs of models and fields that declare the proposal."""
    name = lambda table, kind: next(k for k, v in table.items() if v == kind and k)
    model = {"modelo_id": model_id, "tabla_origen": source, "tabla_destino": f"{model_id}__tabla", "extractor": out.preset or name(build.EXTRACTORS, out.extractor), "columna_texto": body, "filtro": "", "activo": "si"}
    fields = [{"modelo_id": model_id, "columna": f.column, "tipo": name(build.TYPES, f.type), "patron": f.pattern or "|".join(f.labels), "requerido": "si" if f.required else ""} for f in out.fields]
    return model, fields
