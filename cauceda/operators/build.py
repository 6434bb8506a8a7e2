"""The semantic build: models declared in metadata tabs become tables, each model on its own.

The tabs are what people type, so all but the overrides are read to the driver. A model's rows are extracted once and
written aside; the accepted and the rejected rows are both made from that.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.functions import hashing, text
from cauceda.operators import classify, extract, lookup, quality
from cauceda.operators.classify import Rule
from cauceda.operators.extract import Field, Model
from cauceda.operators.lookup import Lookup

#: How tabs name types, extractors and transforms of keys.
TYPES = {"": "text", "texto": "text", "entero": "integer", "decimal": "decimal", "fecha_hora_es": "date_es", "fecha_iso": "date_iso", "monto_con_moneda": "amount", "etiqueta_de_lista": "label"}
EXTRACTORS = {"": "lines", "etiqueta_valor": "lines", "regex": "pattern", "json_ruta": "path"}
TRANSFORMS = {"": "exact", "exacto": "exact", "normalizado": "folded", "ultimos4": "last4"}
#: The tabs that declare models, and what ends the name of a table of rejects.
TABS = ("modelos", "campos", "clasificacion", "categorias", "joins", "overrides")
REJECTS = "__rechazos"
OWN_METADATA = "_modelo_semantico"


@dataclass
class Target:
    """A column of labels, from a column and those shown with it."""

    name: str
    column: str
    beside: list[str] = field(default_factory=list)


@dataclass
class Plan:
    """A declared model as operators: what is read, how, and where it goes."""

    model_id: str
    source: str
    target: str
    body: str
    model: Model
    targets: list[Target]
    rules: list[tuple[str, Rule]]
    lookups: list[Lookup]

    def rules_of(self, target: str) -> list[Rule]:
        """Rules that name the target; those that name none belong to the first target."""
        first = self.targets[0].name if self.targets else ""
        return [r for named, r in self.rules if (named or first) == target]


@dataclass
class Built:
    rows: int = 0
    rejects: int = 0
    unclassified: dict[str, int] = field(default_factory=dict)
    alerts: list[str] = field(default_factory=list)


def words(cell: str | None) -> list[str]:
    return [w.strip() for w in (cell or "").replace(";", ",").split(",") if w.strip()]


def _says_yes(cell: str | None, blank: bool) -> bool:
    said = (cell or "").strip().lower()
    return said in text.YES if said else blank


def _known(names: dict[str, str], cell: str | None, what: str) -> str:
    name = (cell or "").strip().lower()
    if name not in names and name not in names.values():
        raise ValueError(f"unknown {what} {name}; known are {', '.join(sorted(n for n in names if n))}")
    return names.get(name, name)


def read_tabs(tabs: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """The rows of the tabs but for the overrides; absent tabs are empty."""
    return {name: [{k: "" if v is None else str(v).strip() for k, v in r.asDict().items()} for r in tabs[name].collect()] if name in tabs else [] for name in TABS[:-1]}


def categories_of(tabs: dict[str, list[dict]], model_id: str, target: str = "") -> list[str]:
    """The closed set of labels of a model's target; categories of no target serve all."""
    own = [c for c in tabs["categorias"] if c.get("modelo_id") == model_id]
    return [c["categoria"] for c in own if not target or c.get("clasifica_en", "") in ("", target)]


def _priority(cell: str | None) -> int | None:
    return int(cell) if (cell or "").strip().lstrip("-").isdigit() else None


def declared(row: dict, tabs: dict[str, list[dict]], presets: dict[str, tuple[str, list[Field]]] | None = None) -> Plan:
    """The plan of a row of the tab of models; raises ValueError for what is declared wrong.

    A preset (extractor and fields by name) may stand in the extractor's cell; declared fields replace its own.
    """
    model_id = row["modelo_id"]
    own = {tab: [r for r in tabs[tab] if r.get("modelo_id") == model_id] for tab in TABS[1:-1]}
    kind, preset = (presets or {}).get(row.get("extractor", ""), (None, []))
    kind = kind or _known(EXTRACTORS, row.get("extractor"), "extractor")
    fields, targets = [], []
    for f in own["campos"]:
        labels = tuple(w.strip() for w in f.get("patron", "").split("|") if w.strip()) if kind in ("lines", "flat") else ()
        fields.append(Field(f["columna"], _known(TYPES, f.get("tipo"), "type"), labels or ((f["columna"],) if kind in ("lines", "flat") else ()), f.get("patron", ""), _says_yes(f.get("requerido"), False)))
        if f.get("clasifica_en"):
            targets.append(Target(f["clasifica_en"], f["columna"], [c for c in words(f.get("clasifica_con")) if c != f["columna"]]))
    if not row.get("tabla_origen"):
        raise ValueError("no source table")
    if len({f.column for f in fields}) != len(fields):
        raise ValueError("a column is declared twice")
    if len({t.name for t in targets}) != len(targets):
        raise ValueError("two fields fill one column of labels")
    fields = extract.merge_fields(preset, fields)
    if not fields:
        raise ValueError("no fields")
    rules = [(r.get("clasifica_en", ""), Rule(r["patron"], r["valor"], tuple(words(r.get("columnas"))), _priority(r.get("prioridad")))) for r in own["clasificacion"]]
    lookups = []
    for j in own["joins"]:
        if _says_yes(j.get("activo"), True):
            how = _known(TRANSFORMS, j.get("transformacion"), "transform")
            lookups.append(Lookup(j["tabla_auxiliar"], j["columna_base"], j["columna_auxiliar"], words(j.get("columnas_salida")), "_position", how, j.get("fecha_base", ""), j.get("vigencia_desde", ""), j.get("vigencia_hasta", "")))
    made = {n for f in fields for n in extract.columns_of(f)} | {t.name for t in targets} | {o for x in lookups for o in x.outputs}
    wanted = [*(c for t in targets for c in t.beside), *(c for x in lookups for c in (x.base, x.base_date) if c), *(c for _, r in rules for c in r.columns)]
    model = Model(fields, kind, row.get("filtro", ""), context=tuple(dict.fromkeys(c for c in wanted if c not in made)))
    model.check()
    return Plan(model_id, row["tabla_origen"], row.get("tabla_destino") or model_id, row.get("columna_texto") or "cuerpo", model, targets, rules, lookups)


def extracted(raw: DataFrame, plan: Plan) -> DataFrame:
    """The extracted rows of ``raw``; a row without a text lacks all it should have, whatever its fields require."""
    model = replace(plan.model, context=tuple(c for c in plan.model.context if c in raw.columns))
    kept = raw.filter(F.expr(model.filter)) if model.filter.strip() else raw
    found = extract.extract(kept.filter(F.col(plan.body).isNotNull()), replace(model, filter=""), plan.body)
    key = hashing.row_key(raw.columns, model.key_columns).alias("row_key")
    none = kept.filter(F.col(plan.body).isNull()).select(key, F.lit("{}").alias("extracted"), F.array(F.lit(plan.body)).alias("missing"))
    return found.unionByName(none, allowMissingColumns=True)


def derive(rows: DataFrame, plan: Plan, aux: dict[str, DataFrame], mapping: DataFrame | None, overrides: DataFrame | None) -> DataFrame:
    """Accepted rows with what is looked up, their labels, and corrections by hand.

    Lookups run before the labels, and again after them for rows that still lack outputs: a key may be a label.
    """
    ready = [x for x in plan.lookups if x.base in rows.columns]
    out = lookup.chain(rows, aux, ready, "row_key")
    for t in plan.targets:
        rules = [replace(r, columns=r.columns or (t.column,)) for r in plan.rules_of(t.name)]
        if t.beside:
            parts = [F.concat(F.lit(f"{c}: "), F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in (t.column, *t.beside) if c in out.columns]
            out = out.withColumn("_value", F.concat_ws(" | ", *parts))
        else:
            out = out.withColumn("_value", F.col(t.column).cast("string"))
        out = classify.classify(out, "_value", t.name, rules, mapping, overrides, t.name).drop("_value")
    if overrides is not None:
        named = {t.name for t in plan.targets}
        out = classify.correct(out, overrides, [c for c in out.columns if c not in named and c != "row_key"])
    out = lookup.chain(out, aux, plan.lookups, "row_key", only_missing=True)
    return out.withColumns({"source_table": F.lit(plan.source), "model_id": F.lit(plan.model_id)})


def build_model(house, plan: Plan, mapping: DataFrame | None = None, overrides: DataFrame | None = None, dry: bool = False) -> Built:
    """Write the tables of accepted and rejected rows of one model; with ``dry`` only count. Row keys are unique."""
    spark: SparkSession = house.spark
    raw = spark.table(f"{house.raw}.{plan.source}")
    aux = {x.table: spark.table(f"{house.raw}.{x.table}") for x in plan.lookups}
    ordered = {}
    for name, df in aux.items():
        ordered[name] = df if "_position" in df.columns else df.withColumn("_position", F.to_json(F.struct(*df.columns)))
    lookups = [replace(x, active="activo" if "activo" in aux[x.table].columns else "") for x in plan.lookups]
    plan = replace(plan, lookups=lookups)
    name, found = f"{house.semantic}.{plan.target}", extracted(raw, plan)
    if dry:
        n = found.agg(F.count_if(F.size("missing") == 0).alias("rows"), F.count_if(F.size("missing") > 0).alias("rejects")).first()
        return Built(n["rows"], n["rejects"])
    aside = house.stage(found, name)
    try:
        staged = spark.table(aside)
        house.swap(derive(extract.accepted(staged), plan, ordered, mapping, overrides), name)
        rejects = extract.rejected(staged).select("row_key", F.lit(plan.source).alias("source_table"), F.lit(plan.model_id).alias("model_id"), "reason", "extracted")
        house.swap(rejects, f"{name}{REJECTS}")
    finally:
        house.drop(aside)
    table, names = spark.table(name), [t.name for t in plan.targets]
    counts = table.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(t) == classify.UNCLASSIFIED).alias(t) for t in names)).first()
    out = Built(counts["_rows"], spark.table(f"{name}{REJECTS}").count(), {t: counts[t] for t in names if counts[t]})
    if overrides is not None:
        lost = classify.orphans(overrides, table).select("row_key").distinct()
        if n := lost.count():
            some = [r["row_key"] for r in lost.orderBy("row_key").limit(5).collect()]
            out.alerts.append(f"{plan.model_id}: {n} keys of overrides have no row: {', '.join(some)}")
    if out.rejects:
        out.alerts.append(f"{plan.model_id}: {out.rejects} rows rejected, see {name}{REJECTS}")
    return out


def build(house, tabs: dict[str, DataFrame], presets=None, mapping: DataFrame | None = None, dry: bool = False) -> dict[str, Built]:
    """Every active model, by id. One that is declared wrong or fails leaves an alert and its tables as they were.

    mapping: model_id, dimension, folded, label. The overrides' tab has modelo_id, clave, columna, valor and position.
    """
    read, out = read_tabs(tabs), {}
    for row in read["modelos"]:
        if not row.get("modelo_id") or not _says_yes(row.get("activo"), True):
            continue
        model_id = row["modelo_id"]
        try:
            own = mapping.filter(F.col("model_id") == model_id) if mapping is not None else None
            fixes = None
            if "overrides" in tabs:
                fixes = tabs["overrides"].filter((F.col("modelo_id") == model_id) & ~text.is_blank(F.col("clave")))
                fixes = fixes.select(F.trim("clave").alias("row_key"), F.trim("columna").alias("column"), F.col("valor").alias("value"), "position")
            out[model_id] = build_model(house, declared(row, read, presets), own, fixes, dry)
        except Exception as error:  # a model's fault stops no other
            out[model_id] = Built(alerts=[f"{model_id}: {type(error).__name__}: {' '.join(str(error).split())[:300]}"])
    return out


def publish_metadata(house, built: list[str], catalog: DataFrame, kpis: DataFrame) -> None:
    """Catalog rows of the built tables, and the KPIs that name one of them, beside those of other sources.

    catalog and kpis have ``table``; a KPI's may name several. Comments go to the tables.
    """
    mine = quality.visible_rows(catalog, built, every=True)
    for rows, name in ((mine, "catalog"), (quality.visible_rows(kpis, built, every=False), "kpis")):
        house.replace_rows(rows.withColumn("source_id", F.lit(OWN_METADATA)), f"{house.meta}.{name}", "source_id", [OWN_METADATA])
    if {"column", "description"} <= set(catalog.columns):
        notes = mine.filter(~text.is_blank(F.col("description"))).select(F.trim("table").alias("table"), "column", "description")
        for r in notes.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("column", "description"))).alias("notes")).collect():
            house.comment(f"{house.semantic}.{r['table']}", r["notes"])


def proposal_tsv(model: dict[str, str], fields: list[dict[str, str]]) -> str:
    """A proposed model as tab-separated rows to paste into the tabs."""
    heads = (("_modelos", ("modelo_id", "tabla_origen", "tabla_destino", "extractor", "columna_texto", "filtro", "activo"), [model | {"activo": "si"}]),)
    heads += (("_campos", ("modelo_id", "columna", "tipo", "patron", "requerido", "clasifica_en", "clasifica_con", "descripcion"), [{**f, "modelo_id": model["modelo_id"]} for f in fields]),) if fields else ()
    parts = ["\n".join([f"# {tab}", "\t".join(columns), *("\t".join(str(r.get(c, "")) for c in columns) for r in rows)]) for tab, columns, rows in heads]
    return "\n\n".join(parts)
