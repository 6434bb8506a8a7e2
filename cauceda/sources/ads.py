"""Ad metrics as rows of a fixed contract, from the provider's JSON: one row an entity, day and breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauceda.functions import hashing, numbers
from cauceda.sources import parts

_LIST = "array<struct<action_type:string,value:string>>"
#: Contract columns that are read as text, as numbers, as whole numbers; with the payload's names.
TEXTS = {
    "cuenta_id": "account_id", "cuenta_nombre": "account_name", "moneda": "account_currency", "campana_id": "campaign_id", "campana_nombre": "campaign_name",
    "conjunto_id": "adset_id", "conjunto_nombre": "adset_name", "anuncio_id": "ad_id", "anuncio_nombre": "ad_name", "objetivo": "objective",
    "ranking_calidad": "quality_ranking", "ranking_interaccion": "engagement_rate_ranking", "ranking_conversion": "conversion_rate_ranking",
    "configuracion_atribucion": "attribution_setting",
}
DECIMALS = {
    "frecuencia": "frequency", "gasto": "spend", "ctr": "ctr", "ctr_unico": "unique_ctr", "cpc": "cpc", "cpm": "cpm", "cpp": "cpp",
    "ctr_enlace": "inline_link_click_ctr", "costo_por_clic_enlace": "cost_per_inline_link_click",
}
WHOLE = {"impresiones": "impressions", "alcance": "reach", "clics": "clicks", "clics_unicos": "unique_clicks"}
#: Metrics that arrive as a list of one.
LISTED = {
    "video_25": "video_p25_watched_actions", "video_50": "video_p50_watched_actions", "video_75": "video_p75_watched_actions",
    "video_100": "video_p100_watched_actions", "thruplays": "video_thruplay_watched_actions", "tiempo_medio_video_seg": "video_avg_time_watched_actions",
    "clics_salientes": "outbound_clicks", "ctr_saliente": "outbound_clicks_ctr", "roas_compra": "purchase_roas",
}
#: Columns by the type of action they count.
ACTIONS = {
    "clics_enlace": "link_click", "vistas_pagina_destino": "landing_page_view", "interacciones_publicacion": "post_engagement",
    "interacciones_pagina": "page_engagement", "reacciones": "post_reaction", "comentarios": "comment", "compartidos": "post",
    "guardados": "onsite_conversion.post_save", "reproducciones_video": "video_view", "leads": "lead", "compras": "purchase",
    "agregados_carrito": "add_to_cart", "checkouts_iniciados": "initiate_checkout",
    "conversaciones_iniciadas": "onsite_conversion.messaging_conversation_started_7d",
}
#: Counts that also come as a field of their own, which goes first.
DIRECT = {"clics_enlace": "inline_link_clicks", "interacciones_publicacion": "inline_post_engagement"}
JSON = {"acciones": "actions", "valores_acciones": "action_values", "costo_por_accion": "cost_per_action_type"}
RATES = {"cpa_compra": "compras", "costo_por_lead": "leads", "costo_por_conversacion": "conversaciones_iniciadas"}
NOT_WHOLE = ("tiempo_medio_video_seg", "ctr_saliente", "roas_compra")
ENTITY = {"ad": "anuncio", "adset": "conjunto", "campaign": "campana", "account": "cuenta"}
#: The contract's columns in order.
COLUMNS = (
    "insight_id", "cuenta_id", "cuenta_nombre", "moneda", "zona_horaria", "nivel", "entidad_id", "entidad_nombre", "campana_id", "campana_nombre", "conjunto_id",
    "conjunto_nombre", "anuncio_id", "anuncio_nombre", "objetivo", "fecha", "fecha_fin", "desglose", "impresiones", "alcance", "frecuencia", "gasto", "clics",
    "clics_unicos", "ctr", "ctr_unico", "cpc", "cpm", "cpp", "clics_enlace", "ctr_enlace", "costo_por_clic_enlace", "clics_salientes", "ctr_saliente",
    "vistas_pagina_destino", "interacciones_publicacion", "interacciones_pagina", "reacciones", "comentarios", "compartidos", "guardados",
    "reproducciones_video", "video_25", "video_50", "video_75", "video_100", "thruplays", "tiempo_medio_video_seg", "leads", "compras", "valor_compras",
    "agregados_carrito", "checkouts_iniciados", "conversaciones_iniciadas", "roas_compra", "cpa_compra", "costo_por_lead", "costo_por_conversacion",
    "ranking_calidad", "ranking_interaccion", "ranking_conversion", "configuracion_atribucion", "acciones", "valores_acciones", "costo_por_accion",
    "raw_insight",
)


def _number(col: Column) -> Column:
    return F.when(col.rlike(r"^\s*-?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?\s*$"), F.trim(col).cast("double"))


def _action(actions: Column, kind: str) -> Column:
    """The value of the first action of a kind; null if there is none."""
    return _number(F.get(F.filter(actions, lambda a: a["action_type"] == kind), F.lit(0))["value"])


def insights_of(raw: DataFrame, level: str, breakdowns: tuple[str, ...] = (), zone: str = "") -> DataFrame:
    """The contract and version_hash of JSON texts in the column ``insight``."""
    scalars = {*TEXTS.values(), *DECIMALS.values(), *WHOLE.values(), *DIRECT.values(), "date_start", "date_stop", *breakdowns}
    lists = {*LISTED.values(), *JSON.values()}
    shape = ", ".join([*(f"{s} string" for s in sorted(scalars)), *(f"{x} {_LIST}" for x in sorted(lists))])
    df = raw.select("insight", F.from_json("insight", shape).alias("i"))
    at = lambda name: F.col(f"i.{name}")
    none = F.lit("")
    c = {k: F.coalesce(at(v), none) for k, v in TEXTS.items()}
    c |= {k: _number(at(v)) for k, v in DECIMALS.items()}
    c |= {k: _number(at(v)).cast("bigint") for k, v in WHOLE.items()}
    for k, v in LISTED.items():
        value = _number(F.get(at(v), F.lit(0))["value"])
        c[k] = value if k in NOT_WHOLE else F.bround(value).cast("bigint")
    for k, v in ACTIONS.items():
        value = F.bround(_action(at("actions"), v)).cast("bigint")
        c[k] = F.coalesce(_number(at(DIRECT[k])).cast("bigint"), value) if k in DIRECT else value
    c["valor_compras"] = _action(at("action_values"), "purchase")
    c |= {k: F.coalesce(F.to_json(at(v)), F.lit("[]")) for k, v in JSON.items()}
    c |= {k: numbers.safe_ratio(c["gasto"], c[v]) for k, v in RATES.items()}
    c |= {"fecha": F.try_to_date(F.substring(at("date_start"), 1, 10), "yyyy-MM-dd"), "fecha_fin": F.try_to_date(F.substring(at("date_stop"), 1, 10), "yyyy-MM-dd")}
    kind = ENTITY[level]
    c |= {"zona_horaria": F.lit(zone), "nivel": F.lit(level), "entidad_id": c[f"{kind}_id"], "entidad_nombre": c[f"{kind}_nombre"], "raw_insight": F.col("insight")}
    c["desglose"] = hashing.breakdown({b: F.coalesce(at(b), none) for b in breakdowns}) if breakdowns else none
    c["insight_id"] = hashing.identity_hash(*(c[k] for k in ("cuenta_id", "nivel", "entidad_id", "fecha", "fecha_fin", "desglose")))
    out = df.select(*(c[k].alias(k) for k in COLUMNS))
    return out.withColumn("version_hash", hashing.content_hash(*(k for k in COLUMNS if k != "insight_id")))


def insights(spark: SparkSession, path: str, level: str, breakdowns: tuple[str, ...] = (), zone: str = "", only_spent: bool = False) -> DataFrame:
    """The insights of files of one JSON text a line; several accounts' files are one table."""
    out = insights_of(spark.read.text(path).select(F.col("value").alias("insight")), level, breakdowns, zone)
    return out.filter("coalesce(gasto, 0) > 0") if only_spent else out


def accounts(spark: SparkSession, paths: dict[str, str], level: str, breakdowns: tuple[str, ...] = (), zone: str = "", only_spent: bool = False, damaged: str = "part") -> tuple[DataFrame, parts.Parts]:
    """The insights of several accounts, each under its own path, and what was read of each. One that fails stops no other."""
    found = parts.read_parts(spark, paths, damaged)
    out = insights_of(found.rows.select(F.col("record").alias("insight")), level, breakdowns, zone)
    return (out.filter("coalesce(gasto, 0) > 0") if only_spent else out), found


def structure_of(raw: DataFrame, level: str, minor_units: int = 100) -> DataFrame:
    """Campaigns, sets or ads with budgets in major units. raw: item (JSON text)."""
    df = raw.select(F.from_json("item", "id string, name string, status string, effective_status string, daily_budget string, lifetime_budget string").alias("i"))
    budget = {n: _number(F.col(f"i.{v}")) / minor_units for n, v in (("presupuesto_diario", "daily_budget"), ("presupuesto_total", "lifetime_budget"))}
    return df.select(F.col("i.id").alias("entidad_id"), F.lit(level).alias("nivel"), F.col("i.name").alias("nombre"), F.col("i.status").alias("estado"), F.col("i.effective_status").alias("estado_efectivo"), *(b.alias(n) for n, b in budget.items()))
