"""The semantic build, corrections by hand, source states, windows of calendars and conversations, catalog texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cauceda.operators import build, classify, extract
from cauceda.operators.cut import shared_folder
from cauceda.plans import catalog, memory
from cauceda.queries.base import Register, table
from cauceda.queries.semantic import notices
from cauceda.sources import calendar, pages, parts, registry
from cauceda.streaming import drafts

register = Register()

MODEL = {"modelo_id": "purchases", "tabla_origen": "mails", "columna_texto": "body", "filtro": "id % 3 <> 0"}
TABS = {
    "campos": [
        {"modelo_id": "purchases", "columna": "shop", "patron": "Comercio", "requerido": "si", "clasifica_en": "family"},
        {"modelo_id": "purchases", "columna": "paid", "tipo": "monto_con_moneda", "patron": "Monto|Importe", "requerido": "si"},
    ],
    "clasificacion": [
        {"modelo_id": "purchases", "patron": "tienda 1%", "valor": "ones", "prioridad": "5"}, {"modelo_id": "purchases", "patron": "%1", "valor": "ends", "prioridad": ""},
        {"modelo_id": "purchases", "clasifica_en": "elsewhere", "patron": "%", "valor": "never", "prioridad": "1"}, {"modelo_id": "another", "patron": "%", "valor": "never", "prioridad": "1"},
    ],
    "categorias": [],
    "joins": [{"modelo_id": "purchases", "tabla_auxiliar": "lines", "columna_base": "family", "columna_auxiliar": "family", "transformacion": "normalizado", "columnas_salida": "line"}],
}


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'Tienda ' || o_custkey AS shop, CASE WHEN o_orderkey = 2 THEN 0.5 ELSE round(o_totalprice, 2) END AS paid, 'CRC' AS paid_currency, family, line,
       'mails' AS source_table, 'purchases' AS model_id
FROM (SELECT *, CASE WHEN CAST(o_custkey AS VARCHAR) LIKE '1%' THEN 'ones' WHEN CAST(o_custkey AS VARCHAR) LIKE '%1' THEN 'ends' ELSE 'unclassified' END AS family FROM orders)
LEFT JOIN (VALUES ('ones', 'L1'), ('ends', 'L2')) t(f, line) ON family = f WHERE o_orderkey % 10 <> 7 AND o_orderkey % 3 <> 0
""")
def semantic_model(spark, sf_dir):
    """A model declared in tabs: filtered, extracted, labelled, looked up by its label, corrected by hand."""
    plan = build.declared(MODEL, TABS)
    aux = spark.createDataFrame([("ONES", "L1", 1), ("ones", "L9", 2), ("Ends", "L2", 3)], "family string, line string, _position int")
    overrides = spark.createDataFrame([("2", "paid", "0.5", 1), ("4", "paid", "much", 2), ("2", "none", "x", 3)], "row_key string, column string, value string, position int")
    rows = extract.accepted(build.extracted(notices(spark, sf_dir, "\n"), plan))
    return build.derive(rows, plan, {"lines": aux}, None, overrides)


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS row_key, CASE WHEN p_partkey % 5 = 0 THEN 'by hand' ELSE p_brand END AS brand,
       CAST(CASE WHEN p_partkey % 7 = 0 AND p_partkey % 21 <> 0 THEN p_partkey ELSE p_size END AS BIGINT) AS size FROM part
""")
def correct_by_hand(spark, sf_dir):
    """The last correction of a cell counts; what is not of the column's type changes nothing."""
    part = table(spark, sf_dir, "part").withColumn("row_key", F.col("p_partkey").cast("string"))
    given = [("p_partkey % 7 = 0", "size", F.col("row_key"), 1), ("p_partkey % 21 = 0", "size", F.lit("many"), 2), ("p_partkey % 5 = 0", "brand", F.lit("by hand"), 3), ("p_partkey = 1", "none", F.lit("x"), 4)]
    overrides = None
    for where, column, value, position in given:
        own = part.filter(where).select("row_key", F.lit(column).alias("column"), value.alias("value"), F.lit(position).alias("position"))
        overrides = own if overrides is None else overrides.unionByName(own)
    return classify.correct(part.select("row_key", F.col("p_brand").alias("brand"), F.col("p_size").cast("bigint").alias("size")), overrides, ["brand", "size"])


@register("""
SELECT CAST(n_regionkey AS VARCHAR) AS tenant, n_name[1] AS source_id, CASE n_nationkey % 4 WHEN 0 THEN 'No ' WHEN 1 THEN '' WHEN 2 THEN 'si' ELSE 'maybe' END AS active, n_nationkey AS position,
       CASE WHEN n_regionkey = 4 THEN 'unknown_tenant' WHEN row_number() OVER (PARTITION BY n_regionkey, n_name[1] ORDER BY n_nationkey) > 1 THEN 'repeated' WHEN n_nationkey % 4 < 2 THEN 'inactive' ELSE 'active' END AS state
FROM nation
""")
def source_states(spark, sf_dir):
    active = F.element_at(F.array(*map(F.lit, ("No ", "", "si", "maybe"))), F.col("n_nationkey").cast("int") % 4 + 1)
    sources = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("tenant"), F.substring("n_name", 1, 1).alias("source_id"), active.alias("active"), F.col("n_nationkey").alias("position"))
    tenants = table(spark, sf_dir, "region").filter("r_regionkey <> 4").select(F.col("r_regionkey").cast("string").alias("tenant"))
    return registry.states(sources, tenants)


@register("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Tabla ''' || r_name || ''': ' || n_name || '. Sistema de origen: erp. Frecuencia de actualizacion: . Dueño del dato: .'
       ELSE 'Columna ''' || n_name || ''' (tabla ''' || r_name || '''): ' || n_name || '. Origen: erp. Actualizacion: . Dueño: .' END || CASE WHEN n_nationkey % 2 = 0 THEN ' Instruccion: si.' ELSE '' END AS line
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def catalog_lines(spark, sf_dir):
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    column = F.when(key % 6 == 0, "*").when(key % 3 != 0, F.col("n_name"))
    cells = rows.select("n_nationkey", F.col("r_name").alias("table"), column.alias("column"), F.concat(F.lit(" "), "n_name").alias("description"), F.lit("erp").alias("system"), F.when(key % 2 == 0, "si").alias("instruction"))
    return catalog.lines(cells).select("n_nationkey", "line")


@register("""
SELECT o_orderkey, "table" FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS "table" FROM orders)
""")
def catalog_tables_named(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("; "), "o_orderstatus", F.lit(" ;"), "o_orderpriority", F.lit(";;")).alias("table"))
    return catalog.named_tables(rows)


@register("""
SELECT o_orderkey, o_orderstatus = 'P' AS gone FROM orders
WHERE o_orderstatus = 'P' OR (o_orderdate + INTERVAL 2 HOUR > TIMESTAMP '1995-05-18 00:00:00' AND o_orderdate < TIMESTAMP '1995-08-16 00:00:00')
""")
def calendar_window(spark, sf_dir):
    """Events that meet the window; cancelled ones come without times and stay."""
    gone = F.col("o_orderstatus") == "P"
    start = F.when(~gone, F.col("o_orderdate").cast("timestamp_ntz"))
    events = table(spark, sf_dir, "orders").select("o_orderkey", gone.alias("gone"), F.when(gone, "cancelled").otherwise("confirmed").alias("estado"), start.alias("inicio"), (start + F.expr("INTERVAL 2 HOUR")).alias("fin"))
    return calendar.window(events, F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "gone")


@register("""
SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 72 HOUR QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2
""")
def conversation_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return memory.history(events, ["user_id"], ["ts", "event_id"], "ts", F.lit(now).cast(dict(events.dtypes)["ts"]), most=2).select("event_id", "user_id")


@register("""
SELECT o_orderkey // 1000 + 1 AS page, o_orderkey AS id, o_custkey AS buyer_id, o_orderstatus AS buyer_state, o_totalprice AS total FROM orders WHERE o_orderkey // 1000 + 1 < 12
""")
def paged_orders(spark, sf_dir):
    """Pages of a service's payloads made of orders: the twelfth is empty, so nothing after it is read."""
    orders = table(spark, sf_dir, "orders").withColumn("page", F.expr("o_orderkey div 1000 + 1"))
    item = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("state")).alias("buyer"), F.col("o_totalprice").alias("total"))
    payload = F.to_json(F.struct(F.struct(F.collect_list(F.when(F.col("page") != 12, item)).alias("items")).alias("data")))
    path = f"{shared_folder(spark)}/cauceda/pages-{uuid.uuid4().hex}"
    orders.groupBy("page").agg(payload.alias("payload")).write.partitionBy("page").text(path)
    shape = "id long, buyer struct<id:long,state:string>, total double"
    return pages.read_pages(spark, path, shape, "data.items").rows


@register("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS sender, CAST(event_id % 3 AS VARCHAR) AS message, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'draft' ELSE 'confirm' END AS kind, epoch_us(ts) // 1000 AS t, event_id AS n FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sender, message ORDER BY t, n) AS i FROM e)
SELECT sender, message, t AS "at", outcome FROM (
  WITH RECURSIVE walk AS (
    SELECT sender, message, i, t, CASE kind WHEN 'draft' THEN 'drafted' ELSE 'unknown' END AS outcome, CASE kind WHEN 'draft' THEN t + 172800000 END AS last, FALSE AS done, CAST(NULL AS BIGINT) AS lapsed FROM numbered WHERE i = 1
    UNION ALL
    SELECT r.sender, r.message, r.i, r.t,
      CASE WHEN w.last >= r.t THEN CASE WHEN r.kind = 'draft' OR w.done THEN 'repeated' ELSE 'sent' END WHEN r.kind = 'draft' THEN 'drafted' ELSE 'unknown' END,
      CASE WHEN w.last >= r.t THEN w.last WHEN r.kind = 'draft' THEN r.t + 172800000 END,
      CASE WHEN w.last >= r.t THEN w.done OR r.kind = 'confirm' ELSE FALSE END,
      CASE WHEN w.last < r.t AND NOT w.done THEN w.last END
    FROM walk w JOIN numbered r ON r.sender = w.sender AND r.message = w.message AND r.i = w.i + 1)
  SELECT sender, message, t, outcome FROM walk
  UNION ALL SELECT sender, message, lapsed, 'lapsed' FROM walk WHERE lapsed IS NOT NULL
  UNION ALL SELECT sender, message, last, 'lapsed' FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY sender, message ORDER BY i DESC) = 1) WHERE last IS NOT NULL AND NOT done AND last < 1893456000000)
""")
def confirm_once(spark, sf_dir):
    """Events as drafts and confirmations of three messages a user, which lapse after two days."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    kind = F.when(F.col("event_type") == first, "draft").otherwise("confirm")
    rows = events.select("user_id", (F.col("event_id") % 3).alias("message"), kind.alias("kind"), "ts", "event_id")
    return drafts.settle(drafts.events_of(rows, "user_id", "message", "kind", "ts", "event_id"), drafts.Rules(2 * drafts.DAY), until=1_893_456_000_000)


@register("""
WITH e AS (SELECT event_id, event_type AS part, event_id % 1000 = 7 AS damaged FROM events WHERE event_type <> (SELECT min(event_type) FROM events)),
counts AS (SELECT part, count(*) AS records, count(*) FILTER (WHERE damaged) AS damaged FROM e GROUP BY 1)
SELECT 'part' AS how, event_id AS id, part FROM e WHERE part NOT IN (SELECT part FROM counts WHERE damaged > 0)
UNION ALL SELECT 'record', event_id, part FROM e WHERE NOT damaged
""")
def parts_that_fail(spark, sf_dir):
    """Events as parts of a source by their type, some records cut short and one part without files: what lands either way. Where every part has one, none lands whole."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())
    record = F.to_json(F.struct(F.col("event_id").alias("id")))
    path = f"{shared_folder(spark)}/cauceda/parts-{uuid.uuid4().hex}"
    written = events.filter(F.col("event_type") != kinds[0]).select(F.when(F.col("event_id") % 1000 == 7, F.left(record, F.length(record) - 1)).otherwise(record).alias("record"), F.col("event_type").alias("part"))
    written.write.partitionBy("part").text(path)
    out = [parts.read_parts(spark, {k: f"{path}/part={k}" for k in kinds}, how, may_be_empty=True).rows.withColumn("how", F.lit(how)) for how in parts.HOW]
    return out[0].unionByName(out[1]).select("how", F.get_json_object("record", "$.id").cast("long").alias("id"), "part")


QUERIES, ORACLES = register.queries, register.oracles
