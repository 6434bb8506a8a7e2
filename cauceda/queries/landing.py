"""Landing: lineage, inference, guards, the run log, upserts and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauceda.functions import dates
from cauceda.operators import infer, quality, upsert
from cauceda.operators.identity import Identity
from cauceda.queries.base import Register, table
from cauceda.sources import ads, calendar, sinks
from cauceda.streaming import state

register = Register()


def at():
    """When the queries' runs take place."""
    return F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")



@register("SELECT *, 'run-1' AS _run_id, 'erp' AS _source_id, TIMESTAMP '2026-01-02 03:04:05' AS _ingested_at FROM orders")
def scan_lineage(spark, sf_dir):
    return sinks.with_lineage(table(spark, sf_dir, "orders"), "run-1", "erp", at())


def as_text(spark, sf_dir):
    """Orders as a sheet would give them: day-first dates, comma decimals, some junk."""
    orders = table(spark, sf_dir, "orders")
    amount = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.when(F.col("o_orderkey") % 50 == 0, "n/d").otherwise(amount).alias("amount"), F.col("o_orderpriority").alias("priority"),
    )


@register("""
SELECT 'amount' AS column, 'number' AS kind, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS kept FROM orders UNION ALL
SELECT 'day', 'timestamp', count(*), count(*) FROM orders UNION ALL SELECT 'key', 'number', count(*), count(*) FROM orders UNION ALL SELECT 'priority', 'text', count(*), count(*) FROM orders
""")
def type_inference_profile(spark, sf_dir):
    found = infer.profiles(as_text(spark, sf_dir))
    kept = {"number": lambda p: p.numeric, "timestamp": lambda p: p.dated, "text": lambda p: p.filled}
    return spark.createDataFrame([(p.column, p.kind, p.rows, kept[p.kind](p)) for p in found], "column string, kind string, rows bigint, kept bigint")


@register("""
SELECT CAST(o_orderkey AS DOUBLE) AS key, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, CASE WHEN o_orderkey % 50 <> 0 THEN round(o_totalprice, 2) END AS amount, o_orderpriority AS priority FROM orders
""")
def infer_types(spark, sf_dir):
    return infer.infer(as_text(spark, sf_dir))[0]


@register("""
SELECT count(*) FILTER (WHERE day(o_orderdate) > 12) AS day_first, CAST(0 AS BIGINT) AS month_first, count(*) FILTER (WHERE day(o_orderdate) <= 12) AS either FROM orders
""")
def date_convention_evidence(spark, sf_dir):
    return as_text(spark, sf_dir).agg(*(c.alias(n) for n, c in dates.evidence(F.col("day")).items()))


def run_log(spark, sf_dir):
    """Runs made of orders: a source by priority, a table by status, every seventh run failed."""
    orders = table(spark, sf_dir, "orders")
    detail = F.to_json(F.create_map(F.col("o_orderstatus"), F.struct(F.array(F.lit("a"), F.col("o_orderstatus")).alias("columns"), F.col("o_custkey").alias("rows"))))
    status = F.when(F.col("o_orderkey") % 7 == 0, "error").when(F.col("o_orderkey") % 5 == 0, "ok_with_alerts").otherwise("ok")
    finished = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)") / 1000)
    return orders.select(F.col("o_orderpriority").alias("source_id"), status.alias("status"), finished.alias("finished"), detail.alias("detail"), F.col("o_custkey").alias("rows"))


@register("""
WITH r AS (SELECT o_orderpriority AS source_id, o_orderstatus AS t, o_custkey AS rows, o_orderdate + to_milliseconds(o_orderkey) AS finished FROM orders WHERE o_orderkey % 7 <> 0
           QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate + to_milliseconds(o_orderkey) DESC) <= 20)
SELECT source_id, t AS "table", max_by(rows, finished) AS rows, 'a,' || t AS columns FROM r GROUP BY source_id, t
""")
def runlog_newest_merge(spark, sf_dir):
    return upsert.latest_detail(run_log(spark, sf_dir)).select("source_id", "table", "rows", F.concat_ws(",", "columns").alias("columns"))


@register("""
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'ok_with_alerts' ELSE 'ok' END AS status, count(*) AS runs, CAST(sum(o_custkey) AS BIGINT) AS rows FROM orders GROUP BY 1
""")
def run_summary(spark, sf_dir):
    return quality.run_summary(run_log(spark, sf_dir))


@register("""
SELECT o_orderpriority AS source_id, max(o_orderdate + to_milliseconds(o_orderkey)) AS last_ok, max(o_orderdate + to_milliseconds(o_orderkey)) > TIMESTAMP '1998-08-01' - INTERVAL 60 MINUTE AS fresh
FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1
""")
def freshness(spark, sf_dir):
    return quality.fresh(run_log(spark, sf_dir), F.lit("1998-08-01").cast("timestamp"), F.lit(60))


@register("""
SELECT 'events' AS "table", FALSE AS blocked, TRUE AS dropped, 'n' AS added, 'ts' AS missing UNION ALL SELECT 'labels', TRUE, FALSE, '', '' UNION ALL
SELECT 'new', FALSE, FALSE, '', '' UNION ALL SELECT 'orders', FALSE, FALSE, '', ''
""")
def drift_and_emptiness(spark, sf_dir):
    shape = "table string, columns array<string>, rows bigint"
    n = table(spark, sf_dir, "orders").count()
    was = spark.createDataFrame([("orders", ["a", "b"], 2 * n), ("events", ["id", "ts"], 1000), ("labels", ["a"], 9)], shape)
    now = spark.createDataFrame([("orders", ["b", "a"], n), ("events", ["id", "n"], 499), ("labels", ["a"], 0), ("new", ["x"], 0)], shape)
    out = quality.review(was, now)
    return out.select("table", "blocked", "dropped", F.concat_ws(",", "added").alias("added"), F.concat_ws(",", "missing").alias("missing"))


def versioned(spark, sf_dir, tombstone=False):
    """Stored customers, and a re-read window of them: some changed, some new, one repeated, one tombstone in nine."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"))
    stored = upsert.stamped(customer.filter("id % 3 <> 0"), ["name", "state"], "run-1", at())
    window = customer.filter("id % 2 = 0").withColumn("position", F.lit(1))
    changed = window.filter("id % 4 = 0").withColumns({"name": F.concat("name", F.lit("*")), "position": F.lit(2)})
    if tombstone:
        changed = changed.withColumns({"name": F.when(F.col("id") % 9 == 1, "").otherwise(F.col("name")), "state": F.when(F.col("id") % 9 == 1, "cancelled").otherwise(F.col("state"))})
    return stored, window.unionByName(changed)


@register("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name || '*' ELSE c_name END AS name, c_mktsegment AS state, CASE WHEN c_custkey % 2 = 0 THEN 'run-2' ELSE 'run-1' END AS run_id,
       CASE WHEN c_custkey % 2 <> 0 THEN 'kept' WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 4 = 0 THEN 'updated' ELSE 'unchanged' END AS action
FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0
""")
def upsert_versioned(spark, sf_dir):
    stored, window = versioned(spark, sf_dir)
    out = upsert.upsert(stored, window, ["id"], ["name", "state"], "run-2", at(), position="position")
    return out.select("id", "name", "state", "run_id", "action")


@register("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 9 <> 1 THEN c_name || '*' WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN '' ELSE c_name END AS name,
       CASE WHEN c_custkey % 4 = 0 AND c_custkey % 9 = 1 THEN 'cancelled' ELSE c_mktsegment END AS state FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0
""")
def tombstone_merge(spark, sf_dir):
    """A cancelled row keeps the stored name where its own is blank."""
    stored, window = versioned(spark, sf_dir, True)
    out = upsert.upsert(stored, window, ["id"], ["name", "state"], "run-2", at(), "position", F.col("state") == "cancelled", ("name",))
    return out.select("id", "name", "state")


@register("""
WITH s AS (SELECT 'e' || event_id AS id, CASE WHEN event_id % 11 = 0 THEN '' ELSE user_id || '-' || event_type END AS alias, value AS v FROM events WHERE event_id % 3 <> 0),
n AS (SELECT CASE WHEN event_id % 8 = 0 THEN 'e' ELSE 'm' END || event_id AS id, CASE WHEN event_id % 11 = 0 THEN '' ELSE user_id || '-' || event_type END AS alias, value AS v, event_id AS p FROM events WHERE event_id % 4 = 0),
one AS (SELECT id AS nid, id AS sid FROM n JOIN s USING (id)),
n2 AS (SELECT id AS nid, alias, row_number() OVER (PARTITION BY alias ORDER BY p DESC, id) AS place FROM n WHERE alias <> '' AND id NOT IN (SELECT nid FROM one)),
s2 AS (SELECT id AS sid, alias, row_number() OVER (PARTITION BY alias ORDER BY id) AS place FROM s WHERE alias <> '' AND id NOT IN (SELECT sid FROM one)),
pairs AS (SELECT * FROM one UNION ALL SELECT nid, sid FROM n2 JOIN s2 USING (alias, place))
SELECT n.id, n.alias, n.v, CASE WHEN s.id IS NULL THEN 'new' WHEN s.v = n.v AND s.alias = n.alias THEN 'unchanged' ELSE 'updated' END AS action
FROM n LEFT JOIN pairs ON nid = n.id LEFT JOIN s ON s.id = sid
UNION ALL SELECT id, alias, v, 'kept' FROM s WHERE id NOT IN (SELECT id FROM n) AND alias NOT IN (SELECT alias FROM n WHERE alias <> '')
""")
def upsert_by_identities(spark, sf_dir):
    """Rows whose id changed are known by an alias that several rows share: pairs one to one, the newest first, the rest merged or new."""
    events = table(spark, sf_dir, "events")
    alias = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat_ws("-", "user_id", "event_type")).alias("alias")
    stored = events.filter("event_id % 3 <> 0").select(F.concat(F.lit("e"), "event_id").alias("id"), alias, F.col("value").alias("v"))
    name = F.concat(F.when(F.col("event_id") % 8 == 0, "e").otherwise("m"), "event_id").alias("id")
    window = events.filter("event_id % 4 = 0").select(name, alias, F.col("value").alias("v"), F.col("event_id").alias("p"))
    out = upsert.upsert(upsert.stamped(stored, ["alias", "v"], "run-1", at()), window, ["id"], ["alias", "v"], "run-2", at(), "p", identities=[Identity(("alias",))])
    return out.select("id", "alias", "v", "action")


@register("""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, user_id, event_id % 3 <> 0 AS stored, (SELECT max(CAST(ts AS DATE)) FROM events) - CAST(ts AS DATE) AS age FROM events)
SELECT event_id, CASE WHEN age < 3 AND event_id % 2 = 0 AND event_id % 10 = 4 THEN CAST(day - INTERVAL 40 DAY AS DATE) ELSE day END AS day,
       CASE WHEN age < 3 AND event_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
       CASE WHEN age >= 3 OR event_id % 2 = 1 THEN 'run-1' ELSE 'run-2' END AS run_id
FROM e WHERE stored OR (age < 3 AND event_id % 2 = 0)
""")
def upsert_by_day(spark, sf_dir):
    """A window of three days into a table by day: other days keep their files; some rows move to a day before the window."""
    house = sinks.Warehouse(spark, "consultas")
    name = f"{house.raw}.events_by_day"
    house.drop(name)
    day = F.to_date("ts")
    events = table(spark, sf_dir, "events").select("event_id", day.alias("day"), "user_id")
    last = events.agg(F.max("day")).first()[0]
    house.upsert_days(events.filter("event_id % 3 <> 0"), name, ["event_id"], ["day", "user_id"], "run-1", "day")
    window = events.filter((F.datediff(F.lit(last), "day") < 3) & (F.col("event_id") % 2 == 0))
    moved = F.when(F.col("event_id") % 10 == 4, F.date_sub("day", 40)).otherwise(F.col("day"))
    changed = F.when(F.col("event_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    house.upsert_days(window.select("event_id", moved.alias("day"), changed.alias("user_id")), name, ["event_id"], ["day", "user_id"], "run-2", "day")
    return spark.table(name).select("event_id", "day", "user_id", "run_id")


@register("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_dup_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("position"))
    return upsert.last_wins(events, ["user_id"], "position").drop("position")


@register("SELECT DISTINCT event_id % 500 AS id FROM events")
def dedup_by_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("id")).dropDuplicates(["id"])


@register("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS message_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, CASE event_id % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'delivered' WHEN 2 THEN 'read' WHEN 3 THEN 'failed' ELSE 'aceptado' END AS status FROM events),
a AS (SELECT message_id, min(position) FILTER (WHERE status = 'failed') AS f, min(position) FILTER (WHERE status IN ('delivered', 'read')) AS d,
             max(CASE status WHEN 'sent' THEN 1 WHEN 'delivered' THEN 2 WHEN 'read' THEN 3 ELSE 0 END) AS r FROM e GROUP BY 1)
SELECT message_id, CASE WHEN f IS NOT NULL AND (d IS NULL OR f < d) THEN 'failed' WHEN r = 3 THEN 'read' WHEN r = 2 THEN 'delivered' WHEN r = 1 THEN 'sent' ELSE 'aceptado' END AS state FROM a
""")
def delivery_state_fold(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("sent", "delivered", "read", "failed", "aceptado"))), (F.col("event_id") % 5 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("message_id"), F.struct("ts", "event_id").alias("position"), status.alias("status"))
    return state.delivery(events)


@register("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT user_id, i, event_id, TRUE AS admitted, t AS p1, CAST(NULL AS BIGINT) AS p2 FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.event_id, w.p2 IS NULL OR w.p2 <= e.t - 86400000000,
    CASE WHEN w.p2 IS NULL OR w.p2 <= e.t - 86400000000 THEN e.t ELSE w.p1 END, CASE WHEN w.p2 IS NULL OR w.p2 <= e.t - 86400000000 THEN w.p1 ELSE w.p2 END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id AS row_id, admitted FROM walk
""")
def throttled_events(spark, sf_dir):
    """At most 2 admitted events in a day for each user; denied ones do not count."""
    return state.throttle(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 86400)


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS evento_id, 'Pedido ' || o_custkey AS titulo, o_orderdate AS inicio, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(90 AS BIGINT) END AS duracion_min, o_orderkey % 4 = 0 AS todo_el_dia, 'default' AS tipo_evento FROM orders
""")
def calendar_events(spark, sf_dir):
    """Orders as calendar events with offsets, every fourth one all day; times come back as UTC."""
    day = F.col("o_orderkey") % 4 == 0
    shape = lambda ts: F.when(day, F.struct(F.lit(None).cast("string").alias("dateTime"), F.date_format(ts, "yyyy-MM-dd").alias("date"))).otherwise(F.struct(F.concat(F.date_format(ts - F.make_dt_interval(hours=F.lit(6)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-06:00")).alias("dateTime"), F.lit(None).cast("string").alias("date")))
    start, end = F.col("o_orderdate"), F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(90))
    event = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Pedido "), F.col("o_custkey").cast("string")).alias("summary"), shape(start).alias("start"), shape(end).alias("end")))
    raw = table(spark, sf_dir, "orders").select(F.lit("c1").alias("calendar_id"), F.lit("Ana").alias("recurso"), event.alias("event"))
    out = calendar.events_of(raw)
    return out.select("evento_id", "titulo", F.col("inicio").cast("timestamp_ntz").alias("inicio"), "duracion_min", "todo_el_dia", "tipo_evento")


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS campana_id, CAST(o_orderdate AS DATE) AS fecha, round(o_totalprice, 2) AS gasto, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS compras,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 > 0 ELSE FALSE END AS has_cpa, CASE WHEN o_orderkey % 2 = 0 THEN CAST(7 AS BIGINT) END AS video_25 FROM orders
""")
def ad_insights(spark, sf_dir):
    """Orders as campaign insights: string numbers, action lists, lists of one; no purchases make no cost a purchase."""
    text = lambda c: F.col(c).cast("string")
    actions = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.struct(F.lit("lead").alias("action_type"), F.lit("1").alias("value")), F.struct(F.lit("purchase").alias("action_type"), (F.col("o_custkey") % 4).cast("string").alias("value"))))
    video = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("video_view").alias("action_type"), F.lit("7").alias("value"))))
    item = F.to_json(F.struct(text("o_orderkey").alias("campaign_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string").alias("spend"), actions.alias("actions"), video.alias("video_p25_watched_actions")))
    out = ads.insights_of(table(spark, sf_dir, "orders").select(item.alias("insight")), "campaign")
    return out.select("campana_id", "fecha", "gasto", "compras", F.col("cpa_compra").isNotNull().alias("has_cpa"), "video_25")


QUERIES, ORACLES = register.queries, register.oracles
