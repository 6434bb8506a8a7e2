"""Scans, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cauceda.operators import trends
from cauceda.plans import chart
from cauceda.queries.base import Register, table

register = Register()
REVENUE = "l_extendedprice * (1 - l_discount)"


def cents(column: str):
    return F.round(F.sum(column), 2)


@register("""
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
SELECT period, total, round(total - lag(total) OVER (ORDER BY period), 2) AS difference,
       round(100 * (total - lag(total) OVER (ORDER BY period)) / nullif(lag(total) OVER (ORDER BY period), 0), 2) AS variation FROM m
""")
def period_variation(spark, sf_dir):
    """Sales month by month with the change to the month before."""
    series = trends.monthly(table(spark, sf_dir, "orders"), "o_orderdate", cents("o_totalprice"))
    return trends.variation(series, "period", "total")


@register("""
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
s AS (SELECT *, total - lag(total) OVER (ORDER BY period) AS step FROM m)
SELECT count(*) FILTER (WHERE step > 0) AS rises, count(*) FILTER (WHERE step < 0) AS falls, count(*) FILTER (WHERE step = 0) AS equal,
       min_by(total, period) AS first, max_by(total, period) AS last,
       round(100 * (max_by(total, period) - min_by(total, period)) / nullif(min_by(total, period), 0), 2) AS change FROM s
""")
def trend_summary(spark, sf_dir):
    series = trends.monthly(table(spark, sf_dir, "orders"), "o_orderdate", cents("o_totalprice"))
    return trends.summary(series, "period", "total")


@register("SELECT o_orderkey, o_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "o_totalprice")


@register("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(spark, sf_dir):
    """Orders are summed by customer before the join, so it meets one row a customer."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), cents("o_totalprice").alias("spent"))
    out = table(spark, sf_dir, "customer").join(spent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@register("""
SELECT coalesce(n.n_nationkey, s.k) AS nationkey, n.n_name, s.suppliers FROM nation n
FULL JOIN (SELECT s_nationkey % 30 + 5 AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON n.n_nationkey = s.k
""")
def join_full(spark, sf_dir):
    shifted = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 30 + 5).alias("k")).agg(F.count("*").alias("suppliers"))
    out = table(spark, sf_dir, "nation").join(shifted, F.col("n_nationkey") == F.col("k"), "full")
    return out.select(F.coalesce("n_nationkey", "k").alias("nationkey"), "n_name", "suppliers")


@register("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(spark, sf_dir):
    """Regions are a fixed handful; nothing larger is crossed."""
    region = table(spark, sf_dir, "region")
    return region.select(F.col("r_name").alias("a")).crossJoin(F.broadcast(region.select(F.col("r_name").alias("b"))))


@register("SELECT p_brand, s.size_class, count(*) AS parts FROM part JOIN (VALUES ('small', 1, 15), ('medium', 16, 35), ('large', 36, 50)) s(size_class, lo, hi) ON p_size BETWEEN lo AND hi GROUP BY 1, 2")
def join_theta(spark, sf_dir):
    """A range condition over three fixed classes."""
    classes = spark.createDataFrame([("small", 1, 15), ("medium", 16, 35), ("large", 36, 50)], "size_class string, lo int, hi int")
    met = table(spark, sf_dir, "part").join(F.broadcast(classes), F.col("p_size").between(F.col("lo"), F.col("hi")))
    return met.groupBy("p_brand", "size_class").agg(F.count("*").alias("parts"))


@register("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_orphans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@register("SELECT s_suppkey FROM supplier WHERE lower(trim(s_name)) IN (SELECT lower(replace(trim(c_name), 'Customer', 'Supplier')) FROM customer)")
def semi_collision(spark, sf_dir):
    """Names that another source uses too, compared trimmed and in lower case."""
    names = table(spark, sf_dir, "customer").select(F.lower(F.replace(F.trim("c_name"), F.lit("Customer"), F.lit("Supplier"))).alias("_name"))
    return table(spark, sf_dir, "supplier").join(names, F.lower(F.trim("s_name")) == F.col("_name"), "left_semi").select("s_suppkey")


@register("SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) FILTER (WHERE l_quantity < 10) AS small, count(*) AS rows FROM lineitem GROUP BY 1, 2")
def count_filter(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return out.agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_quantity") < 10).alias("small"), F.count("*").alias("rows"))


def _grouped(name: str, by: str) -> str:
    return f"SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {by}"


def _totals(grouped):
    return grouped.agg(F.count("*").alias("orders"), cents("o_totalprice").alias("total"))


@register(_grouped("cube", "CUBE (o_orderstatus, o_orderpriority)"))
def cube_sales(spark, sf_dir):
    return _totals(table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority"))


@register(_grouped("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"))
def rollup_sales(spark, sf_dir):
    return _totals(table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority"))


@register(_grouped("sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def grouping_sets_sales(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return _totals(table(spark, sf_dir, "orders").groupingSets([[status], [priority], []], status, priority))


@register()
def approx_distinct(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return out.agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median_price"))


@register("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_discount), 4) AS avg_disc, count(*) AS rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
    return out.agg(cents("l_quantity").alias("sum_qty"), cents("l_extendedprice").alias("sum_base"), F.round(F.sum(F.expr(REVENUE)), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("rows"))


@register("""
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def revenue_by_nation(spark, sf_dir):
    """Lines are summed by order, then by customer, before the small dimensions are joined."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr(REVENUE)).alias("revenue"))
    sold = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_customer = sold.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = by_customer.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return placed.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(cents("revenue").alias("revenue"))


@register("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events
""")
def sliding_rate(spark, sf_dir):
    return trends.recent_count(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@register("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(spark, sf_dir):
    return trends.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3)


@register("SELECT c_nationkey, c_custkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place FROM customer QUALIFY place <= 5")
def rank_top_customers(spark, sf_dir):
    place = F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal")))
    out = table(spark, sf_dir, "customer").withColumn("place", place).filter("place <= 5")
    return out.select("c_nationkey", "c_custkey", "c_acctbal", F.col("place").cast("bigint").alias("place"))


@register("""
WITH t AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)
SELECT status, priority, total, round(sum(total) OVER (PARTITION BY status), 2) AS group_total, round(sum(total) OVER (), 2) AS grand_total FROM t
""")
def subtotals_over(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(cents("o_totalprice").alias("total"))
    out = trends.with_subtotals(parts, "status", "total")
    return out.select("status", "priority", "total", F.round("group_total", 2).alias("group_total"), F.round("grand_total", 2).alias("grand_total"))


@register("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def topk_abs(spark, sf_dir):
    return trends.top_by_size(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 25, ("c_custkey",))


@register("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def last_n_periods(spark, sf_dir):
    return trends.last_periods(trends.monthly(table(spark, sf_dir, "orders"), "o_orderdate", cents("o_totalprice")), "period", 24)


@register("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier")
def union_sources(spark, sf_dir):
    parts = []
    for kind, p in (("customer", "c"), ("supplier", "s")):
        key = f"{p}_custkey" if p == "c" else f"{p}_suppkey"
        parts.append(table(spark, sf_dir, kind).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance")))
    return parts[0].unionByName(parts[1])


@register("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).subtract(table(spark, sf_dir, "supplier").select("s_nationkey"))


@register("SELECT l_partkey AS partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def intersect_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.filter("l_quantity > 45").select(F.col("l_partkey").alias("partkey")).intersect(lines.filter("l_discount > 0.09").select("l_partkey"))


@register("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def tumbling_events(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), cents("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "events", "total")


@register("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, session
""")
def session_events(spark, sf_dir):
    """Sessions that end after 30 minutes without an event."""
    out = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events"))
    return out.select("user_id", "start", "last", "events")


@register("""
WITH d AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS x, round(sum(l_extendedprice), 2) AS gross, CAST(count(*) AS DOUBLE) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1),
p AS (SELECT 'Part ' || l_partkey AS x, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS lines, sum(l_linenumber) * 1000.0 AS places FROM lineitem GROUP BY 1),
points AS (
  SELECT 'days' AS chart, row_number() OVER (ORDER BY x) AS position, x AS label, 'line' AS kind, unnest([{'s': 'gross', 'v': gross}, {'s': 'lines', 'v': lines}, {'s': 'net', 'v': net}]) AS c FROM (SELECT * FROM d ORDER BY x DESC LIMIT 90)
  UNION ALL
  SELECT 'parts', row_number() OVER (ORDER BY quantity DESC, x), x, CASE WHEN max(length(x)) OVER () > 10 THEN 'bars' ELSE 'columns' END, unnest([{'s': 'quantity', 'v': quantity}, {'s': 'lines', 'v': lines}, {'s': 'places', 'v': places}])
  FROM (SELECT * FROM p ORDER BY quantity DESC, x LIMIT 25)),
scales AS (
  SELECT 'days' AS chart, unnest([{'s': 'gross', 'r': 1.0}, {'s': 'lines', 'r': max(lines) / max(gross)}, {'s': 'net', 'r': max(net) / max(gross)}]) AS r FROM d
  UNION ALL SELECT 'parts', unnest([{'s': 'quantity', 'r': 1.0}, {'s': 'lines', 'r': max(lines) / max(quantity)}, {'s': 'places', 'r': max(places) / max(quantity)}]) FROM p)
SELECT chart, position, label, kind, c.s AS series, c.v AS value FROM points JOIN scales USING (chart) WHERE c.s = r.s AND r.r BETWEEN 0.05 AND 20
""")
def chart_points(spark, sf_dir):
    """What two charts of sums over lines show: the last days, the largest parts, each with the series that share a scale."""
    lines = table(spark, sf_dir, "lineitem")
    days = lines.groupBy(F.to_date("l_shipdate").alias("day")).agg(cents("l_extendedprice").alias("gross"), F.count("*").alias("lines"), F.round(F.sum(F.expr(REVENUE)), 2).alias("net"))
    parts = lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"), (F.sum("l_linenumber") * 1000).alias("places"))
    parts = parts.select(F.concat(F.lit("Part "), "l_partkey").alias("part"), "quantity", "lines", "places")
    out = None
    for name, result in (("days", days), ("parts", parts)):
        shown = chart.plan(result)
        told = F.explode(F.arrays_zip(F.array(*map(F.lit, shown.series)).alias("series"), F.col("values").alias("value"))).alias("c")
        points = shown.points.select(F.lit(name).alias("chart"), "position", "label", "kind", told).select("chart", "position", "label", "kind", "c.series", "c.value")
        out = points if out is None else out.unionByName(points)
    return out


QUERIES, ORACLES = register.queries, register.oracles
