"""Governed queries: policies, KPI choice and formulas, projection and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauceda.operators import quality, trends
from cauceda.plans import guard, kpis, policy, tables
from cauceda.queries.base import Register, table

register = Register()

#: What the catalog of the query below says of a column, by the remainder of a part's size.
INSTRUCTIONS = ("si: ventas públicas", "confidencial", "puede usar el bot", "interno", "", "X")


@register("""
SELECT p_brand AS "table", coalesce(arg_min(ok, p_partkey) FILTER (whole), bool_and(ok)) AS allowed, coalesce(arg_min(p_name, p_partkey) FILTER (whole), '') AS description
FROM (SELECT *, p_partkey % 90 = 0 AS whole, p_size % 6 IN (0, 2, 5) OR p_partkey % 4 <> 0 AS ok FROM part) GROUP BY 1
""")
def policy_resolution(spark, sf_dir):
    """Brands as tables with their parts as columns; some have a row for the whole table."""
    part = table(spark, sf_dir, "part")
    said = F.when(F.col("p_partkey") % 4 != 0, "sí").otherwise(F.element_at(F.array(*map(F.lit, INSTRUCTIONS)), F.col("p_size") % 6 + 1))
    column = F.when(F.col("p_partkey") % 90 == 0, F.when(F.col("p_partkey") % 180 == 0, "*").otherwise(" ")).otherwise(F.col("p_name"))
    rows = part.select(F.concat(F.lit(" "), "p_brand").alias("table"), column.alias("column"), said.alias("instruction"), F.col("p_name").alias("description"), F.col("p_partkey").alias("position"))
    return policy.decide(rows)


@register("""SELECT 't' || c_custkey AS "table", CASE c_custkey % 4 WHEN 0 THEN 'erp__T' ELSE 't' END || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0""")
def table_resolution(spark, sf_dir):
    """A logical table for each customer; physical ones: of that ending alone, two of it, one of the whole name beside one of it, none."""
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    endings = F.when(key % 4 == 0, F.array(F.lit("erp__T"))).when(key % 4 == 1, F.array(F.lit("a__t"), F.lit("b__t"))).when(key % 4 == 2, F.array(F.lit("x__t"), F.lit("t")))
    physical = customer.select("c_custkey", F.explode(endings).alias("ending")).select(F.concat("ending", "c_custkey").alias("name"))
    return policy.resolve(customer.select(F.concat(F.lit("t"), "c_custkey").alias("table")), physical)


@register("SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def kpi_canonical(spark, sf_dir):
    """A stored formula over logical names, checked and run in a session that holds the allowed tables only."""
    formula = """WITH f AS (SELECT * FROM ventas WHERE o_orderstatus = 'F') SELECT o_orderpriority AS "priority", round(sum(o_totalprice), 2) AS total FROM f GROUP BY 1"""
    return guard.canonical(spark, {"ventas": table(spark, sf_dir, "orders")}, formula)


@register("""
SELECT c_mktsegment AS segment, count(*) AS buyers FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0) GROUP BY 1
""")
def governed_subqueries(spark, sf_dir):
    """A checked formula with IN and EXISTS over three allowed tables."""
    views = {"clientes": table(spark, sf_dir, "customer"), "ventas": table(spark, sf_dir, "orders"), "paises": table(spark, sf_dir, "nation")}
    formula = """SELECT c_mktsegment AS segment, count(*) AS buyers FROM clientes c
        WHERE EXISTS (SELECT 1 FROM ventas o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND c_nationkey IN (SELECT n_nationkey FROM paises WHERE n_regionkey <> 0) GROUP BY 1"""
    return guard.canonical(spark, views, formula)


@register("""
SELECT p_partkey AS position, 'k' || p_partkey AS kpi, CAST(3 * (CAST(list_contains(w, 'widget') AS INT) + CAST(list_contains(w, 'ring') AS INT)) + CAST(list_contains(t, 'economy') AS INT) AS INTEGER) AS score
FROM (SELECT *, string_split(lower(p_name), ' ') AS w, string_split(lower(p_type), ' ') AS t FROM part) ORDER BY score DESC, position LIMIT 16
""")
def kpi_relevance_topk(spark, sf_dir):
    """Parts as KPIs: the sixteen that share most words with a question."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.concat(F.lit("k"), "p_partkey").alias("kpi"), F.col("p_name").alias("name"), F.lit("").alias("examples"), F.col("p_type").alias("description"), F.lit("").alias("dimensions"), F.lit("").alias("assumptions"))
    return kpis.relevant(rows, "¿Cuánto Widget o rïng hubo, en ECONOMY?").select("position", "kpi", "score")


@register("SELECT c_mktsegment, c_name FROM customer")
def project_requested(spark, sf_dir):
    """Columns named in the question, in its order."""
    return kpis.project(table(spark, sf_dir, "customer"), "Clientes, solo c mktsegment y c_name nada más, sin c_custkey".replace("c_name", "c name").replace("c_custkey", "c custkey"))


@register("""
SELECT c_custkey, c_name, CAST(used AS BIGINT) AS used FROM (SELECT c_custkey, c_name, sum(length(c_name) + 1) OVER (ORDER BY c_custkey) AS used FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 500)) WHERE used <= 4000
""")
def prompt_budget(spark, sf_dir):
    """As many of a capped result's rows as fit in 4000 characters."""
    capped = table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(500)
    return trends.within_budget(capped, "c_custkey", "c_name", 4000)


@register("""SELECT o_orderkey, o_orderstatus || '; ' || o_orderpriority AS "table" FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority[1] IN ('1', '2', '5')""")
def catalog_rows_of_loaded(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    loaded = [r[0] for r in orders.select("o_orderpriority").distinct().collect() if r[0][0] in "125"]  # five priorities
    rows = orders.select("o_orderkey", F.concat_ws("; ", "o_orderstatus", "o_orderpriority").alias("table"))
    return quality.visible_rows(rows, ["F", "O", *loaded], every=True)


@register("SELECT list_aggregate(list_sort(list_distinct(list(c_mktsegment))), 'string_agg', ',') AS segments, TRUE AS mixed FROM customer")
def mixed_values(spark, sf_dir):
    out = quality.mixed(table(spark, sf_dir, "customer"), "c_mktsegment")
    return out.select(F.concat_ws(",", "values").alias("segments"), "mixed")


#: Catalog rows of the query below: table, column, instruction, description.
SAID = (
    ("orders", "*", "si", "Ventas"), ("orders", "o_orderkey", "", "Número"), ("orders", "o_custkey", "confidencial", "Quién"), ("customer", "*", "si", "Clientes"),
    (" nation", "n_name", "si: pública", "País"), ("nation", "n_regionkey", "puede usar", ""), ("lineitem", "*", "uso interno", "Líneas"), ("supplier", "", "si", "Sin tabla"),
    ("región", "*", "si", "Otro nombre"), ("region", "", "x", "Regiones"), ("geo_region", "*", "sí", "Regiones del mapa"), ("events", "ts", "si", ""), ("events", "props", "privado", ""),
)


@register("""
WITH o AS (SELECT '{"o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":"' || o_totalprice || '","o_orderdate":"' || o_orderdate || '","o_orderpriority":"' || o_orderpriority || '"}' AS s
           FROM orders ORDER BY o_orderkey LIMIT 2),
n AS (SELECT '{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"}' AS s FROM nation ORDER BY n_nationkey LIMIT 2),
r AS (SELECT r_regionkey AS k, '{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}' AS s FROM region)
SELECT 'orders' AS "table", 'erp__orders' AS name, 'Tabla erp__orders — Ventas' || chr(10) || '    - o_orderkey (bigint): Número' || chr(10) || '    - o_custkey (bigint): Quién' || chr(10) || '    - o_orderstatus (string)' || chr(10)
       || '    - o_totalprice (double)' || chr(10) || '    - o_orderdate (timestamp_ntz)' || chr(10) || '    - o_orderpriority (string)' || chr(10) || '    - _run_id (string): lineage' AS text, string_agg(s, chr(10) ORDER BY s) AS samples FROM o
UNION ALL SELECT 'nation', 'nation', 'Tabla nation' || chr(10) || '    - n_nationkey (int)' || chr(10) || '    - n_name (string): País' || chr(10) || '    - n_regionkey (int)', string_agg(s, chr(10) ORDER BY s) FROM n
UNION ALL SELECT 'region', 'region', 'Tabla region — Regiones' || chr(10) || '    - r_regionkey (int)' || chr(10) || '    - r_name (string)', string_agg(s, chr(10) ORDER BY s) FROM r WHERE k < 2
UNION ALL SELECT 'geo_region', 'geo_region', 'Tabla geo_region — Regiones del mapa' || chr(10) || '    - r_regionkey (int)' || chr(10) || '    - r_name (string)', string_agg(s, chr(10) ORDER BY s) FROM r WHERE k > 2
""")
def described_tables(spark, sf_dir):
    """Given tables under names of a warehouse: what the catalog allows of them, their columns and two rows of each."""
    own = spark.newSession()  # names of its own
    orders = table(own, sf_dir, "orders").orderBy("o_orderkey").withColumn("_run_id", F.lit("r1"))
    views = {"erp__orders": orders, "nation": table(own, sf_dir, "nation").orderBy("n_nationkey"), "geo__nation": table(own, sf_dir, "nation")}
    views |= {f"{source}__customer": table(own, sf_dir, "customer") for source in ("erp", "crm")}
    views |= {"erp__lineitem": table(own, sf_dir, "lineitem"), "web__events": table(own, sf_dir, "events"), "_supplier": table(own, sf_dir, "supplier")}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    region = table(own, sf_dir, "region").orderBy("r_regionkey")
    for part in ("r_regionkey < 3", "r_regionkey > 2"):  # two sources give one name
        tables.register(own, region.filter(part), "Región", "geo")
    rows = own.createDataFrame([(*row, place) for place, row in enumerate(SAID)], "table string, column string, instruction string, description string, position int")
    return tables.describe(own, rows).select("table", "name", "text", F.array_join("samples", "\n").alias("samples"))


QUERIES, ORACLES = register.queries, register.oracles
