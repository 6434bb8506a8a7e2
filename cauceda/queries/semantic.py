"""Extraction, lookups, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauceda.functions import text
from cauceda.operators import classify, extract, lookup, propose
from cauceda.operators.extract import Field, Model
from cauceda.queries.base import Register, table
from cauceda.queries.scalars import spanish

register = Register()

FIELDS = [
    Field("shop", "text", ("Comercio",), required=True),
    Field("paid_at", "date_es", ("Fecha",)),
    Field("card", "label", ("MASTER", "VISA", "AMEX")),
    Field("reference", "text", ("Referencia",)),
    Field("paid", "amount", ("Monto", "Importe"), required=True),
]


def notices(spark, sf_dir, joiner: str):
    """Orders written as notices: labelled lines, some without the shop, amounts under two labels."""
    orders = table(spark, sf_dir, "orders")
    card = F.element_at(F.array(*map(F.lit, ("MASTER", "VISA", "AMEX"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    label = F.when(F.col("o_orderkey") % 2 == 0, "Monto").otherwise("Importe")
    parts = [
        F.lit("Notificación de compra"),
        F.when(F.col("o_orderkey") % 10 != 7, F.concat(F.lit("Comercio: Tienda "), F.col("o_custkey").cast("string"))),
        F.concat(F.lit("Fecha: "), spanish(F.col("o_orderdate"))),
        F.concat(card, F.lit(": ****"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")),
        F.lit("Referencia:"),
        F.concat(label, F.lit(": CRC "), F.format_number("o_totalprice", 2)),
    ]
    return orders.select(F.col("o_orderkey").cast("string").alias("id"), F.concat_ws(joiner, *parts).alias("body"))


EXPECTED = """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'Tienda ' || o_custkey AS shop, date_trunc('minute', o_orderdate) AS paid_at,
       '****' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS card, CASE o_orderkey % 3 WHEN 0 THEN 'MASTER' WHEN 1 THEN 'VISA' ELSE 'AMEX' END AS card_label,
       '' AS reference, round(o_totalprice, 2) AS paid, 'CRC' AS paid_currency FROM orders WHERE o_orderkey % 10 <> 7
"""


@register(EXPECTED)
def extract_label_value(spark, sf_dir):
    return extract.accepted(extract.extract(notices(spark, sf_dir, "\n"), Model(FIELDS, "lines"), "body"))


@register(EXPECTED)
def extract_label_flat(spark, sf_dir):
    """The same notices with their line breaks lost."""
    return extract.accepted(extract.extract(notices(spark, sf_dir, " "), Model(FIELDS, "flat"), "body"))


@register("SELECT CAST(o_orderkey AS VARCHAR) AS row_key, 'missing: shop' AS reason FROM orders WHERE o_orderkey % 10 = 7")
def rejects(spark, sf_dir):
    return extract.rejected(extract.extract(notices(spark, sf_dir, "\n"), Model(FIELDS, "lines"), "body")).select("row_key", "reason")


@register("SELECT CAST(p_partkey AS VARCHAR) AS row_key, regexp_extract(p_brand, '#([0-9]+)', 1) AS brand, CAST(p_size AS BIGINT) AS size FROM part WHERE p_brand LIKE '%#%'")
def extract_regex(spark, sf_dir):
    model = Model([Field("brand", pattern=r"#(?P<n>[0-9]+)", required=True), Field("size", "integer", pattern=r"^size=([0-9]+)$")], "pattern")
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws("\n", "p_brand", F.concat(F.lit("SIZE="), F.col("p_size").cast("string"))).alias("body"))
    return extract.accepted(extract.extract(raw, model, "body"))


@register("SELECT CAST(event_id AS VARCHAR) AS row_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def extract_json(spark, sf_dir):
    body = F.to_json(F.struct(F.from_json("props", "k bigint").alias("props"), F.array("event_type").alias("kinds")))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), body.alias("body"))
    model = Model([Field("k", "integer", pattern="props.k", required=True), Field("kind", pattern="kinds.0")], "path")
    return extract.accepted(extract.extract(raw, model, "body"))


@register("""
WITH n AS (SELECT count(*) AS texts, count(*) FILTER (WHERE o_orderkey % 10 <> 7) AS named FROM orders)
SELECT "column", type, labels, required, CASE "column" WHEN 'comercio' THEN named ELSE texts END AS support, named AS accepted, texts - named AS rejected
FROM n, (VALUES ('comercio', 'text', 'Comercio', TRUE), ('fecha', 'date_es', 'Fecha', TRUE), ('amex', 'label', 'AMEX|MASTER|VISA', TRUE), ('importe', 'amount', 'Importe|Monto', TRUE)) f("column", type, labels, required)
""")
def proposed_fields(spark, sf_dir):
    """The fields that the notices themselves propose, with what a trial of them on all notices accepts."""
    out = propose.propose(notices(spark, sf_dir, "\n"), "body")
    rows = [(f.column, f.type, "|".join(f.labels), f.required, out.support[f.column], out.accepted, out.rejected) for f in out.fields]
    return spark.createDataFrame(rows, "column string, type string, labels string, required boolean, support bigint, accepted bigint, rejected bigint")


@register("""
SELECT c_custkey, n.first_nation FROM customer JOIN nation a ON c_nationkey = a.n_nationkey
LEFT JOIN (SELECT n_regionkey, min_by(n_name, n_nationkey) AS first_nation FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY 1) n ON a.n_regionkey = n.n_regionkey
""")
def lookup_first_match(spark, sf_dir):
    """The first active nation of each customer's region; inactive ones are skipped."""
    nation = table(spark, sf_dir, "nation")
    base = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    aux = nation.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("first_nation"), F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") % 7 == 0, "no").otherwise("").alias("active"))
    how = lookup.Lookup("nations", "n_regionkey", "region", ["first_nation"], "position", active="active")
    return lookup.lookup(base, aux, how, "c_custkey").select("c_custkey", "first_nation")


@register("""
SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN NULL ELSE CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1993-12-31' THEN 'old' WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 'mid'
       WHEN CAST(o_orderdate AS DATE) >= DATE '1996-06-30' THEN 'new' END END AS plan FROM orders
""")
def asof_validity(spark, sf_dir):
    """The plan valid on the day of an order: open ends, inclusive bounds, a gap, the first of two on a shared day."""
    plans = spark.createDataFrame([("*", "old", "", "1993-12-31", 1), ("*", "mid", "1995-01-01", "30/06/1996", 2), ("*", "new", "1996-06-30", "", 3)], "kind string, plan string, valid_from string, valid_to string, position int")
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.lit("*").alias("kind_of"))
    how = lookup.Lookup("plans", "kind_of", "kind", ["plan"], "position", base_date="o_orderdate", valid_from="valid_from", valid_to="valid_to")
    return lookup.lookup(base, plans, how, "o_orderkey").select("o_orderkey", "plan")


@register("""
WITH days AS (SELECT DISTINCT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day FROM lineitem),
terms AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' END AS flag, CAST(o_orderdate AS DATE) AS begins,
                 CASE WHEN o_orderkey % 997 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 2 AS INTEGER) END AS ends, o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
met AS (SELECT d.flag, d.day, min(o_orderkey) AS term FROM days d JOIN terms t ON d.flag = t.flag AND d.day >= t.begins AND d.day <= coalesce(t.ends, d.day) GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, term FROM lineitem LEFT JOIN met ON flag = l_returnflag AND day = CAST(l_shipdate AS DATE)
""")
def asof_hot_keys(spark, sf_dir):
    """The first of thousands of overlapping terms that holds on a line's day, where three keys have all lines."""
    orders, day = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'"), F.to_date("o_orderdate")
    terms = orders.select(
        F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").alias("kind"), F.col("o_orderkey").alias("term"), day.alias("begins"),
        F.when(F.col("o_orderkey") % 997 != 0, F.date_add(day, (F.col("o_orderkey") % 40 - 2).cast("int"))).alias("ends"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    how = lookup.Lookup("terms", "l_returnflag", "kind", ["term"], "term", base_date="l_shipdate", valid_from="begins", valid_to="ends")
    return lookup.lookup(lines, terms, how, "line").select("l_orderkey", "l_linenumber", "term")


@register("""
SELECT s_suppkey, coalesce(a.k, b.k) AS stored_id FROM supplier
LEFT JOIN (SELECT replace(c_name, 'Customer', 'Supplier') AS name, min(c_custkey) AS k FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a ON s_name = a.name
LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) b ON s_nationkey = b.c_nationkey
""")
def or_key_identity(spark, sf_dir):
    """A stored id by name, else by nation: one equi-join a key."""
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"), "c_nationkey", F.col("c_custkey").alias("stored"))
    out = lookup.by_any_key(table(spark, sf_dir, "supplier"), stored, [("s_name", "name"), ("s_nationkey", "c_nationkey")], "stored", "stored_id")
    return out.select("s_suppkey", "stored_id")


RULES = [
    classify.Rule("%#1%", "first tens", priority=5),
    classify.Rule("%BRAND#2%", "second tens"),
    classify.Rule("%#11%", "never: a lower number goes first", priority=9),
]


def classified(spark, sf_dir):
    """Parts by brand: overrides for some keys, labels for some brands, rules, and the rest."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("row_key"), F.col("p_brand").alias("brand"))
    mapping = spark.createDataFrame([("", "BRAND#12", "learned"), ("family", "BRAND#31", "learned here"), ("", "BRAND#31", "learned anywhere"), ("other", "BRAND#32", "not this")], "dimension string, folded string, label string")
    overrides = spark.createDataFrame([("1", "family", "by hand, first", 1), ("1", "family", "by hand", 2), ("2", "family", " ", 3), ("-1", "family", "orphan", 4)], "row_key string, column string, value string, position int")
    return classify.classify(parts, "brand", "family", RULES, mapping, overrides, "family"), mapping, overrides


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_brand AS brand, CASE WHEN p_partkey = 1 THEN 'by hand' WHEN p_brand = 'Brand#31' THEN 'learned here' WHEN p_brand = 'Brand#12' THEN 'learned'
       WHEN p_brand LIKE '%#1%' THEN 'first tens' WHEN p_brand LIKE 'Brand#2%' THEN 'second tens' ELSE 'unclassified' END AS family FROM part
""")
def classify_precedence(spark, sf_dir):
    return classified(spark, sf_dir)[0]


@register("SELECT upper(p_brand) AS folded, min(p_brand) AS example FROM part WHERE p_partkey <> 1 AND p_brand NOT LIKE '%#1%' AND p_brand NOT LIKE '%#2%' AND p_brand <> 'Brand#31' GROUP BY 1")
def distinct_pending(spark, sf_dir):
    df, mapping, _ = classified(spark, sf_dir)
    return classify.pending(df, "brand", "family", mapping, "family")


@register("SELECT count(*) FILTER (WHERE p_partkey <> 1 AND p_brand NOT LIKE '%#1%' AND p_brand NOT LIKE '%#2%' AND p_brand <> 'Brand#31') AS family FROM part")
def unclassified_count(spark, sf_dir):
    return classify.unclassified_counts(classified(spark, sf_dir)[0], ["family"])


@register("SELECT '-1' AS row_key, 'orphan' AS value")
def orphan_overrides(spark, sf_dir):
    df, _, overrides = classified(spark, sf_dir)
    return classify.orphans(overrides, df).select("row_key", "value")


@register("SELECT p_partkey, p_type FROM part WHERE strip_accents(upper(p_type)) LIKE '%STEEL%' OR strip_accents(upper(p_type)) LIKE 'ECONOMY%'")
def filter_ilike_normalised(spark, sf_dir):
    hits = text.like_folded(F.col("p_type"), F.lit("%stéel%")) | text.like_folded(F.col("p_type"), F.lit(" Economy%"))
    return table(spark, sf_dir, "part").filter(hits).select("p_partkey", "p_type")


@register("SELECT p_brand AS folded_example, CAST(floor((row_number() OVER (ORDER BY p_brand) - 1) / 10) AS BIGINT) AS batch FROM (SELECT DISTINCT p_brand FROM part)")
def fixed_batches(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folded_example")).distinct()
    return classify.batches(brands, "folded_example", 10)


QUERIES, ORACLES = register.queries, register.oracles
