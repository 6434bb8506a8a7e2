"""Scalar functions, checked by round trips: text is made from typed columns, read back, and held against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauceda.functions import dates, hashing, naming, numbers, text
from cauceda.queries.base import Register, table

register = Register()
SPANISH = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Set", "Oct", "Nov", "Dic")


def spanish(ts):
    """``Ago 9, 2026 , 16:22`` of a timestamp."""
    name = F.element_at(F.array(*map(F.lit, SPANISH)), F.month(ts))
    return F.concat(name, F.lit(" "), F.dayofmonth(ts), F.lit(", "), F.year(ts), F.lit(" , "), F.date_format(ts, "HH:mm"))


@register("SELECT doc_id, regexp_replace(trim(upper(replace(strip_accents(text), 'ß', 'ss'))), '\\s+', ' ', 'g') AS folded FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@register("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem")
def parse_number_locale(spark, sf_dir):
    """1.234,50 read back."""
    shown = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.parse_number(shown).alias("price"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'CRC' WHEN o_orderkey % 3 = 1 THEN 'USD' ELSE 'EUR' END AS currency, round(o_totalprice, 2) AS amount FROM orders")
def parse_amount_currency(spark, sf_dir):
    """Code before, sign before or code after the number."""
    shown, kind = F.format_number("o_totalprice", 2), F.col("o_orderkey") % 3
    made = F.when(kind == 0, F.concat(F.lit("CRC "), shown)).when(kind == 1, F.concat(F.lit("$"), shown)).otherwise(F.concat(shown, F.lit(" EUR")))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.parse_amount(made).alias("a")).select("o_orderkey", "a.currency", "a.amount")


@register("SELECT l_orderkey, l_linenumber, 9007199254740993 + l_orderkey AS id FROM lineitem")
def parse_int_exact(spark, sf_dir):
    """Numbers past the exact range of a double, with leading zeros."""
    shown = F.concat(F.lit("000"), (F.lit(9007199254740993) + F.col("l_orderkey")).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.parse_integer(shown).alias("id"))


@register("SELECT event_id, date_trunc('minute', ts) AS at FROM events")
def parse_date_es(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.parse_spanish_date(spanish(F.col("ts"))).alias("at"))


@register("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_date_formats(spark, sf_dir):
    """Four formats in one column."""
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    made = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.date_format(day, "yyyy-MM-dd")).when(kind == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "d-M-yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(dates.parse_date(made)).alias("day"))


@register("""
SELECT c_custkey, regexp_replace(regexp_replace(translate(format('{:,.2f}', c_acctbal), ',.', '.,'), '(,[0-9]*?)0+$', '\\1'), ',$', '') AS shown FROM customer
""")
def format_number_es(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.format_number_es(F.col("c_acctbal")).alias("shown"))


@register("SELECT c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS last4 FROM customer")
def last4_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.last_digits(F.col("c_name")).alias("last4"))


@register("SELECT event_id, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day FROM events")
def business_date(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.business_date(F.col("ts"), "America/Costa_Rica").alias("day"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'),
       '<[^>]+>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages
""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@register("SELECT o_orderkey, sha256(concat_ws(chr(0), 'orders', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))) AS id FROM orders")
def identity_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.identity_hash(F.lit("orders"), F.col("o_orderkey"), F.col("o_custkey")).alias("id"))


@register("SELECT l_returnflag AS return_flag, l_linestatus AS return_flag_2, count(*) AS column_3 FROM lineitem GROUP BY 1, 2")
def header_normalise(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return raw.toDF(*naming.headers(["Return Flag", "return-flag", " "]))


@register("SELECT c_custkey, c_name, c_acctbal, round(c_acctbal / nullif(c_nationkey, 0), 6) AS ratio FROM customer")
def safe_division(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", numbers.safe_ratio(F.col("c_acctbal"), F.col("c_nationkey"), 6).alias("ratio"))


@register("""
SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type) > 20 THEN rtrim(substr(p_name || ' ' || p_type, 1, 19)) || '…' ELSE p_name || ' ' || p_type END AS shown FROM part
""")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.clip(F.concat_ws(" ", "p_name", "p_type"), 20).alias("shown"))


QUERIES, ORACLES = register.queries, register.oracles
