import datetime as dt

import pytest
from pyspark.sql import functions as F

from cauceda.functions import dates, hashing, naming, numbers, text


def column(spark, values, of, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.select("i", of(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize(("given", "want"), [
    ("1,234,567", 1234567.0), ("3,320", 3320.0), ("120.000", 120000.0), ("3,32", 3.32), ("₡1.234.567,89", 1234567.89), ("3,320.00", 3320.0), ("0.125", 125.0),
    ("-5.5", -5.5), ("", None), ("-", None), (".", None), ("abc", None), (None, None), ("1-2", None), ("1e5", 15.0), ("12d", 12.0),
])
def test_numbers(spark, given, want):
    assert column(spark, [given], numbers.parse_number) == [want]


def test_integers_do_not_pass_through_doubles(spark):
    given = ["00100001010000000123", "12.5", "13.5", "3,320", "x", None, "-7", "99999999999999999999"]
    assert column(spark, given, numbers.parse_integer) == [100001010000000123, 12, 14, 3320, None, None, -7, None]


def test_amounts(spark):
    given = ["CRC 3,320.00", "₡3.320,00", "113.13 USD", "€5", "pago", None, "CRC ---"]
    got = column(spark, given, numbers.parse_amount)
    assert [tuple(x) for x in got] == [("CRC", 3320.0), ("CRC", 3320.0), ("USD", 113.13), ("EUR", 5.0), (None, None), (None, None), (None, None)]


def test_declared_decimal_comma(spark):
    given = ["390037.5", "5.000", "1.250.000", "3,25", "1.234,5", "n/d", "", None]
    assert column(spark, given, lambda c: numbers.clean_number(c, True)) == [390037.5, 5000.0, 1250000.0, 3.25, 1234.5, None, None, None]
    assert column(spark, ["1,250,000", "3.25", "5,000"], lambda c: numbers.clean_number(c, False)) == [1250000.0, 3.25, 5000.0]


def test_spanish_dates(spark):
    given = ["Ago 9, 2026 , 16:22", "Ago 9,2026 , 00:49", "setiembre 1, 2026", "Feb 30, 2026", "Foo 1, 2026", "2026-08-09", "9/8/2026 07:05", "2026-08-09T10:00", None, ""]
    d = dt.datetime
    assert column(spark, given, dates.parse_spanish_date) == [d(2026, 8, 9, 16, 22), d(2026, 8, 9, 0, 49), d(2026, 9, 1), None, None, d(2026, 8, 9), d(2026, 8, 9, 7, 5), None, None, None]


def test_iso_is_never_day_first(spark):
    d = dt.datetime
    assert column(spark, ["2026-01-02", "01/02/2026", "31/12/2026"], lambda c: dates.parse_declared(c, True)) == [d(2026, 1, 2), d(2026, 2, 1), d(2026, 12, 31)]
    assert column(spark, ["2026-01-02", "01/02/2026", "31/12/2026"], lambda c: dates.parse_declared(c, False)) == [d(2026, 1, 2), d(2026, 1, 2), None]


@pytest.mark.parametrize(("counts", "want"), [((1, 0, 5), "day_first"), ((0, 2, 5), "month_first"), ((1, 1, 0), "contradictory"), ((0, 0, 5), "ambiguous"), ((0, 0, 0), "")])
def test_verdicts(counts, want):
    assert dates.verdict(*counts) == want


def test_folding(spark):
    assert column(spark, ["AUTOMERCADO  Escazú", " automercado escazu ", None, "ﬁn ñ"], text.fold) == ["AUTOMERCADO ESCAZU", "AUTOMERCADO ESCAZU", "", "FIN N"]
    assert column(spark, ["a; b,,a ;", None], text.items) == [["a", "b"], []]
    assert column(spark, ["+506 8888-1234", None], text.last_digits) == ["1234", ""]
    assert column(spark, ["Sí", "no", "", None], text.is_yes) == [True, False, False, False]
    assert column(spark, ["", None], lambda c: text.is_yes(c, blank=True)) == [True, True]


def test_like_has_no_escape(spark):
    assert column(spark, [r"a\%b", "axb"], lambda c: text.like_folded(c, F.lit(r"A\%"))) == [True, False]


def test_html_and_masks(spark):
    assert column(spark, ["<p>a&amp;b</p><script>x<y</script> c"], text.html_to_text) == ["a&b c"]
    assert column(spark, ["db://user:pa:ss@host/x"], text.mask_secrets) == ["db://***:***@host/x"]


def test_shown_numbers(spark):
    assert column(spark, [1234567.891, 5.0, -3.5, None], numbers.format_number_es, "double") == ["1.234.567,89", "5", "-3,5", None]


def test_names():
    assert naming.headers(["Fecha", "fecha", "", None, "fecha_2", "9 lives"]) == ["fecha", "fecha_3", "column_3", "column_4", "fecha_2", "_9_lives"]
    assert naming.raw_table("Mi Fuente", "Ventas 2026") == "mi_fuente__ventas_2026"
    assert naming.direct_link("https://x/y?e=1") == "https://x/y?e=1&download=1" == naming.direct_link(naming.direct_link("https://x/y?e=1"))


def test_hashes_tell_null_from_empty_and_ignore_partitions(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    assert df.select(hashing.content_hash("x", "y")).distinct().count() == 2
    assert df.select(hashing.identity_hash(F.col("x"), F.col("y"))).distinct().count() == 1
    assert df.select(hashing.breakdown({"edad": F.lit("25-34"), "b": F.lit(None)})).first()[0] == "edad=25-34"
