import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cauceda.plans import chart


def shown(c):
    return [(r.label, list(r["values"])) for r in c.points.orderBy("position").collect()]


def test_series_of_another_scale_part(spark):
    rows = [(f"shop {i}", 1000 * i, i, 90 * i, -5) for i in range(1, 4)]
    c = chart.plan(spark.createDataFrame(rows, "shop string, amount long, units int, cost int, more int"))
    assert (c.axis, c.series, c.apart, c.temporal, c.rows, c.cut) == ("shop", ("amount", "cost"), ("units",), False, 3, False)
    assert shown(c) == [("shop 3", [3000.0, 270.0]), ("shop 2", [2000.0, 180.0]), ("shop 1", [1000.0, 90.0])]


def test_the_bound_of_the_scale_belongs_to_it(spark):
    result = spark.createDataFrame([("a", 100, 5, 4), ("b", 1, 1, 1)], "k string, x int, at int, below int")
    c = chart.plan(result)
    assert c.series == ("x", "at") and c.apart == ("below",)


def test_largest_categories_and_ties(spark):
    result = spark.range(100).select(F.format_string("k%02d", "id").alias("k"), (F.col("id") % 2 * -10).alias("v"))
    c = chart.plan(result)
    assert c.cut and c.rows == 100 and shown(c) == [(f"k{i:02}", [-10.0]) for i in range(1, 51, 2)]
    assert {r.kind for r in c.points.collect()} == {"columns"}


def test_last_periods(spark):
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int"))
    for axis, first in ((day, "2024-01-11"), (F.date_format(day, "yyyy-MM-dd"), "2024-01-11"), (day.cast("timestamp_ntz"), "2024-01-11 00:00")):
        c = chart.plan(spark.range(100).select(axis.alias("k"), "id"))
        got = shown(c)
        assert c.temporal and c.cut and len(got) == 90 and got[0] == (first, [10.0]) and got[-1][1] == [99.0]
        assert {r.kind for r in c.points.collect()} == {"line"}


def test_order_of_periods_that_do_not_sort_as_text(spark):
    months = [("enero", 1, 7), ("febrero", 2, 8), ("abril", 4, 9)]
    c = chart.plan(spark.createDataFrame(months, "mes string, n int, total int"), order=("n",))
    assert c.temporal and [label for label, _ in shown(c)] == ["enero", "febrero", "abril"]


def test_absent_cells(spark):
    rows = [(None, float("nan"), None), ("", None, None), ("x" * 5000, float("inf"), None), ("b", 2.0, None)]
    c = chart.plan(spark.createDataFrame(rows, "k string, v double, none int"))
    assert c.series == ("v",)
    assert shown(c) == [("b", [2.0]), ("(vacío)", [0.0]), ("(vacío)", [0.0]), ("x" * 22, [0.0])]
    assert {r.kind for r in c.points.collect()} == {"bars"}


def test_names_that_clash_and_numbers_alone(spark):
    rows = [(1, Decimal("1.50"), 3), (2, Decimal("2.50"), 4)]
    c = chart.plan(spark.createDataFrame(rows, "a int, b decimal(5,2), c int").toDF("values", "label", "label"))
    assert c.axis == "values" and c.series == ("label", "label") and shown(c) == [("2", [2.5, 4.0]), ("1", [1.5, 3.0])]


def test_what_has_no_chart(spark):
    for rows, schema in (([], "k string, v int"), ([("a", 1)], "k string, v int"), ([("a",), ("b",)], "k string"), ([("a", True), ("b", False)], "k string, v boolean"), ([("a", None), ("b", None)], "k string, v int")):
        assert chart.plan(spark.createDataFrame(rows, schema)) is None


def test_a_hot_result_is_cut_without_a_full_sort(spark):
    c = chart.plan(spark.range(1000).select(F.lit("k").alias("k"), "id"))
    assert "TakeOrderedAndProject" in c.points._jdf.queryExecution().executedPlan().toString()
    assert shown(c)[0] == ("k", [999.0])
