import json
import uuid

import pytest

from cauceda.plans import tables

ROW = "table string, column string, instruction string, description string, position int"


@pytest.fixture
def schemas(spark):
    made = [f"s_{uuid.uuid4().hex[:8]}" for _ in range(2)]
    for s in made:
        spark.sql(f"CREATE SCHEMA {s}")
    yield made
    for s in made:
        spark.sql(f"DROP SCHEMA {s} CASCADE")


def save(spark, schema, name, rows, columns):
    spark.createDataFrame(rows, columns).coalesce(1).write.saveAsTable(f"`{schema}`.`{name}`")


def described(spark, catalog, schemas):
    rows = tables.describe(spark, spark.createDataFrame(catalog, ROW), schemas, views=False).collect()
    return {r.table: r for r in rows}


def test_columns_words_and_samples(spark, schemas):
    first, second = schemas
    save(spark, first, "erp__sales", [(1, "a", None, "r"), (2, "b" * 900, 2.0, "r"), (3, "c", 3.0, "r")], "id int, who string, paid double, _run_id string")
    save(spark, second, "erp__sales", [(9,)], "elsewhere int")
    save(spark, second, "crm__sales", [(9,)], "id int")
    save(spark, second, "pos__stock", [], "id int, n int")
    catalog = [("sales", "*", "si", "Ventas", 1), ("sales", "id", "", "Número", 3), ("sales", "id", "", "later", 4), ("stock", "id", "si", "", 5)]
    assert set(described(spark, catalog, schemas)) == {"stock"}  # sales: two tables end so
    got = described(spark, catalog, [first])["sales"]
    assert (got.name, got.schema, got.description, got.failed) == ("erp__sales", first, "Ventas", None)
    assert got.text == "Tabla erp__sales — Ventas\n    - id (int): Número\n    - who (string)\n    - paid (double)\n    - _run_id (string): lineage"
    samples = [json.loads(s) for s in got.samples]
    assert samples == [{"id": "1", "who": "a"}, {"id": "2", "who": "b" * tables.CELL + "…", "paid": "2.0"}]
    assert described(spark, catalog, schemas)["stock"].samples == []


def test_forbidden_columns_show_no_cells(spark, schemas):
    save(spark, schemas[0], "a__people", [("x", "y")], "name string, `odd.name` string")
    catalog = [("people", "", "si", None, 1), ("people", "name", "confidencial", "Nombre", 2)]
    got = described(spark, catalog, schemas)["people"]
    assert [json.loads(s) for s in got.samples] == [{"odd.name": "y"}]
    assert got.text.splitlines() == ["Tabla a__people", "    - name (string): Nombre", "    - odd.name (string)"]


def test_hidden_tables_and_those_not_allowed(spark, schemas):
    for name in ("_runs", "a__x__rechazos", "a__no", "a__partly"):
        save(spark, schemas[0], name, [(1,)], "id int")
    catalog = [("_runs", "*", "si", "", 1), ("x__rechazos", "*", "si", "", 2), ("no", "*", "interno", "", 3), ("partly", "id", "si", "", 4), ("partly", "b", "", "", 5), ("gone", "*", "si", "", 6), ("", "*", "si", "", 7), (None, None, None, None, None)]
    assert described(spark, catalog, schemas) == {} == described(spark, [], schemas)


def test_a_table_that_cannot_be_read_leaves_the_others(spark, schemas):
    save(spark, schemas[0], "a__good", [(1,)], "id int")
    own = spark.newSession()
    own.createDataFrame([(1,)], "id int").selectExpr("id", "raise_error('lost') AS v").createOrReplaceTempView("a__bad")
    catalog = own.createDataFrame([("good", "*", "si", "", 1), ("bad", "*", "si", "", 2)], ROW)
    got = {r.table: r for r in tables.describe(own, catalog, schemas).collect()}
    assert got["good"].samples == ['{"id":"1"}'] and got["good"].failed is None
    assert got["bad"].samples is None and got["bad"].failed and "- v (void)" in got["bad"].text


def test_names_that_clash(spark):
    own = spark.newSession()
    names = [tables.register(own, own.range(i), "Ventas 1", "erp") for i in range(4)]
    assert names == ["ventas_1", "erp_ventas_1", "erp_ventas_1_2", "erp_ventas_1_3"]
    assert [own.table(n).count() for n in names] == [0, 1, 2, 3]
    assert tables.register(own, own.range(1), "¿?", "erp") == "table"
    assert {r.name for r in tables.scan(own).collect()} == {*names, "table"}


def test_views_count_before_tables(spark, schemas):
    save(spark, schemas[1], "a__x", [(1,)], "id int")
    own = spark.newSession()
    assert [tuple(r) for r in tables.scan(own, schemas).collect()] == [("a__x", schemas[1])]
    own.range(1).createOrReplaceTempView("a__x")
    assert [tuple(r) for r in tables.scan(own, schemas).collect()] == [("a__x", None)]
