"""Source runs, the semantic build, swaps and the small forms of answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cauceda.operators import build
from cauceda.plans import guard, memory
from cauceda.sources import sinks, sync, workbook


@pytest.fixture(scope="module")
def house(spark):
    return sinks.Warehouse(spark, "Trabajos")


def rows_of(spark, name):
    return spark.table(name).count()


def test_swaps_keep_the_table(spark, house):
    name = f"{house.raw}.kept"
    house.swap(spark.range(3).toDF("a"), name)
    old = spark.table(name)
    house.comment(name, {"a": "a note"})
    house.swap(old.filter("a > 0"), name)  # the same columns: a change of location
    assert rows_of(spark, name) == 2 and spark.catalog.listColumns(name)[0].description == "a note"
    house.swap(spark.range(4).select(F.col("id").alias("a"), F.lit("x").alias("b")), name)  # other columns: a change of name
    assert spark.table(name).columns == ["a", "b"] and rows_of(spark, name) == 4
    house.swap(spark.range(6).select("id", (F.col("id") % 2).alias("p")), name, partition=("p",))
    house.swap(spark.table(name).filter("p = 1"), name, partition=("p",))
    assert rows_of(spark, name) == 3
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__was")  # a crash between the two renames
    assert house.exists(name) and rows_of(spark, name) == 3
    house.swap(spark.range(1), f"{house.raw}.kept__rechazos")
    house.swap(spark.range(1), f"{house.raw}._own")
    assert house.tables(house.raw) == ["kept"]


def test_source_runs(spark, house):
    shape = "id string, v string"
    given = {"ventas": spark.createDataFrame([(str(i), "x") for i in range(10)], shape), "log": spark.createDataFrame([("1", "a")], shape)}
    source = sync.Source("erp", lambda s: (given, []), growing={"log": sync.Growing(["id"], ["v"])})
    name = f"{house.raw}.erp__ventas"
    dry = sync.run_source(house, source, dry=True)
    assert (dry.status, dry.rows) == ("ok", 11) and not house.exists(name)
    assert sync.run_source(house, source).status == "ok" and rows_of(spark, name) == 10
    given["ventas"], given["log"] = given["ventas"].limit(0), spark.createDataFrame([("2", "b")], shape)
    for _ in range(3):  # the guard holds
        run = sync.run_source(house, source)
        assert run.status == "ok_with_block" and "not written" in run.alerts[0] and rows_of(spark, name) == 10
    assert rows_of(spark, f"{house.raw}.erp__log") == 2
    given["ventas"] = spark.createDataFrame([("1", "x", 1)], shape + ", w int")
    run = sync.run_source(house, source)
    assert run.status == "ok_with_alerts" and len(run.alerts) == 2 and rows_of(spark, name) == 1
    source.fresh_minutes = 60
    assert sync.run_source(house, source).status == "skipped" and sync.run_source(house, source, force=True).status == "ok"

    def broken(s):
        raise OSError("no route")

    runs = sync.run_all(house, [sync.Source("bad", broken), sync.Source("good", lambda s: ({"t": spark.range(1)}, ["cut"])), sync.Source("good", broken)])
    assert [r.status for r in runs] == ["error", "ok_with_alerts", "error"] and "no route" in runs[0].error
    assert not [t for t in spark.catalog.listTables(house.raw) if t.name.startswith("erp__") and t.name not in ("erp__ventas", "erp__log")]


def tab(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


@pytest.fixture(scope="module")
def tabs(spark, house):
    body = "Comercio: {}\nMonto: CRC {}\n"
    mails = [("1", body.format("Café Uno", "1.500,50"), "Ana"), ("2", body.format("Super", "20"), "Ana"), ("3", "Monto: CRC 5\n", "Beto"), ("4", None, "Beto"), ("5", body.format("Otro", "7"), "no"), ("6", body.format("Mar", "9"), "Eva")]
    house.swap(spark.createDataFrame(mails, "correo_id string, cuerpo string, titular string"), f"{house.raw}.correos")
    house.swap(spark.createDataFrame([("comida", "L1", "si"), ("comida", "L0", "no"), ("otros", "L9", "")], "cuenta string, linea string, activo string"), f"{house.raw}.lineas")
    return {
        "modelos": tab(spark, "modelo_id tabla_origen tabla_destino extractor columna_texto filtro activo", [("m", "correos", "gastos", "", "", "titular <> 'no'", ""), ("off", "correos", "", "", "", "", "no"), ("wrong", "correos", "", "telepathy", "", "", "si"), ("gone", "missing", "", "regex", "", "", "si")]),
        "campos": tab(spark, "modelo_id columna tipo patron requerido clasifica_en clasifica_con", [("m", "comercio", "texto", "Comercio", "si", "cuenta", ""), ("m", "monto", "monto_con_moneda", "Monto|Importe", "", "", ""), ("gone", "x", "", "a", "", "", "")]),
        "clasificacion": tab(spark, "modelo_id clasifica_en columnas patron valor prioridad", [("m", "", "", "%cafe%", "comida", "5"), ("m", "otra", "", "%", "never", "1"), ("m", "cuenta", "titular", "eva", "otros", "")]),
        "joins": tab(spark, "modelo_id tabla_auxiliar columna_base columna_auxiliar transformacion columnas_salida", [("m", "lineas", "cuenta", "cuenta", "normalizado", "linea")]),
        "categorias": tab(spark, "modelo_id clasifica_en categoria", [("m", "cuenta", "comida"), ("m", "", "otros"), ("m", "otra", "z"), ("n", "", "y")]),
        "overrides": spark.createDataFrame([("m", "2", "monto", "25.5", 1), ("m", "1", "monto", "many", 2), ("m", "9", "monto", "1", 3), ("m", "2", "cuenta", "otros", 4)], "modelo_id string, clave string, columna string, valor string, position int"),
    }


def test_build(spark, house, tabs):
    dry = build.build(house, tabs, dry=True)
    assert (dry["m"].rows, dry["m"].rejects) == (3, 2) and not house.exists(f"{house.semantic}.gastos")
    mapping = spark.createDataFrame([("m", "cuenta", "SUPER", "comida"), ("n", "", "MAR", "not mine")], "model_id string, dimension string, folded string, label string")
    out = build.build(house, tabs, mapping=mapping)
    assert set(out) == {"m", "wrong", "gone"} and "unknown extractor" in out["wrong"].alerts[0] and "missing" in out["gone"].alerts[0]
    assert (out["m"].rows, out["m"].rejects, out["m"].unclassified) == (3, 2, {}) and len(out["m"].alerts) == 2 and "9" in out["m"].alerts[0]
    got = {r["row_key"]: (r["comercio"], r["monto"], r["monto_currency"], r["cuenta"], r["linea"], r["model_id"]) for r in spark.table(f"{house.semantic}.gastos").collect()}
    assert got == {"1": ("Café Uno", 1500.5, "CRC", "comida", "L1", "m"), "2": ("Super", 25.5, "CRC", "otros", "L9", "m"), "6": ("Mar", 9.0, "CRC", "otros", "L9", "m")}
    assert {r["row_key"]: r["reason"] for r in spark.table(f"{house.semantic}.gastos__rechazos").collect()} == {"3": "missing: comercio", "4": "missing: cuerpo"}
    assert house.tables(house.semantic) == ["gastos"]
    assert build.categories_of(build.read_tabs(tabs), "m", "cuenta") == ["comida", "otros"]


def test_declarations_are_checked(spark, tabs):
    read = build.read_tabs(tabs)
    row = read["modelos"][0]
    for change in ({"campos": []}, {"campos": read["campos"] + read["campos"][:1]}, {"campos": [read["campos"][0] | {"tipo": "color"}]}, {"joins": [read["joins"][0] | {"transformacion": "guess"}]}):
        with pytest.raises(ValueError):
            build.declared(row, read | change)
    plan = build.declared(row | {"extractor": "bank"}, read, {"bank": ("lines", [build.Field("comercio"), build.Field("fecha", "date_es", ("Fecha",))])})
    assert [f.column for f in plan.model.fields] == ["comercio", "fecha", "monto"] and plan.model.context == ("titular",)


def test_metadata_of_built_tables(spark, house):
    house.swap(spark.range(1).toDF("monto"), f"{house.semantic}.hechos")
    catalog = spark.createDataFrame([("hechos", "monto", "what it costs"), ("other", "a", "b")], "table string, column string, description string")
    kpis = spark.createDataFrame([("hechos;other", "k1"), ("other", "k2")], "table string, kpi string")
    for _ in range(2):
        build.publish_metadata(house, ["hechos"], catalog, kpis)
    assert [r["kpi"] for r in spark.table(f"{house.meta}.kpis").collect()] == ["k1"] and rows_of(spark, f"{house.meta}.catalog") == 1
    assert spark.catalog.listColumns(f"{house.semantic}.hechos")[0].description == "what it costs"
    assert build.proposal_tsv({"modelo_id": "m", "tabla_origen": "t"}, [{"columna": "c", "tipo": "texto"}]).split("\n")[-1].startswith("m\tc\ttexto")


def test_a_query_is_asked_for_twice(spark):
    views, asked = {"ventas": spark.range(3).toDF("a")}, []

    def propose(question, reason):
        asked.append(reason)
        return "SELECT max(a) AS m FROM ventas" if reason else "DROP TABLE ventas"

    assert guard.answer(spark, views, "máximo", propose) == ("SELECT max(a) AS m FROM ventas", ["m"], [(2,)])
    assert asked[0] == "" and asked[1]
    with pytest.raises(PermissionError):
        guard.answer(spark, views, "x", lambda q, r: "SELECT nothing FROM ventas")
    assert guard.last_valid(spark, ["SELECT a FROM ventas", "", "SELECT a FROM hidden"], {"ventas"}) == "SELECT a FROM ventas"
    assert guard.last_valid(spark, ["SELECT 1"], {"ventas"}) is None


def test_names_that_tell_about_the_engine_are_refused(spark):
    """Without a column of the name the analyser would take them for functions."""
    for name in ("current_user", "USER", "session_user", "current_schema", "current_database", "version"):
        for sql in (f"SELECT {name} FROM ventas", f"SELECT a FROM ventas WHERE {name} = 'x'", f"SELECT a FROM ventas ORDER BY {name}", f"SELECT a FROM ventas WHERE a IN (SELECT {name} FROM ventas)"):
            assert not guard.check(spark, sql, {"ventas"}).ok, sql
    assert guard.check(spark, 'SELECT v.user FROM ventas v WHERE a IN (SELECT a FROM ventas) AND EXISTS (SELECT 1 FROM ventas w WHERE w.a = v.a)', {"ventas"}).ok
    before = spark.conf.get(guard.QUOTED)
    assert guard.check(spark, 'SELECT "a" FROM ventas', {"ventas"}).ok and spark.conf.get(guard.QUOTED) == before


def test_memory(spark, house):
    kept = memory.Memory(house)
    assert kept.recall("t", "1") == []
    for i in range(3):
        kept.remember("t", "1", f"q{i}", f"a{i}", "SELECT 1")
    kept.remember("t", "2", "other", "answer")
    kept.remember("t", "1", "no answer", "")
    assert [r["content"] for r in kept.recall("t", "1", most=4)] == ["q1", "a1", "q2", "a2"] and kept.recall("t", "1", hours=0) == []
    kept.forget("t", "1")
    kept.purge()
    assert kept.recall("t", "1") == [] and [r["role"] for r in kept.recall("t", "2")] == ["user", "assistant"]


def test_a_written_workbook_is_read_again(spark, tmp_path):
    rows = [("a <&> ñ", 1.5, dt.date(2026, 8, 9), None), ("x\x01", 7, dt.datetime(2026, 8, 9, 12), "=1+1")]
    (tmp_path / "out.xlsx").write_bytes(sinks.xlsx_bytes(["Qué", "Monto", "Día", "Nota"], rows * 3, most=2))
    tables, alerts = workbook.sheets(spark, str(tmp_path / "*.xlsx"))
    got = sorted(tuple(r) for r in tables["datos"].collect())
    assert not alerts and tables["datos"].columns == ["que", "monto", "dia", "nota"]
    assert got == [("a <&> ñ", "1.5", "46243.0", ""), ("x", "7", "46243.5", "=1+1")]
    assert [sinks.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and sinks.xlsx_bytes([], [])
