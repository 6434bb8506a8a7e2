import datetime as dt
import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauceda.plans import guard, kpis, policy, render
from cauceda.sources import ads, calendar, files, mail, reader, sinks, workbook
from cauceda.streaming import once, sessions, state, upsert_batches, windowed_counts


@pytest.fixture(scope="module")
def house(spark):
    return sinks.Warehouse(spark, "Prueba")


def test_refresh_replaces_and_may_read_itself(spark, house):
    name = house.refresh(spark.range(3).toDF("a"), "erp", "Ventas", "r1")
    assert name == "raw_prueba.erp__ventas" and {"_run_id", "_source_id", "_ingested_at"} < set(spark.table(name).columns)
    house.swap(spark.table(name).filter("a > 0"), name)
    assert spark.table(name).count() == 2
    house.swap(spark.table(name).limit(0), name)
    assert spark.table(name).count() == 0


def test_upsert_creates_evolves_and_counts(spark, house):
    name = f"{house.raw}.mail"
    shape = "id string, body string"
    assert house.upsert(spark.createDataFrame([("1", "a"), ("2", "b")], shape), name, ["id"], ["body"], "r1") == {"new": 2}
    assert house.upsert(spark.createDataFrame([("2", "c"), ("3", "d")], shape), name, ["id"], ["body"], "r2") == {"kept": 1, "updated": 1, "new": 1}
    house.empty(f"{house.raw}.mail", T.StructType.fromDDL("id string, extra int"))
    assert "extra" in spark.table(name).columns


def test_comments_log_and_purge(spark, house):
    name = house.refresh(spark.range(1).toDF("a"), "erp", "notes", "r1")
    assert house.comment(name, {"*": "it's", "a": "b\\c", "none": "x"}) == ["none"]
    assert {c.name: c.description for c in spark.catalog.listColumns(name)}["a"] == "b\\c"
    house.log_run(run_id="r1", status="ok", finished=dt.datetime(2020, 1, 1), rows=3)
    house.log_run(run_id="r2", status="error", finished=dt.datetime.now(), rows=0)
    runs = f"{house.meta}.runs"
    house.purge(runs, "finished", 180)
    assert [r["run_id"] for r in spark.table(runs).collect()] == ["r2"]
    house.replace_rows(spark.createDataFrame([("s1", 1)], "source_id string, k int"), f"{house.meta}.kpis", "source_id", ["s1"])
    house.replace_rows(spark.createDataFrame([("s2", 2)], "source_id string, k int"), f"{house.meta}.kpis", "source_id", ["s2"])
    house.replace_rows(spark.createDataFrame([("s1", 3)], "source_id string, k int"), f"{house.meta}.kpis", "source_id", ["s1"])
    assert sorted(r["k"] for r in spark.table(f"{house.meta}.kpis").collect()) == [2, 3]


def test_csv_json_and_grids(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Nombre,Monto,nombre\n"x, y",1\n')
    df = files.csv_tables(spark, {"Mi Tabla": str(tmp_path / "a.csv")})["mi_tabla"]
    assert df.columns == ["nombre", "monto", "nombre_2"] and tuple(df.first()) == ("x, y", "1", None)
    (tmp_path / "a.json").write_text('{"data": {"rows": [{"id": 1, "o": {"p": "q", "l": [1]}}, {"id": 2}]}}')
    got = files.json_records(spark, str(tmp_path / "a.json"), "data.rows").orderBy("id").collect()
    assert [r.asDict() for r in got] == [{"id": 1, "o_l": "[1]", "o_p": "q"}, {"id": 2, "o_l": None, "o_p": None}]
    cells = spark.createDataFrame([(1, ["a note"]), (2, ["Columna", " Tipo "]), (3, ["x", "texto"]), (4, ["", "y"])], "row long, cells array<string>")
    assert [tuple(r) for r in files.grid_table(cells, "columna").collect()] == [("x", "texto")]
    with pytest.raises(ValueError):
        files.jdbc_table(spark, "jdbc:x;y", "t")
    assert reader("csv") is files.csv_tables
    with pytest.raises(ValueError):
        reader("fax")


def book(sheets):
    """A small workbook with shared and inline strings."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<x Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</R>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Fecha</t></si><si><r><t>Mon</t></r><r><t>to</t></r></si></sst>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
    body = '<row r="3"><c r="A3"><v>45000</v></c><c r="C3" t="inlineStr"><is><t>5,5</t></is></c></row><row r="4"><c r="A4" t="inlineStr"><is><t> </t></is></c></row>'
    more = '<row r="5"><c r="C5"><v>7</v></c></row>'
    (tmp_path / "b.xlsx").write_bytes(book({"Ventas": head + body + more, "_meta": head + body, "Vacía": head}))
    tables, alerts = workbook.sheets(spark, str(tmp_path / "*.xlsx"))
    assert list(tables) == ["ventas"] and alerts == ["Vacía: the sheet is empty"]
    assert sorted(tuple(r) for r in tables["ventas"].collect()) == [("", "", "7"), ("45000", "", "5,5")]
    cut, alerts = workbook.sheets(spark, str(tmp_path / "*.xlsx"), only=("Ventas",), most_rows=1)
    assert cut["ventas"].count() == 1 and alerts == ["Ventas: 2 rows, cut to 1"]


def test_mail(spark, tmp_path):
    m = EmailMessage()
    m["From"], m["To"], m["Cc"], m["Subject"] = "Ferretería Solano <Ventas@Solano.cr>", "a@x.cr, A@x.cr", "c@x.cr", "Factura ñ"
    m["Message-ID"], m["Date"] = "<ID@x>", "Sun, 09 Aug 2026 16:22:00 -0600"
    m.set_content("<p>hola&nbsp;x</p><style>y</style>", subtype="html")
    m.add_attachment(b"x", maintype="application", subtype="pdf", filename="f.pdf")
    for uid in (7, 9, 10):
        (tmp_path / f"{uid}.eml").write_bytes(m.as_bytes() if uid != 7 else b"Subject: none\n\nbody")
    found, alerts = mail.messages(spark, str(tmp_path), "me@x.cr", newest=2)
    assert len(alerts) == 1 and "are left out" in alerts[0]
    rows = {r["uid"]: r for r in found.collect()}
    assert set(rows) == {"9", "10"} and rows["9"]["correo_id"] == rows["10"]["correo_id"]
    r = rows["9"]
    assert (r["remitente_nombre"], r["remitente_correo"], r["destinatarios"], r["cc"], r["asunto"]) == ("Ferretería Solano", "ventas@solano.cr", "a@x.cr", "c@x.cr", "Factura ñ")
    assert (r["n_adjuntos"], r["adjuntos"], r["fecha"], r["message_id"]) == (1, "f.pdf", dt.datetime(2026, 8, 9, 16, 22), "<id@x>") and r["cuerpo"].startswith("hola")
    found, alerts = mail.messages(spark, str(tmp_path), "me@x.cr")
    every = found.collect()
    assert alerts == [] and mail.messages(spark, str(tmp_path), "me@x.cr", since=dt.datetime(2100, 1, 1))[0].count() == 0
    assert len(every) == 3 and len({x["correo_id"] for x in every}) == 2


def test_calendar_and_ads_contracts(spark):
    raw = spark.createDataFrame([("c", "Ana", '{"id": "e", "status": "cancelled"}'), ("c", "Ana", "not json")], "calendar_id string, recurso string, event string")
    out = calendar.events_of(raw)
    assert out.columns == [*calendar.COLUMNS, "version_hash"] and len(calendar.COLUMNS) == 25
    assert {(r["evento_id"], r["estado"], r["duracion_min"], r["invitados"]) for r in out.collect()} == {("e", "cancelled", None, "[]"), ("", "", None, "[]")}
    one = '{"account_id": "1", "campaign_id": "7", "campaign_name": "A", "date_start": "2026-08-03", "spend": "30", "actions": [{"action_type": "purchase", "value": "3"}, {"action_type": "lead", "value": "0"}], "age": "25-34"}'
    df = ads.insights_of(spark.createDataFrame([(one,), (one.replace('"A"', '"B"'),), ("{}",)], "insight string"), "campaign", ("age",))
    assert df.columns == [*ads.COLUMNS, "version_hash"] and len(ads.COLUMNS) == 66
    a, b, none = df.orderBy(F.col("campana_nombre").desc_nulls_last()).collect()
    assert a["insight_id"] == b["insight_id"] and a["version_hash"] != b["version_hash"]
    assert (a["compras"], a["cpa_compra"], a["leads"], a["costo_por_lead"], a["desglose"], a["entidad_id"]) == (3, 10.0, 0, None, "age=25-34", "7")
    assert none["gasto"] is None and none["acciones"] == "[]"
    s = ads.structure_of(spark.createDataFrame([('{"id": "1", "daily_budget": "2500000"}',)], "item string"), "campaign").first()
    assert s["presupuesto_diario"] == 25000.0


@pytest.mark.parametrize("sql", [
    "DROP TABLE ventas", "INSERT INTO ventas VALUES (1)", "SELECT 1", "SELECT * FROM hidden", "SELECT * FROM ventas; SELECT 1", "SELECT * FROM a.ventas",
    "SELECT * FROM parquet.`/etc`", "SELECT java_method('a', 'b') FROM ventas", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden, ventas", "SET x = 1",
    "SELECT * FROM ventas WHERE a IN (SELECT a FROM hidden)", "SELECT (SELECT max(a) FROM hidden) FROM ventas", "SELECT * FROM range(5)", "EXPLAIN SELECT * FROM ventas",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM ventas", "SELECT * FROM IDENTIFIER('hidden'), ventas", "SELECT builtin.reflect('a', 'b') FROM ventas",
    "SELECT a FROM ventas WHERE a IN (SELECT a FROM ventas WHERE EXISTS (SELECT java_method('a', 'b') FROM ventas))", "SELECT * FROM ventas, explode(array(input_file_name()))", "SELECT no_such_function(a) FROM ventas",
    "SELECT * FROM ventas WHERE EXISTS (SELECT 1 FROM hidden)", "CACHE TABLE ventas", "nonsense", "SELECT * FROM (WITH ventas AS (SELECT 1 AS a) SELECT * FROM ventas) x JOIN hidden",
])
def test_the_guard_refuses(spark, sql):
    assert not guard.check(spark, sql, {"ventas"}).ok


@pytest.mark.parametrize("sql", [
    "SELECT a, count(*) FROM ventas GROUP BY a HAVING count(*) > 1 ORDER BY 1 LIMIT 5;", "WITH x AS (SELECT * FROM ventas), y AS (SELECT * FROM x) SELECT * FROM y UNION ALL SELECT * FROM ventas",
    "SELECT v.a, sum(v.a) OVER (ORDER BY v.a) FROM Ventas v WHERE a IN (SELECT a FROM ventas) AND a NOT IN (1, 2)", 'SELECT "a" FROM ventas INTERSECT SELECT a FROM ventas',
    "SELECT * FROM ventas v LEFT JOIN LATERAL (SELECT max(a) m FROM ventas w WHERE w.a = v.a) x ON true",
])
def test_the_guard_admits_and_runs(spark, sql):
    views = {"ventas": spark.range(3).toDF("a")}
    verdict = guard.check(spark, sql, set(views))
    assert verdict.ok and verdict.tables == {"ventas"}, verdict
    guard.run(spark, views, sql)


@pytest.mark.parametrize("sql", [
    "SELECT CASE WHEN a BETWEEN 0 AND 1 THEN 'x' ELSE upper('y') END AS k, CAST(sum(a) AS DOUBLE) / NULLIF(count(DISTINCT a), 0) FROM ventas GROUP BY 1", "SELECT * FROM ventas WHERE a IS NOT NULL AND NOT (a LIKE '1%' OR a RLIKE '2')",
    "SELECT date_trunc('month', current_date), extract(YEAR FROM current_date), coalesce(a, 0) || 'x', -a % 2 FROM ventas", "SELECT a, grouping(a), count(*) FILTER (WHERE a > 1) FROM ventas GROUP BY ROLLUP (a) ORDER BY a DESC NULLS LAST",
    "SELECT a, rank() OVER w, lag(a) OVER (PARTITION BY a ORDER BY a ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM ventas WINDOW w AS (ORDER BY a)", "SELECT trim(substring(CAST(a AS STRING), 1, 2)), transform(array(a), x -> x + 1) FROM ventas",
    "SELECT * FROM ventas v WHERE NOT EXISTS (SELECT 1 FROM ventas w WHERE w.a = v.a + 1)",
])
def test_the_guard_admits_usual_expressions(spark, sql):
    verdict = guard.check(spark, sql, {"ventas"})
    assert verdict.ok, verdict


def test_passed_views_go(spark):
    guard.run(spark, {"ventas": spark.range(2).toDF("a")}, "SELECT a FROM ventas")
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("v") and len(t.name) == 33]


def test_runs_are_capped_isolated_and_stopped(spark):
    spark.range(3).createOrReplaceTempView("secret")
    views = {"ventas": spark.range(1000).toDF("a")}
    columns, rows = guard.run(spark, views, "SELECT a FROM ventas", limit=7)
    assert columns == ["a"] and len(rows) == 7
    with pytest.raises(PermissionError):
        guard.run(spark, views, "SELECT * FROM secret")
    slow = {"ventas": spark.range(10**12).toDF("a")}
    with pytest.raises(Exception, match="(?i)cancel"):
        guard.run(spark, slow, "SELECT sum(sqrt(a) * sin(a)) FROM ventas", timeout=1.0)
    assert not guard.fits_period("ventas por mes", "SELECT date_trunc('week', d) FROM t") and guard.fits_period("ventas", "SELECT 1 AS sem")


def test_policy_words(spark):
    cells = ["si: confidencial", "no: x", "no es confidencial, puede usar", "puede usar el bot", "", None, "SÍ", "algo"]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", policy.allowed(F.col("c")).alias("o")).orderBy("i")
    assert [r["o"] for r in rows.collect()] == [True, False, False, True, False, False, True, False]


def test_questions():
    assert [kpis.answer_format(q) for q in ("ventas en PDF", "gráfico de barras", "pasame el archivo", "por qué no pudiste en pdf?", "ventas")] == ["pdf", "chart", "excel", "text", "text"]
    assert kpis.names_period("ventas de agosto") and kpis.names_period("12/08") and not kpis.names_period("saldo total")
    columns = ["linea_id", "categoria", "monto_mensual"]
    assert kpis.requested_columns("dame solo monto mensual y categoría", columns) == ["monto_mensual", "categoria"]
    assert kpis.requested_columns("solo categoria vivienda", columns) == columns
    assert kpis.requested_columns("sin línea id", columns) == ["categoria", "monto_mensual"]
    assert kpis.requested_columns("no muestres la categoria", columns) == ["linea_id", "monto_mensual"]
    assert kpis.requested_columns("solo rubro y %", ["concepto", "pct_uso", "monto"]) == ["concepto", "pct_uso"]
    assert kpis.requested_columns("categoria, nada más", columns) == columns and kpis.requested_columns("la respuesta es categorias nada mas", columns) == ["categoria"]
    assert kpis.names_period("últimos 3 meses") and kpis.names_period("el mes pasado") and kpis.names_period("en 2025") and not kpis.names_period("mes a mes")


def test_rendering_shows_cells_only():
    assert render.number(1234567.5) == "1.234.567,5" and render.number(3.0) == "3" and render.cell(None) == "—"
    assert render.cell(12.5, "pct_uso") == "12,5%" and render.cell(5, "monto", "colones") == "₡5" and render.cell(5, "cantidad", "colones") == "5"
    rows = [("a", "x", 1, 3, 9), ("a", "y", 2, 3, 9), ("b", "z", 6, 6, 9)]
    assert render.result(["g", "i", "v", "group_total", "grand_total"], rows) == "a: 3\n  x: 1\n  y: 2\nb: 6\n  z: 6\nTotal: 9"
    assert render.result(["p", "v", "difference", "variation"], [("1", 10, None, None), ("2", 5, -5, -50.0)]) == "1: 10\n2: 5 (-5, -50%)"
    assert render.compact(["a"], [("x" * 50,)] * 10, most=120).endswith("more")
    assert render.chunks("aa bb\ncc", 5) == ["aa bb", "cc"] and sinks.csv_bytes(["a"], [("ñ",)]).startswith(b"\xef\xbb\xbfa")


def test_streams(spark, house, tmp_path):
    rows = [(i, dt.datetime(2026, 1, 1, 0, 0, 2 * i), f"u{i % 3}", 1.0) for i in range(29)] + [(5, dt.datetime(2026, 1, 1, 0, 0, 59), "u2", 1.0)]
    events = spark.createDataFrame(rows, "id long, ts timestamp, user string, value double")
    events.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))

    def drained(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert drained(once(stream(), "id", "ts", "1 hour"), "s_once").count() == 29
    assert drained(windowed_counts(stream(), "ts", "user", "value", "1 minute", "0 seconds"), "s_win", "complete").groupBy().sum("events").first()[0] == 30
    assert drained(sessions(stream(), "ts", "user", "10 seconds", "0 seconds"), "s_ses").count() >= 0
    passed = drained(state.throttle_stream(stream(), "user", "ts", "id", 2, 30), "s_thr")
    batch = state.throttle(events, "user", "ts", "id", 2, 30)
    assert sorted(map(tuple, passed.collect())) == sorted(map(tuple, batch.collect()))
    query = upsert_batches(stream().select("id", "user", F.unix_micros("ts").alias("p")), house, f"{house.raw}.stream_events", ["id"], ["user"], str(tmp_path / "cp"), "p")
    query.awaitTermination()
    assert spark.table(f"{house.raw}.stream_events").count() == 29


def test_throttle_folds_a_hot_key_batch_by_batch(spark):
    from collections import deque

    times = {i: i * 7919 % 1000 for i in range(900)}
    key = {i: "hot" if i % 3 else None if i % 2 else f"u{i % 5}" for i in times}
    events = spark.createDataFrame([(i, key[i], None if i % 50 == 7 else dt.datetime.fromtimestamp(t, dt.UTC)) for i, t in times.items()], "id long, user string, ts timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = state.throttle(events, "user", "ts", "id", 2, 30)
        got = {r["row_id"]: r["admitted"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for user in set(key.values()):
        own = sorted((i for i in times if key[i] == user), key=lambda i: (i % 50 == 7, 0 if i % 50 == 7 else times[i], i))
        want |= dict(zip(own, state.admit([float("nan") if i % 50 == 7 else float(times[i]) for i in own], deque(), 2, 30), strict=True))
    assert got == want and len(set(want.values())) == 2
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no key's events as one frame


def test_throttle_ignores_denied_messages():
    from collections import deque

    assert state.admit([0, 1, 2, 59, 60.5, 61], deque(), 2, 60) == [True, True, False, False, True, True]
