import json

import pytest

from cauceda.operators import build, propose


def mails(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, cuerpo string")


def notice(i):
    brand, amount = ("VISA", "AMEX")[i % 2], ("Monto", "Importe")[i % 3 == 0]
    lines = ["Saludos", f"Comercio: Tienda {i}", "Comercio: otra", f"{brand}: ****{1000 + i}", f"{amount}: CRC {i},500.00", f"Autorización: {i:06d}", f"Cuotas: {i % 12}", "Notas:", "https://x.example/a", f"a las 1{i % 10}:30", f"Código de rareza {i}: {i}"]
    return "\n".join(lines)


def test_labels_types_and_alternatives(spark):
    out = propose.propose(mails(spark, [notice(i) for i in range(60)]), "cuerpo", {"none": "banco", "shop": "SALUDOS"}, least=0.2)
    got = {f.column: (f.type, f.labels, f.required) for f in out.fields}
    assert got == {
        "comercio": ("text", ("Comercio",), True), "amex": ("label", ("AMEX", "VISA"), True), "importe": ("amount", ("Importe", "Monto"), True),
        "autorizacion": ("text", ("Autorización",), True), "cuotas": ("integer", ("Cuotas",), True),
    }
    assert (out.texts, out.accepted, out.rejected, out.blank, out.preset) == (60, 60, 0, [], "shop")
    assert any(a.startswith("Notas: always empty") for a in out.alerts) and any(a.startswith("autorizacion: digits") for a in out.alerts)


def test_the_tabs_declare_what_is_proposed(spark):
    out = propose.propose(mails(spark, [notice(i) for i in range(40)]), "cuerpo", least=0.2)
    model, fields = propose.tab_rows(out, "buys", "mails", "cuerpo")
    plan = build.declared(model, {t: fields if t == "campos" else [] for t in build.TABS})
    assert [(f.column, f.type, f.labels, f.required) for f in plan.model.fields] == [(f.column, f.type, f.labels, f.required) for f in out.fields]


def test_labels_are_counted_without_sorting_rows(spark, monkeypatch):
    rows, frames = mails(spark, [notice(i) for i in range(40)]), []
    taken = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: frames.append(df) or taken(df))
    propose.propose(rows, "cuerpo", least=0.2)
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in frames]
    assert len(plans) == 4 and "inline" not in plans[0]  # texts are counted without their entries
    counted = plans[1].split("inline(")[0]
    assert counted.count("HashAggregate(keys=[label") == 2  # entries are hashed; only what is counted already is sorted for the smallest spelling


def test_json_texts(spark):
    rows = [json.dumps({"total": f"{i}.50", "cliente": {"n": i}, "vacio": None, "a b": 1, "codigo": i}) for i in range(30)]
    out = propose.propose(mails(spark, [*rows, "Comercio: x", None, "{broken"]), "cuerpo")
    assert out.extractor == "path" and {(f.column, f.type, f.pattern) for f in out.fields} == {("total", "decimal", "total"), ("cliente", "text", "cliente"), ("codigo", "text", "codigo")}
    assert (out.texts, out.accepted, out.rejected) == (33, 30, 3)


def test_meeting_labels_stay_apart(spark):
    out = propose.propose(mails(spark, [f"A: CRC {i}\nB: CRC {i}" if i % 2 else f"A: CRC {i}" for i in range(1, 20)]), "cuerpo")
    assert [(f.column, f.labels, f.required) for f in out.fields] == [("a", ("A",), True), ("b", ("B",), False)]


@pytest.mark.parametrize("texts", [[], [None, ""], ["no labels here", "x"], ["Notas:", "Notas: "]])
def test_nothing_to_propose(spark, texts):
    with pytest.raises(ValueError, match="no field"):
        propose.propose(mails(spark, texts), "cuerpo")


def test_the_cut_is_told(spark):
    out = propose.propose(mails(spark, ["\n".join(f"L{i}: {i}x" for i in range(9))] * 3), "cuerpo", most=4)
    assert len(out.fields) == 4 and "more than 4 labels" in out.alerts[0]
