import datetime as dt

import pytest
from pyspark.sql import functions as F

from cauceda.operators import classify, extract, identity, infer, lookup, quality, trends, upsert
from cauceda.operators.extract import Field, Model



def at():
    return F.lit("2026-01-01").cast("timestamp_ntz")


NOTICE = "Hola, le avisamos.\nComercio: Súper\nMonto: CRC 3,320.00\nMASTER: ****8774\nFecha: Ago 9, 2026 , 16:22\nReferencia:"
FIELDS = [Field("shop", labels=("Comercio",), required=True), Field("paid", "amount", ("Monto",), required=True), Field("card", "label", ("AMEX", "MASTER")), Field("at", "date_es", ("Fecha",)), Field("ref", labels=("Referencia",))]


def bodies(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")


@pytest.mark.parametrize(("kind", "body"), [("lines", NOTICE), ("flat", NOTICE.replace("\n", " ")), ("lines", NOTICE.replace("\n", " "))])
def test_labelled_text(spark, kind, body):
    out = extract.accepted(extract.extract(bodies(spark, body), Model(FIELDS, kind), "body")).first()
    assert (out["shop"], out["paid"], out["paid_currency"], out["card"], out["card_label"], out["at"], out["ref"]) == ("Súper", 3320.0, "CRC", "****8774", "MASTER", dt.datetime(2026, 8, 9, 16, 22), "")


def test_rejects_name_what_is_missing(spark):
    rows = extract.rejected(extract.extract(bodies(spark, "nothing here", NOTICE.replace("CRC 3,320.00", "CRC ---"), NOTICE, None), Model(FIELDS, "lines"), "body"))
    assert {r["row_key"]: r["reason"] for r in rows.collect()} == {"0": "missing: shop, paid", "1": "missing: paid", "3": "missing: shop, paid"}


def test_first_label_wins_and_schema_precedes_rows(spark):
    model = Model(FIELDS, "lines")
    out = extract.accepted(extract.extract(bodies(spark, NOTICE + "\nComercio: Otro"), model, "body"))
    assert out.first()["shop"] == "Súper"
    empty = extract.accepted(extract.extract(bodies(spark, "x").limit(0), model, "body"))
    assert [(f.name, f.dataType) for f in empty.schema.fields] == [(f.name, f.dataType) for f in model.schema().fields]


def test_models_are_checked_before_rows():
    for bad in (Model([Field("a"), Field("a")], "lines"), Model([Field("a", "odd")], "lines"), Model([Field("A b")], "lines"), Model([Field("a")], "odd")):
        with pytest.raises(ValueError):
            bad.check()
    assert [f.type for f in extract.merge_fields([Field("a"), Field("b")], [Field("c"), Field("a", "integer")])] == ["integer", "text", "text"]


def test_patterns_and_paths(spark):
    model = Model([Field("n", "integer", pattern=r"^n=(?P<v>\d+)"), Field("bad", pattern="(")], "pattern")
    assert extract.extract(bodies(spark, "x\nN=12"), model, "body").first()["n"] == 12
    model = Model([Field("a", pattern="x.0.y"), Field("o", pattern="x"), Field("none", pattern="z.q")], "path")
    row = extract.extract(bodies(spark, '{"x": [{"y": "v"}]}'), model, "body").first()
    assert (row["a"], row["o"], row["none"]) == ("v", '[{"y":"v"}]', None)


def test_blocks_of_an_interval(spark):
    spans = spark.createDataFrame([(0, 0), (5, 3), (7, 8), (0, 16), (3, 700), (255, 4097), (100, lookup.WIDTH**lookup.LEVELS)], "low int, end int")
    for r in spans.select("low", "end", lookup.blocks(F.col("low"), F.col("end")).alias("b")).collect():
        cut = sorted((b["block"] * 16 ** b["level"], (b["block"] + 1) * 16 ** b["level"]) for b in r["b"])
        ends = [r["low"], *(e for _, e in cut)]
        assert [s for s, _ in cut] == ends[:-1] and ends[-1] == max(r["low"], r["end"] if cut else 0)
        assert bool(cut) == (r["low"] < r["end"]) and len(cut) <= 30 * lookup.LEVELS


def test_validity_of_a_hot_key(spark):
    """100,000 rows and 1,000 intervals of one key: what is joined grows with their sum, and the last join can be split."""
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 1500).cast("int"))
    aux = spark.range(1000).select(F.lit("k").alias("key"), F.concat(F.lit("t"), "id").alias("term"), "id", start.alias("a"), F.when(F.col("id") % 100 != 0, F.date_add(start, (F.col("id") % 50 - 1).cast("int"))).alias("b"))
    base = spark.range(100_000).select("id", F.when(F.col("id") % 1000 == 0, " ").otherwise("k").alias("of"), F.date_add(F.lit("2019-12-01").cast("date"), (F.col("id") % 1600).cast("int")).alias("day"))
    how = lookup.Lookup("terms", "of", "key", ["term"], "id", base_date="day", valid_from="a", valid_to="b")
    terms = [(r["a"], r["b"] or dt.date.max, r["id"]) for r in aux.collect()]
    firsts = {}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        for k, v in zip(kept, ("-1", "16KB", "16KB", "1.2"), strict=True):
            spark.conf.set(k, v)
        hot = base.withColumn("day", F.when(F.col("id") % 3 == 0, F.lit("2020-06-01").cast("date")).otherwise(F.col("day")))
        found = lookup.lookup(hot, aux, how, "id")
        rows = found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for r in rows:
        if r["day"] not in firsts:
            firsts[r["day"]] = min((i for a, b, i in terms if a <= r["day"] <= b), default=None)
        want = firsts[r["day"]] if r["of"] == "k" else None
        assert r["term"] == (None if want is None else f"t{want}")
    assert len(rows) == 100_000


def test_lookup_first_match_and_validity(spark):
    base = spark.createDataFrame([(1, "x-8774", "2026-08-01", None), (2, "8774", "2026-01-01", "own"), (3, "", "2026-08-01", None), (4, "8774", None, None)], "id int, card string, day string, who string")
    aux = spark.createDataFrame([("8774", "Ana", "2026-07-01", "", "", 2), ("*8774", "Eva", "", "2026-07-31", "si", 1), ("8774", "Off", "", "", "no", 0)], "last4 string, who string, a string, b string, active string, pos int")
    how = lookup.Lookup("cards", "card", "last4", ["who"], "pos", "last4", "day", "a", "b", "active")
    got = {r["id"]: r["who"] for r in lookup.lookup(base, aux, how, "id").collect()}
    assert got == {1: "Ana", 2: "Eva", 3: None, 4: None}
    kept = {r["id"]: r["who"] for r in lookup.chain(base, {"cards": aux}, [how], "id", only_missing=True).collect()}
    assert kept == {1: "Ana", 2: "own", 3: None, 4: None}


def test_alternative_keys_one_to_one_by_priority(spark):
    """Two incoming rows claim one stored row, two stored rows are one, blank keys match nothing, an unknown place is matched by number alone."""
    shape = "id string, box string, uid string, body string"
    stored = [("a", "in", "1", "old a"), ("b", "in", "2", "old b"), ("c", "in", "3", "old c"), (None, "", "9", "legacy"), ("d", "", "", "old d"), ("e", "in", "5", "e1"), ("f", "in", "5", "e2"), ("far", "in", "77", "kept")]
    old = upsert.stamped(spark.createDataFrame(stored, shape), ["box", "uid", "body"], "r1", at())
    window = [("a", "in", "2", "a by id, though b has its number", 1), ("new", "in", "2", "claims b", 2), ("other", "in", "2", "claims b too", 3), ("c", "in", "3", "first", 4), ("c", "in", "3", "old c", 5), ("m", "arch", "9", "was legacy", 6), ("x", "", "", "blank", 7), ("g", "in", "5", "one of two", 8)]
    new = spark.createDataFrame(window, shape + ", p int")
    ways = [identity.Identity(("box", "uid")), identity.Identity(("uid",), "box = ''")]
    out = upsert.upsert(old, new, ["id"], ["box", "uid", "body"], "r2", at(), "p", identities=ways)
    got = {r["id"]: (r["action"], r["body"]) for r in out.collect()}
    assert got == {
        "a": ("updated", "a by id, though b has its number"), "other": ("updated", "claims b too"), "new": ("new", "claims b"), "c": ("unchanged", "old c"), "m": ("updated", "was legacy"),
        "x": ("new", "blank"), "g": ("updated", "one of two"), "d": ("kept", "old d"), "far": ("kept", "kept"),
    }
    found = identity.resolve(old, upsert.given(new, ["id"], "p"), [identity.Identity(("id",)), *ways], F.col("p"), F.col("seen_at"))
    assert {r["id"] for r in found.merged.collect()} == {"e"} or {r["id"] for r in found.merged.collect()} == {"f"}
    with pytest.raises(Exception, match="id is null"):
        upsert.upsert(old, spark.createDataFrame([(None, "in", "1", "x")], shape), ["id"], ["box", "uid", "body"], "r", at(), identities=ways).collect()


def test_classification_layers_and_labels(spark):
    df = spark.createDataFrame([("1", "Súper  A"), ("2", "super a"), ("3", "taxi rojo"), ("4", "otro"), ("5", "otro")], "row_key string, shop string")
    mapping = spark.createDataFrame([("", "SUPER A", "food")], "dimension string, folded string, label string")
    over = spark.createDataFrame([("2", "account", "gift", 1)], "row_key string, column string, value string, position int")
    out = classify.classify(df, "shop", "account", [classify.Rule("%taxi%", "ride", priority=1)], mapping, over)
    assert {r["row_key"]: r["account"] for r in out.collect()} == {"1": "food", "2": "gift", "3": "ride", "4": "unclassified", "5": "unclassified"}
    asked = classify.pending(out, "shop", "account", mapping)
    assert [tuple(r) for r in asked.collect()] == [("OTRO", "otro")]
    said = spark.createDataFrame([("OTRO", "FOOD"), ("OTRO", "invented"), ("NOT ASKED", "food")], "folded string, label string")
    cats = spark.createDataFrame([("Food",), ("Ride",)], "category string")
    assert [tuple(r) for r in classify.accept_labels(said, asked, cats).collect()] == [("OTRO", "Food")]


def test_upsert_is_idempotent_and_keeps_what_is_outside(spark):
    shape = "id string, name string"
    old = upsert.stamped(spark.createDataFrame([("a", "1"), ("b", "2")], shape), ["name"], "r1", at())
    window = spark.createDataFrame([("b", "2"), ("c", "3"), ("b", "9")], shape).withColumn("p", F.monotonically_increasing_id())
    out = upsert.upsert(old, window, ["id"], ["name"], "r2", at(), "p").cache()
    assert {(r["id"], r["name"], r["action"]) for r in out.collect()} == {("a", "1", "kept"), ("b", "9", "updated"), ("c", "3", "new")}
    again = upsert.upsert(out.drop("action"), window, ["id"], ["name"], "r3", at(), "p")
    assert {(r["id"], r["name"], r["action"], r["run_id"]) for r in again.collect()} == {("a", "1", "kept", "r1"), ("b", "9", "unchanged", "r3"), ("c", "3", "unchanged", "r3")}
    with pytest.raises(Exception, match="id is null"):
        upsert.upsert(old, spark.createDataFrame([(None, "1")], shape), ["id"], ["name"], "r", at()).collect()


def test_inference(spark):
    rows = [("01/02/2026", "5.000", "x", ""), ("16/01/2026", "3,25", "y", None), ("21/01/2026", "n/d", "z", " ")]
    df = spark.createDataFrame(rows * 5, "day string, amount string, name string, none string")
    out, alerts = infer.infer(df, day_first=False)
    assert dict(out.dtypes) == {"day": "timestamp_ntz", "amount": "string", "name": "string", "none": "string"}
    assert any("day_first" in a for a in alerts) and out.first()["day"] == dt.datetime(2026, 2, 1)
    assert infer.always_blank(df) == ["none"]
    p = infer.Profile("a", 100, 70, 70, 0, 0, 0, 0, 0, 0)
    assert infer.decide(p, True, True).kind == "text" and infer.decide(p, True, True, of_filled=True).kind == "number"


def plan(df, of):
    """How often the optimised plan of ``df`` has ``of``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(of)


def test_a_cell_is_typed_by_few_patterns(spark):
    df = spark.range(3).selectExpr("concat('31/12/202', id) AS day", "concat(id, ',5') AS amount")
    found = [infer.Profile(c, 3, 3, 0, 0, 0, 0, 0, 0, 0, kind) for c, kind in (("day", "timestamp"), ("amount", "number"))]
    out = infer.typed(df, found)
    assert [tuple(r) for r in out.orderBy("day").collect()] == [(dt.datetime(2020 + i, 12, 31), i + 0.5) for i in range(3)]
    assert plan(out, "regexp_extract(") == 6 and plan(out, "trim(") <= 4  # the text of a cell is made once, not by each pattern
    odd = spark.createDataFrame([("1/13/2026 7:05",), ("2026-13-01",), ("30/2/2026",), ("1-2-2026x",), ("1/2",), (None,)], "day string")
    assert [r["day"] for r in infer.typed(odd, [infer.Profile("day", *[0] * 9, "timestamp")]).collect()] == [None, None, None, dt.datetime(2026, 2, 1), None, None]


def test_a_column_is_profiled_by_few_patterns(spark):
    df = spark.createDataFrame([("31/12/2026", "1.234,5"), ("1-2-2026 7:05", "n/d"), ("2026-1-2", ""), (None, "1,234")] * 5, "day string, amount string")
    assert plan(infer.counted(df), "regexp_extract(") == 6 * len(df.columns)
    found = [(p.rows, p.filled, p.numeric, p.dated, p.day_first, p.month_first, p.either, p.comma_groups, p.point_groups) for p in infer.profiles(df)]
    assert found == [(20, 15, 0, 15, 5, 0, 5, 0, 0), (20, 15, 10, 0, 0, 0, 0, 5, 5)]


def test_the_guard_survives_empty_loads(spark):
    shape = "table string, columns array<string>, rows bigint"
    was = spark.createDataFrame([("sales", ["a"], 1500)], shape)
    for n, want in ((0, (True, False)), (1480, (False, False)), (400, (False, True)), (750, (False, False))):
        row = quality.review(was, spark.createDataFrame([("sales", ["a", "b"], n)], shape)).first()
        assert (row["blocked"], row["dropped"], row["added"], row["missing"]) == (*want, ["b"], [])
    assert quality.state(True, []) == "ok_with_block" and quality.state(False, ["x"]) == "ok_with_alerts" and quality.state(False, [], False) == "skipped"


def test_newest_detail_outlives_a_blocked_run(spark):
    rows = [("s", "ok", dt.datetime(2026, 1, d), f'{{"t": {{"columns": ["a"], "rows": {d}}}}}') for d in range(1, 10)]
    rows += [("s", "ok_with_block", dt.datetime(2026, 2, 1), '{"u": {"columns": ["b"], "rows": 4}}'), ("s", "error", dt.datetime(2026, 3, 1), '{"t": {"columns": [], "rows": 0}}')]
    runs = spark.createDataFrame(rows, "source_id string, status string, finished timestamp, detail string")
    assert {(r["table"], r["rows"]) for r in upsert.latest_detail(runs).collect()} == {("t", 9), ("u", 4)}


def test_trends(spark):
    s = spark.createDataFrame([(1, 10.0), (2, 0.0), (3, 5.0)], "p int, v double")
    assert [(r["difference"], r["variation"]) for r in trends.variation(s, "p", "v").orderBy("p").collect()] == [(None, None), (-10.0, -100.0), (5.0, None)]
    assert trends.summary(s, "p", "v").first().asDict() == {"rises": 1, "falls": 1, "equal": 0, "first": 10.0, "last": 5.0, "change": -50.0}
    assert [r["p"] for r in trends.last_periods(s, "p", 2).collect()] == [2, 3]
