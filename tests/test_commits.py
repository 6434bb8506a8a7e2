import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from cauceda.operators import identity
from cauceda.sources import commits, sinks, sync

SHAPE = "id string, day date, v string"


@pytest.fixture(scope="module")
def house(spark):
    return sinks.Warehouse(spark, "Carrera")


def rows(spark, *given):
    return spark.createDataFrame([(i, dt.date.fromisoformat(d) if d else None, v) for i, d, v in given], SHAPE)


def held(spark, name):
    return {r["id"]: (str(r["day"]), r["v"]) for r in spark.table(name).collect()}


def test_of_two_writers_one_loses_and_tries_again(spark, house):
    name = f"{house.raw}.race"
    assert house.upsert(rows(spark, ("a", "2026-01-01", "1")), name, ["id"], ["day", "v"], "r0") == {"new": 1}
    own, calls = house.stage, []

    def stage(df, *args, **more):
        aside = own(df, *args, **more)
        if not calls:  # another writer commits while this one is writing
            calls.append(1)
            sinks.Warehouse(spark, "Carrera").upsert(rows(spark, ("b", "2026-01-02", "2"), ("a", "2026-01-01", "other")), name, ["id"], ["day", "v"], "r1")
        return aside

    house.stage = stage
    try:
        assert house.upsert(rows(spark, ("c", "2026-01-03", "3")), name, ["id"], ["day", "v"], "r2") == {"kept": 2, "new": 1}
    finally:
        del house.stage
    assert held(spark, name) == {"a": ("2026-01-01", "other"), "b": ("2026-01-02", "2"), "c": ("2026-01-03", "3")}
    assert not [t.name for t in spark.catalog.listTables(house.raw) if t.name.startswith("race__")]


def test_threads_lose_no_row(spark, house):
    name = f"{house.raw}.threads"
    house.upsert(rows(spark, ("0", "2026-01-01", "x")), name, ["id"], ["day", "v"], "r")
    errors = []

    def write(i):
        try:
            sinks.Warehouse(spark, "Carrera").upsert(rows(spark, (str(i), "2026-01-01", "x")), name, ["id"], ["day", "v"], f"r{i}", tries=12)
        except Exception as error:
            errors.append(error)

    every = [threading.Thread(target=write, args=(i,)) for i in range(1, 4)]
    for t in every:
        t.start()
    for t in every:
        t.join()
    assert not errors and sorted(held(spark, name)) == ["0", "1", "2", "3"]


def test_a_version_is_claimed_once(spark, house):
    name = f"{house.raw}.once"
    house.swap(spark.range(2), name)
    version = house.version(name)
    aside = house.stage(spark.range(3), name)
    house.swap(spark.range(4), name)
    with pytest.raises(commits.Conflict):
        house.publish(aside, name, version)
    house.drop(aside)
    assert spark.table(name).count() == 4


def test_a_claim_whose_writer_died_is_carried_out(spark, house, monkeypatch):
    name = f"{house.raw}.died"
    house.swap(spark.range(7), name)
    for df in (spark.range(9), spark.range(5).withColumn("b", F.lit(1))):  # the same columns; others
        aside = house.stage(df, name)
        with monkeypatch.context() as m:
            m.setattr(sinks.Warehouse, "_show", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
            with pytest.raises(RuntimeError, match="died"):
                house.publish(aside, name)
        assert house.exists(name) and spark.table(name).count() == df.count()
        if spark.catalog.tableExists(aside):
            spark.sql(f"DROP TABLE {aside}")  # whoever tidies up deletes no row
        assert spark.table(name).count() == df.count() and spark.table(name).columns == df.columns
    house.swap(spark.range(1), name)
    assert spark.table(name).count() == 1


def test_a_window_rewrites_only_its_days(spark, house):
    name = f"{house.raw}.days"
    first = [("a", "2026-01-01", "1"), ("b", "2026-01-01", "2"), ("c", "2026-01-02", "3"), ("d", "2026-01-03", "4"), ("e", None, "5")]
    assert house.upsert_days(rows(spark, *first), name, ["id"], ["day", "v"], "r1", "day") == {"new": 5}
    files = {d: set(spark.table(name).filter(F.col("day") == d).inputFiles()) for d in ("2026-01-01", "2026-01-02", "2026-01-03")}
    got = house.upsert_days(rows(spark, ("b", "2026-01-01", "2*"), ("c", "2026-01-05", "moved"), ("f", "2026-01-05", "6"), ("e", None, "5*")), name, ["id"], ["day", "v"], "r2", "day")
    assert got == {"kept": 1, "updated": 3, "new": 1}
    assert held(spark, name) == {"a": ("2026-01-01", "1"), "b": ("2026-01-01", "2*"), "c": ("2026-01-05", "moved"), "d": ("2026-01-03", "4"), "e": ("None", "5*"), "f": ("2026-01-05", "6")}
    assert set(spark.table(name).filter("day = '2026-01-03'").inputFiles()) == files["2026-01-03"]
    assert set(spark.table(name).filter("day = '2026-01-01'").inputFiles()).isdisjoint(files["2026-01-01"])
    plan = spark.table(name).filter("day = DATE'2026-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert house.upsert_days(rows(spark, ("d", "2026-01-03", "4")), name, ["id"], ["day", "v"], "r3", "day", moves=False) == {"unchanged": 1}
    with pytest.raises(ValueError, match="more than 1 days"):
        house.upsert_days(rows(spark, *first), name, ["id"], ["day", "v"], "r4", "day", most_days=1)


def test_a_claim_on_partitions_is_carried_out(spark, house, monkeypatch):
    name = f"{house.raw}.halfway"
    house.upsert_days(rows(spark, ("a", "2026-01-01", "1"), ("b", "2026-01-02", "2")), name, ["id"], ["day", "v"], "r1", "day")
    with monkeypatch.context() as m:
        m.setattr(sinks.Warehouse, "_show", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            house.upsert_days(rows(spark, ("a", "2026-01-02", "1*"), ("c", "2026-01-03", "3")), name, ["id"], ["day", "v"], "r2", "day")
    assert house.exists(name) and held(spark, name) == {"a": ("2026-01-02", "1*"), "b": ("2026-01-02", "2"), "c": ("2026-01-03", "3")}


def test_mail_that_moved_and_calendars_that_were_renamed_stay_one_row(spark, house):
    shape = "correo_id string, buzon string, carpeta string, uid string, asunto string"
    windows = [[("m1", "yo", "INBOX", "1", "a"), ("m2", "yo", "INBOX", "2", "b")], [("m1", "yo", "Archivo", "9", "a"), ("m3", "yo", "INBOX", "2", "b again")]]
    from cauceda.sources import calendar, mail

    growing = sync.Growing(mail.KEYS, ["buzon", "carpeta", "uid", "asunto"], {"identities": mail.IDENTITIES})
    source = sync.Source("zoho", lambda s: ({"correos": s.createDataFrame(windows.pop(0), shape)}, []), growing={"correos": growing})
    assert [sync.run_source(house, source).status for _ in range(2)] == ["ok", "ok"]
    found = sorted((r["correo_id"], r["carpeta"], r["action"]) for r in spark.table(f"{house.raw}.zoho__correos").collect())
    assert found == [("m1", "Archivo", "updated"), ("m3", "INBOX", "updated")]
    shape, name = "calendar_id string, recurso string, evento_id string, titulo string", f"{house.raw}.eventos"
    more = {"identities": calendar.IDENTITIES}
    house.upsert(spark.createDataFrame([("old@x", "Sala", "e1", "t"), ("old@x", "Sala", "e2", "u")], shape), name, calendar.KEYS, ["recurso", "titulo"], "r1", **more)
    assert house.upsert(spark.createDataFrame([("new@x", "Sala", "e1", "t2")], shape), name, calendar.KEYS, ["recurso", "titulo"], "r2", **more) == {"kept": 1, "updated": 1}
    assert isinstance(calendar.IDENTITIES[0], identity.Identity)
