import gzip

import pytest

from cauceda.queries import jobs
from cauceda.sources import ads, calendar, parts


@pytest.fixture
def folder(tmp_path):
    for name, lines in {"a": ['{"id": "1", "start": {"date": "2026-01-02"}}', "", '{"id": "2"}'], "b": ['{"id": "3"}', '{"id": "4', "[1]", "5"], "c": [" "]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(lines))
    return tmp_path


def paths(folder, *names):
    return {n: str(folder / n) for n in names}


def test_a_damaged_part_is_left_out(spark, folder):
    found = parts.read_parts(spark, paths(folder, "a", "b", "c", "none"))
    assert sorted(r["part"] for r in found.rows.collect()) == ["a", "a"]
    told = found.told()
    assert told == found.alerts and "b: 3 of 4 records are damaged, the whole part is left out" in told and "c: no record came" in told
    assert len(told) == 3 and any(a.startswith("none: cannot be read") for a in told)


def test_damaged_records_are_observed(spark, folder):
    found = parts.read_parts(spark, paths(folder, "a", "b", "c", "none"), "record")
    assert len(found.alerts) == 1 and sorted(r["part"] for r in found.rows.collect()) == ["a", "a", "b"]
    assert "b: 3 of 4 records are damaged, they are left out" in found.told() and "c: no record came" in found.told()


def test_a_file_that_breaks_while_it_is_read(spark, folder):
    whole = gzip.compress(b'{"id": "9"}\n' * 50_000)
    (folder / "z").mkdir()
    (folder / "z" / "x.json.gz").write_bytes(whole[: len(whole) // 2] + b"\0" * 40)
    found = parts.read_parts(spark, paths(folder, "a", "z"))
    assert found.rows.count() == 2 and any(a.startswith("z: cannot be read") for a in found.told())


def test_no_good_part(spark, folder):
    with pytest.raises(RuntimeError, match="none of the 2 parts"):
        parts.read_parts(spark, paths(folder, "b", "none"))
    with pytest.raises(ValueError, match="damaged is one of"):
        parts.read_parts(spark, paths(folder, "a"), "all")


def test_all_parts_damaged_may_be_empty(spark, folder):
    found = parts.read_parts(spark, paths(folder, "b", "none"), may_be_empty=True)
    assert found.rows.columns == ["part", "record"] and found.rows.count() == 0 and found.names == []
    assert "b: 3 of 4 records are damaged, the whole part is left out" in found.told() and len(found.told()) == 2
    with pytest.raises(RuntimeError, match="none of the 1 parts"):
        parts.read_parts(spark, paths(folder, "none"), may_be_empty=True)


def test_events_all_of_whose_parts_are_damaged(spark, tmp_path):
    spark.createDataFrame([(i, "abc"[i % 3]) for i in range(7, 3008, 50)] + [(1007, "b"), (2007, "c")], "event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    rows = jobs.parts_that_fail(spark, str(tmp_path)).collect()
    assert {r["how"] for r in rows} == {"record"} and sorted(r["id"] for r in rows) == [i for i in range(7, 3008, 50) if i % 3 and i % 1000 != 7]


def test_calendars_and_accounts(spark, folder):
    rows, found = calendar.events(spark, {n: (f"room {n}", p) for n, p in paths(folder, "a", "b", "none").items()})
    assert {(r["calendar_id"], r["recurso"], r["evento_id"]) for r in rows.collect()} == {("a", "room a", "1"), ("a", "room a", "2")} and len(found.told()) == 2
    rows, found = ads.accounts(spark, paths(folder, "a", "b"), "ad", damaged="record")
    assert rows.count() == 3 and len(found.told()) == 1
