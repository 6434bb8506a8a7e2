import json

import pytest

from cauceda.sources import pages, sinks, sync

SCHEMA = "id long, who struct<name:string>, tags array<string>"


def write(folder, given):
    for n, payload in given.items():
        (folder / f"page-{n:04d}.json").write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return f"file://{folder}"


def page(*ids):
    return {"data": {"items": [{"id": i, "who": {"name": f"ñ{i}"}, "tags": ["a"]} for i in ids]}}


def ids(read):
    return sorted(r["id"] for r in read.rows.collect())


def test_pages_up_to_the_first_empty_one(spark, tmp_path):
    path = write(tmp_path, {1: page(1, 2), 2: page(3), 3: page(), 4: page(9)})
    got = pages.read_pages(spark, path, SCHEMA, "data.items")
    assert ids(got) == [1, 2, 3] and not got.alerts
    assert got.rows.columns == ["page", "id", "who_name", "tags"] and got.rows.filter("id = 3").first().asDict() == {"page": 2, "id": 3, "who_name": "ñ3", "tags": '["a"]'}
    assert pages.raw_pages(spark, path, records="data.items").rdd.getNumPartitions() == 5


def test_an_absent_page_ends_too_and_the_cap_is_told(spark, tmp_path):
    path = write(tmp_path, {n: page(10 * n, 10 * n + 1) for n in (0, 1, 2, 4)})
    assert ids(pages.read_pages(spark, path, SCHEMA, "data.items", first=0)) == [0, 1, 10, 11, 20, 21]
    got = pages.read_pages(spark, path, SCHEMA, "data.items", max_pages=2)
    assert ids(got) == [10, 11, 20, 21] and "cap of 2 pages" in got.alerts[0]
    none = pages.read_pages(spark, path, SCHEMA, "data.items", first=7)
    assert ids(none) == [] and none.alerts == ["no record came"]


def test_single_objects_wrong_paths_and_damaged_pages(spark, tmp_path):
    path = write(tmp_path, {1: {"data": {"items": {"id": 1}}}, 2: '{"data": ', 3: {"data": {"items": [{"id": 3}]}}, 4: {"data": [1]}, 5: {"data": {}}})
    with pytest.raises(ValueError, match="page 2: JSONDecodeError"):
        pages.read_pages(spark, path, SCHEMA, "data.items")
    got = pages.read_pages(spark, path, SCHEMA, "data.items", damaged="skip")
    assert ids(got) == [1, 3] and got.alerts[0].startswith("2 damaged pages are left out, the first is 2: JSONDecodeError")


def test_comparisons_of_the_page_choose_what_is_planned(spark, tmp_path):
    path = write(tmp_path, {n: page(n) for n in range(1, 9)})
    before = spark.conf.get(pages.PUSHDOWN)
    spark.conf.set(pages.PUSHDOWN, "true")
    try:
        some = pages.raw_pages(spark, path, records="data.items").filter("page > 2 AND page <= 5 AND record IS NOT NULL")
        assert sorted(r["page"] for r in some.collect()) == [3, 4, 5] and some.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set(pages.PUSHDOWN, before)


def test_a_source_of_pages_lands_what_it_has_and_tells_the_rest(spark, tmp_path):
    path = write(tmp_path, {1: page(1), 2: "no json", 3: page(3), 4: page()})
    house = sinks.Warehouse(spark, "Paginas")

    def load(s):
        read = pages.read_pages(s, path, SCHEMA, "data.items", damaged="skip")
        return {"datos": read.rows}, read.alerts

    run = sync.run_source(house, sync.Source("api", load))
    assert run.status == "ok_with_alerts" and run.rows == 2 and "1 damaged pages" in run.alerts[0]
