import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    texts = {i: prose(rng.randint(60, 200)) for i in range(300)}
    for i in range(0, 300, 6):
        own = texts[i].split()
        own[3:3] = ["florp", "grusket"]
        own[40:40] = ["snarvles"]
        texts[i] = " ".join(own)
    passage = prose(80)
    for i in (301, 302, 303):
        texts[i] = f"{prose(70)} {passage} {prose(60)}"
    texts[310], texts[311] = texts[7], texts[7]
    near = texts[11].split()
    texts[312] = " ".join([*near[:-1], "changed"])
    texts[313], texts[314] = "", None
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_every_stage_takes_effect(spark, tables):
    path, texts = tables
    docs, held = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out.cache()
        held[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i in range(0, 300, 6)}
    assert not toxic & set(held["toxicity"]) and len(held["toxicity"]) >= len(texts) - len(toxic) - 3
    assert {7, 310} & set(held["exact_dedup"]) == set() and 311 in held["exact_dedup"]
    assert 11 in held["ngram_jaccard_join"] and 312 not in held["ngram_jaccard_join"]
    last = held["substring_dedup"]
    assert set(last) == set(held["ngram_jaccard_join"]) and last[301] == texts[301]
    assert len(last[302].split()) == len(texts[302].split()) - 80 == 130
    assert all(last[i] == texts[i] for i in last if i not in (302, 303))


def test_stages_of_odd_tables(spark, tmp_path, corpus, clashing):
    """Null ids, repeated rows, clashing columns, a very long text; and no rows at all."""
    path = str(tmp_path)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.filter("toxic = 0").write.parquet(f"{path}/labels.parquet")
    docs = clashing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, path).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    texts = [r["text"] for r in docs.collect()]
    assert sum(t == "same row" for t in texts) == 2 and sum(not t for t in texts) == 1 and max(len(t or "") for t in texts) > 50_000
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).filter("piece = 0").count() == len(texts)
    none = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, path)
    assert none.count() == 0


def test_run_packs_what_is_left(spark, tables):
    path, _ = tables
    out = corpus_pipeline.run(spark, path).collect()
    total = {}
    for r in out:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 2048 and len(total) <= 1.05 * sum(total.values()) / 2048 + 1
    assert {r["doc_id"] for r in out} >= {1, 11, 301, 302, 311}
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_entry_registers_one_query_for_each_operator():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
