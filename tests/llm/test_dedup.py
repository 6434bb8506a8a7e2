import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cauceda.llm import components, exact_dedup, ngram_join, sharding, substring_dedup
from tests.llm.conftest import documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_groups_equal_brute_force(docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    want = []
    for i, t in corpus:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = rows_of(exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_index_splits_overfull_buckets(spark):
    df = documents(spark, [(i, f"text {i}") for i in range(500)])
    out = exact_dedup.exact_groups(df, capacity=20)
    load = {r["bucket"]: r["n"] for r in out.groupBy("bucket").agg(F.countDistinct("text_sha256").alias("n")).collect()}
    assert sum(load.values()) == 500 and len(load) > 25 and max(load.values()) <= 20


def test_exact_index_chains_colliding_keys(spark):
    """Keys that agree in many bits deepen the directory; equal keys cannot part and chain."""
    near = [(7 << 20) + i for i in range(40)]
    tables = exact_dedup.directory(spark.createDataFrame([(k,) for k in near], "key long"), 1)
    found = exact_dedup.in_bucket(spark.createDataFrame([(k,) for k in [*near, *near]], "key long"), tables).collect()
    assert len({r["bucket"] for r in found}) == 40 and len(found) == 80 and max(r["local_depth"] for r in found) > 58
    same = exact_dedup.directory(spark.createDataFrame([(7,)], "key long"), 1)
    assert [r["local_depth"] for _, t in same for r in t.collect()] == [0]
    rows = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "a", 7)], "doc_id long, text string, key long")
    index = {(r["chain"], r["keep_id"], r["group_size"]) for r in exact_dedup.build_index(rows, 1)[0].collect()}
    assert {c for c, _, _ in index} == {1, 2} and {(k, n) for _, k, n in index} == {(2, 1), (3, 2)}


def test_exact_dedup_keeps_columns(clashing, corpus):
    out = exact_dedup.exact_dedup(clashing)
    assert out.columns == clashing.columns
    texts = [t or "" for (t,) in rows_of(out.select("text"))]
    assert set(texts) == {t or "" for _, t in corpus}


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert ngram_join.ngram_join(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_shards_are_gapless_even_and_seeded(docs, corpus):
    out = sharding.shard(docs, 16, bucket_bytes=4096)
    slots = defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1
    sizes = [len(s) for s in slots.values()]
    assert sum(sizes) == len(corpus) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in sharding.shard(docs, 16, bucket_bytes=4096).collect() if r["doc_id"] != 76}
    assert again == {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in out.collect() if r["doc_id"] != 76}
    wider = sharding.shard(docs.repartition(7), 16, bucket_bytes=4096).repartition(2)
    assert sorted(map(str, wider.collect())) == sorted(map(str, out.collect()))  # it depends on no partitions
    other = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in sharding.shard(docs, 16, bucket_bytes=4096, seed=18).collect() if r["doc_id"] != 76}
    assert other != again


def test_repeated_rows_part(spark):
    rows = [(1, "same text")] * 2000 + [(None, None)] * 1000 + [(i, f"text {i}") for i in range(1000)]
    df = documents(spark, rows).withColumns({c: F.lit("x") for c in ("bucket", "rows", "ordinal", "n", "position")})
    load = [r["count"] for r in sharding.shuffled(df, bucket_rows=100).groupBy("bucket").count().collect()]
    assert sum(load) == 4000 and len(load) == 40 and max(load) < 160
    out = sharding.shard(df, 16, bucket_rows=100).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert all(r["n"] == 250 and r["last"] == 249 for r in out)


def test_written_shards_are_in_slot_order(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard(docs, 4), str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("shard=2/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(part)).collect()]
        assert slots == sorted(slots)


def shingles(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(corpus):
    sets = [shingles(t) for _, t in corpus]
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(corpus):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(corpus)]


def test_ngram_components_equal_brute_force(clashing, corpus):
    got = rows_of(ngram_join.ngram_join(clashing).drop("n_links"))
    assert sorted(got, key=str) == sorted(brute_components(corpus), key=str)


@pytest.mark.parametrize("bits", [(36, 28), (8, 6)])
def test_ngram_result_does_not_depend_on_short_names(spark, corpus, bits, monkeypatch):
    """Names so short that most collide may propose more, but lose nothing."""
    near = [r for r in corpus if r[0] is not None and 36 <= r[0] < 73]
    monkeypatch.setattr(ngram_join, "REF", bits[0])
    monkeypatch.setattr(ngram_join, "SHORT", bits[1])
    got = rows_of(ngram_join.ngram_join(documents(spark, near)).drop("n_links"))
    assert sorted(got) == sorted(brute_components(near))


def test_ngram_borderline_similarity(spark):
    words = [f"w{i}" for i in range(24)]  # 20 shingles
    exact = words[:20] + ["x"]  # 17 shingles, 16 shared: 16 / 21
    inside = words[:22]  # 18 shingles, all shared: 18 / 20 = 0.9
    edge = words[:20]  # 16 shared of 20: exactly 0.8
    df = documents(spark, [(9, " ".join(words)), (1, " ".join(exact)), (5, " ".join(inside)), (7, " ".join(edge))])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(df).collect()}
    assert got == dict((d, c) for d, _, c in brute_components([(9, " ".join(words)), (1, " ".join(exact)), (5, " ".join(inside)), (7, " ".join(edge))]))
    assert got[9] == got[7]


def brute_links(corpus):
    sets = [shingles(t) for _, t in corpus]
    return [sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block_nodes", [1024, 4])
def test_ngram_counts_every_link(clashing, corpus, block_nodes):
    """Blocks of a group may be smaller than it, and only some of its pairs link."""
    got = rows_of(ngram_join.ngram_join(clashing, block_nodes=block_nodes))
    want = [(*row, n) for row, n in zip(brute_components(corpus), brute_links(corpus), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ngram_counts_in_chains(spark):
    """Each text links to its neighbours in the chain, not to all of its component."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 104])) for i in range(12)] + [(90, "a b c"), (91, "a b c"), (92, "")]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(documents(spark, rows), block_nodes=3).collect()}
    want = dict(zip((i for i, _ in rows), brute_links(rows), strict=True))
    assert {i: n for i, (_, n) in got.items()} == want and got[11][0] == 0 and 0 < want[0] < want[6] < 11


def test_overlaps_equal_brute_force(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "WIDE", 3)
    monkeypatch.setattr(ngram_join, "MANY", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(np.append(rng.integers(0, 12, rng.integers(0, 9)), rng.integers(100, 400, 20))).astype(np.uint64) for _ in range(40)]
    left, right = sets[:17], sets[17:]
    flat = lambda part: (np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part]), len(part))
    assert ngram_join.overlaps(*flat(left), *flat(right)).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_hashes_tell_regular_texts_apart(spark):
    """Texts whose sums modulo 2**64 agree for every multiplier."""
    import numpy as np

    from cauceda.llm.hashing import span_hashes
    from cauceda.llm.words import run_hashes, word_hashes, words

    one = "".join("ab"[x] for x in thue_morse(1024))
    other = "".join("ba"[x] for x in thue_morse(1024))
    data = np.frombuffer((one + other).encode(), np.uint8)
    for cut in (8, 16, 64, 100, 1024):
        a, b = span_hashes(data, np.array([0, 1024]), np.array([cut, 1024 + cut]))
        assert a != b
    rows = np.frombuffer(" ".join([*one, *other]).encode(), np.uint8)
    starts, ends, _ = words(rows, np.array([0, len(rows)]))
    for second in (False, True):
        runs = run_hashes(word_hashes(rows, starts, ends, second=second), 1024, second)
        assert runs[0] != runs[-1]
    spaced = [(1, " ".join(one)), (2, " ".join(other)), (3, one), (4, other)]
    got = rows_of(ngram_join.ngram_join(documents(spark, spaced)).drop("n_links"))
    assert sorted(got) == sorted(brute_components(spaced))


def test_keep_one_leaves_one_text_of_each_group(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(near)), (5, " ".join([*near[:-1], "x"])), (None, " ".join([*near, "y"])), (3, "alone here"), (None, ""), (None, None), (7, " ".join([*near, "z"])), (7, "alone too")]
    left = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(documents(spark, rows)).collect()), key=str)
    assert len(left) == 5 and sum(t is not None and t.startswith("w0 ") for _, t in left) == 1
    assert (3, "alone here") in left and (7, "alone too") in left and (None, "") in left and (None, None) in left
    assert {i for i, t in left if t and t.startswith("w0 ")} == {5}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[k] == 100 for k in range(101, 140))
    assert 0 not in found and 7 in found


def brute_substring(corpus, window=50):
    least = {}
    words = [(doc, (t or "").encode().split()) for doc, t in corpus]
    for doc, own in words:
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if doc is not None:
                least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, own in words:
        gone = set()
        for i in range(len(own) - window + 1):
            first = least.get(tuple(own[i : i + window]))
            if doc is not None and first < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("start", [25, 13, 50])
def test_substring_equals_brute_force(clashing, corpus, start):
    got = rows_of(substring_dedup.substring_dedup(clashing, start=start).select("doc_id", "n_words", "n_removed", "kept"))
    assert sorted(got, key=str) == sorted(brute_substring(corpus), key=str)


def test_substring_of_repeated_rows(spark, monkeypatch):
    """The ranges of repeated rows are written once."""
    rng = __import__("random").Random(4)
    passage = " ".join(rng.choices("abcdefghijklmnop", k=120))
    rows = [(1, passage)] + [(2, f"x {passage} y")] * 60 + [(None, passage)] * 5
    seen, real = [], substring_dedup.ranges_of
    monkeypatch.setattr(substring_dedup, "ranges_of", lambda p: seen.append(real(p)) or seen[-1])
    got = rows_of(substring_dedup.substring_dedup(documents(spark, rows)).select("doc_id", "n_words", "n_removed", "kept"))
    assert sorted(got, key=str) == sorted(brute_substring(rows), key=str)
    assert all(df.agg(F.sum(F.size("ranges"))).first()[0] < 400 for df in seen)


def test_substring_lengths_double():
    assert substring_dedup.lengths(13, 50) == [13, 26, 50]
    assert substring_dedup.lengths(25, 50) == [25, 50]
    assert substring_dedup.lengths(80, 50) == [50]


def test_substring_keeps_other_columns(docs):
    out = substring_dedup.substring_dedup(docs, keep=("lang", "text"))
    assert out.filter("n_removed = 0 AND row.text IS NOT NULL").count() > 10
    assert out.select("row.lang").distinct().count() == 1


def test_copies_of_a_row_spread_over_tasks(spark, monkeypatch):
    """Half the rows are one row: no task makes them all, and each has an ordinal of its own."""
    monkeypatch.setattr(sharding, "TASK_COPIES", 2000)
    monkeypatch.setattr(sharding, "COPIES", 100)
    rows = spark.range(20000).select(F.when(F.col("id") < 10000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 10000, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).withColumn("size", F.lit(10).cast("long"))
    parted, again = sharding.told_apart(rows)
    where = parted.filter("doc_id = 7").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(where) >= 4 and max(r["count"] for r in where) < 6000
    got = parted.filter("doc_id = 7 OR doc_id IS NULL").groupBy("doc_id").agg(F.count("*"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(3, 3, 1, 3), (10000, 10000, 1, 10000)]
    assert parted.count() == 20003 and again.count() == 2


def test_long_copies_are_made_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIED_BYTES", 100)
    rows = spark.createDataFrame([(1, "x" * 70)] * 5 + [(2, "y" * 900)] * 2 + [(3, "z")], "doc_id long, text string").withColumn("size", F.length("text").cast("long") + 1)
    parted, _ = sharding.told_apart(rows)
    assert sorted((r["doc_id"], r["ordinal"]) for r in parted.collect()) == [*((1, i) for i in range(1, 6)), (2, 1), (2, 2), (3, 1)]
