import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cauceda.llm import resample
from cauceda.llm.queries import queries
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def brute(rows, target):
    """doc_id -> n_features, weight, score, rank; ids are distinct."""
    own = {i: grams(t) for i, t in rows}
    s, t = Counter(b for _, f in own.values() for b in f), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out, order = {}, []
    for i, (n, f) in own.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = (int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        score = weight + math.floor(-1000 * math.log(-math.log(u)))
        out[i] = [len(f), weight, score, None]
        if n >= 20:
            order.append((-score, i is None, i or 0, i))
    for rank, x in enumerate(sorted(order)[: 25 * len(order) // 100], 1):
        out[x[-1]][3] = rank
    return out


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_query_equals_brute_force(spark, tmp_path, corpus, monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    rows = list({i: (i, t) for i, t in corpus}.values()) + [(900, "A" * 300 + " b " + "Ç" * 200 + "\x00x/y:Z`{|}~" * 30), (901, "..."), (902, "ONE One one")]
    target = [rows[3][1], "one two three", None, "", "漢字 Ünïcode 12"]
    documents(spark, rows).repartition(4).withColumn("weight", F.lit("x")).withColumn("score", F.lit("y")).withColumn("place", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in queries()["op13_importance_resampling"](spark, str(tmp_path)).collect()}
    assert found == brute(rows, target)


def test_a_long_text_is_hashed_alike_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcXYZ é漢09 ..--\n", k=20_000))
    n, want = grams(text)
    for piece in (7, 100, 1 << 20):
        monkeypatch.setattr(resample, "PIECE", piece)
        seen = Counter()
        data = np.frombuffer(text.encode(), np.uint8)
        words = resample.sums(data, np.array([0, len(data)]), 10_000, lambda _, one, two: seen.update(one.tolist()) or seen.update(two.tolist()))
        seen.pop(10_000)
        assert words[0] == n and seen == Counter(want)


@pytest.mark.parametrize("finish", [1, 50])
def test_the_cutoff_is_exact_at_every_place(spark, finish):
    """Ties of score, of id and of both, null ids, and partitions of very different sizes."""
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, rng.randint(-50, 50)]), rng.choice([None, 5, rng.randint(0, 60)])) for _ in range(400)] + [(1, 5)] * 200
    df = spark.createDataFrame(rows, "score long, doc_id long").repartitionByRange(5, "score").withColumn("place", F.monotonically_increasing_id())
    keys = resample.materialize(df, "test-keys")
    order = sorted((tuple(r) for r in keys.collect()), key=resample.sorting)
    for k in (1, 2, 150, 299, 300, 420, 599, 600):
        assert resample.cutoff(keys, k, finish) == order[k - 1]
        assert keys.filter(resample.up_to(order[k - 1])).count() == k
    assert resample.cutoff(keys, 0, finish) is None
    with pytest.raises(ValueError, match="fewer keys"):
        resample.cutoff(keys, 601, finish)


def test_repeated_rows_are_drawn_in_exact_number(spark, empty):
    text = " ".join(f"w{i}" for i in range(25))
    docs = documents(spark, [(4, text)] * 100 + [(None, text)] * 20 + [(5, "short")] * 3)
    target = documents(spark, [(0, "w1 w2")])
    ranks = sorted(r["rank"] for r in resample.resample(docs, target).collect() if r["rank"])
    assert ranks == list(range(1, 31))
    none = resample.resample(empty, target)
    assert none.count() == 0 and resample.resample(docs, empty).filter("rank IS NOT NULL").count() == 30
