import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cauceda.llm import language_id, toxicity
from cauceda.llm.common import crc_of_id

SOUNDS = {"aa": "the and ing thor wel", "bb": "der ung schen ß ich", "cc": "que ción os ado ñ"}


def made(rng, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(i, made(rng, lang := rng.choice(list(SOUNDS)), rng.randint(3, 60)), lang) for i in range(600)]
    rows += [(600, None, "aa"), (601, "12 34 !!", "bb"), (602, "", "cc"), (603, made(rng, "aa", 5), None), (None, made(rng, "bb", 9), "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_are_told_apart(labelled):
    held_out = crc_of_id("doc_id") % 4 == 2
    model = language_id.fit(labelled.filter(~held_out), sample=300, epochs=4)
    assert model.languages == ["aa", "bb", "cc"]
    out = language_id.identify(labelled, model).join(labelled.select("doc_id", "lang", "text", held_out.alias("h")), "doc_id").collect()
    own = [r for r in out if r["h"] and r["doc_id"] < 600]
    assert sum(r["lang_pred"] == r["lang"] for r in own) >= 0.95 * len(own) > 50
    odd = {r["doc_id"]: r for r in out if r["doc_id"] in (600, 601, 602)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in odd.values())
    assert all(0 <= r["score"] <= 1 for r in out)


def test_languages_without_labels_or_rows(spark, labelled, empty):
    assert language_id.fit(labelled.filter("lang = 'none'")) is None
    assert {r["lang_pred"] for r in language_id.identify(labelled, None).collect()} == {"und"}
    assert language_id.identify(empty, None).count() == 0


def test_repeated_long_and_clashing_rows_are_bounded(spark, labelled):
    """Rows of one id count once, the sample is bounded in bytes, other columns change nothing, very long texts are read whole."""
    again = labelled.unionByName(spark.createDataFrame([(7, "x" * 50, "bb")] * 500 + [(601, "und ich " * 200_000, "bb")], labelled.schema))
    again = again.withColumns({c: F.lit("x") for c in ("own", "label", "ids", "draw", "size", "held", "score")})
    model = language_id.fit(again, sample=300, sample_bytes=100_000, epochs=4)
    assert model.languages == ["aa", "bb", "cc"]
    out = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(again, model).collect()}
    assert (601, "bb") in out and sum(i == 7 for i, _ in out) <= 2


def test_subwords_stay_inside_their_text():
    data = np.frombuffer(b"abcdab", np.uint8)
    got = language_id.subwords(data, np.array([0, 4, 6]), 3, 1 << 10)
    assert (got < 1024).tolist() == [True, True, False, False, False, False]
    again = language_id.subwords(np.frombuffer(b"xxabcd", np.uint8), np.array([0, 2, 6]), 3, 1 << 10)
    assert got[:2].tolist() == again[2:4].tolist()


def test_batched_scores_equal_one_by_one(labelled):
    import pyarrow as pa

    model = language_id.fit(labelled, sample=200, epochs=2)
    texts = [r["text"] for r in labelled.limit(40).collect()]
    many = model.predict(*language_id.lowered(pa.array(texts)))
    one = [model.predict(*language_id.lowered(pa.array([t]))) for t in texts]
    assert many[0].tolist() == [int(x[0][0]) for x in one]
    assert np.allclose(many[1], [x[1][0] for x in one])


def test_a_long_text_drawn_first_leaves_the_model_learned(spark, labelled):
    """Whatever its draw, a row larger than the whole bound does not empty the sample."""
    long = labelled.filter("lang = 'aa'").limit(1).selectExpr("*").withColumn("text", F.repeat("text", 4000))
    for seed in range(3):
        own = long.select(*(F.lit(-k).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in labelled.columns for k in (1,)))
        model = language_id.fit(labelled.unionByName(own), sample=300, sample_bytes=200_000, epochs=2, seed=seed)
        assert model is not None and model.languages == ["aa", "bb", "cc"]


def test_scores_do_not_depend_on_the_step(labelled, monkeypatch):
    texts = [r["text"] for r in labelled.limit(20).collect()] + ["", "ab", "é" * 50, None, "abc"]
    model = language_id.fit(labelled, sample=200, epochs=2)
    given = language_id.lowered(pa.array(texts, pa.string()))
    whole = model.logits(*given)
    one = np.frombuffer(texts[0].encode(), np.uint8)
    counts = [x.tolist() for x in language_id.bucket_counts(one, 1 << 10)]
    for step in (5, 64):
        monkeypatch.setattr(language_id, "STEP", step)
        assert np.allclose(model.logits(*given), whole, atol=1e-6)
        own, n = language_id.bucket_counts(one, 1 << 10)
        inside = own < 1 << 10
        assert [own[inside].tolist(), n[inside].tolist()] == [[b for b in counts[0] if b < 1 << 10], [c for b, c in zip(*counts, strict=True) if b < 1 << 10]]


def test_a_very_long_text_takes_linear_time_and_bounded_memory():
    """32 MB: a table row of 8 languages for every byte would take a gigabyte."""
    import tracemalloc

    model = language_id.Model(list("abcdefgh"), np.zeros(((1 << 10) + 1, 8), np.float32), np.zeros(8), 1.0, 0.0)
    data = np.frombuffer(b"lorem ipsum " * 2_800_000, np.uint8)
    tracemalloc.start()
    model.logits(data, np.array([0, len(data)]))
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    lexicon = toxicity.Lexicon({"bad": 1.0}, {})
    text = "you bad one two three four five six " * 40_000
    assert lexicon.features(text)[8] == 40_000  # nearness: each is next to its own


def test_nearness_is_that_of_all_pairs():
    import random

    rng, lexicon = random.Random(1), toxicity.Lexicon({"bad": 1.0}, {})
    for _ in range(200):
        words = rng.choices(["bad", "you", "x", "y", "z", "w"], weights=[1, 1, 4, 4, 4, 4], k=rng.randint(1, 60))
        bad, you = ([i for i, w in enumerate(words) if w == k] for k in ("bad", "you"))
        assert lexicon.features(" ".join(words))[8] == sum(any(abs(i - j) <= 5 for j in you) for i in bad)


def test_rejection_threshold_reaches_its_precision():
    model = language_id.Model(["a", "b"], np.zeros((3, 2)), np.zeros(2), 1.0, 0.0)
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 500)
    logits = np.stack([labels == 0, labels == 1], 1) * 2.0 + rng.normal(0, 1.5, (500, 2))
    model = language_id.calibrate(model, logits, labels, 0.95)
    chance = language_id.softmax(logits / model.temperature)
    kept = chance.max(1) >= model.threshold
    assert (chance.argmax(1) == labels)[kept].mean() >= 0.95 and 0 < kept.mean() < 1


@pytest.fixture(scope="module")
def comments(spark):
    rng = random.Random(8)
    clean = ["tree", "river", "stone", "light", "paper", "cloud", "bread", "water", "green", "quiet"]
    mean = ["florp", "grusket", "snarvle"]
    rows, labels = [], []
    for i in range(1500):
        words = rng.choices(clean, k=rng.randint(5, 80))
        if i % 8 == 0:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(mean) + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    rows += [(2000, None), (2001, ""), (None, "florp florp grusket you")]
    labels += [(2000, 0), (3, None), (None, 1), (16, 0), (5000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_score_higher(comments):
    docs, labels = comments
    held_out = crc_of_id("doc_id") % 5 == 0
    model = toxicity.fit(docs, labels.filter(~held_out))
    assert {"flor", "grus"} <= {s[:4] for s in (*model.lexicon.stems, *model.lexicon.words)}
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    own = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    toxic = [r["score"] for r in own if r["doc_id"] % 8 == 0]
    clean = [r["score"] for r in own if r["doc_id"] % 8]
    assert np.mean([s >= 0.5 for s in toxic]) >= 0.95 and np.mean([s >= 0.5 for s in clean]) <= 0.02
    kept = toxicity.keep_clean(docs.withColumn("x", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "x"] and kept.filter("doc_id IN (2000, 2001)").count() == 2
    assert kept.filter("doc_id IS NULL").count() == 0


def test_toxicity_of_repeated_long_and_clashing_rows(spark, comments):
    docs, labels = comments
    odd = spark.createDataFrame([(5, "tree")] * 400 + [(3000, "river " * 200_000), (3001, "river stone " * 50_000 + "florp grusket you florp snarvle")], docs.schema)
    every = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("label", "draw", "sketch", "x", "term", "score")})
    model = toxicity.fit(every, labels.unionByName(spark.createDataFrame([(5, 0)] * 50, labels.schema)))
    out = toxicity.score(every, model)
    assert out.count() == every.count() and out.filter("doc_id = 3000 AND score >= 0.5").isEmpty()
    kept = toxicity.keep_clean(every, model)
    assert kept.columns == every.columns and kept.filter("doc_id = 5").count() == 401


def test_without_labels_nothing_is_toxic(comments, empty):
    docs, labels = comments
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty, None).count() == 0


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    raw = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    at, value = toxicity.isotonic(raw, y)
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()
    # brute force: the minimax form of isotonic regression
    want = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert len(np.unique(np.round(want, 9))) == len(at)


def test_obfuscated_words_are_recognised():
    own = toxicity.Lexicon(words={"florp": 3.0}, stems={})
    seen = dict(zip(toxicity.FEATURES, own.features("F10rp fl0rp flooorp f.l.o.r.p YOU ok!"), strict=True))
    assert seen["uncovered"] == 3 and seen["obfuscated"] > 0 and seen["exclaims"] > 0 and seen["you_per_100"] > 0
    assert own.features("")[0] == 1
