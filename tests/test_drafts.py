import datetime as dt
import random

from cauceda.streaming import drafts
from cauceda.streaming.drafts import DAY, HOUR, Rules

EPOCH = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
ZERO = int(EPOCH.timestamp() * 1000)


def made(spark, rows):
    """rows: sender, message, kind, milliseconds from the epoch of the test."""
    given = [(s, m, k, EPOCH + dt.timedelta(milliseconds=t), i) for i, (s, m, k, t) in enumerate(rows)]
    return spark.createDataFrame(given, "who string, what string, kind string, ts timestamp, n long")


def outcomes(df):
    return sorted((r["sender"], r["message"], r["at"] - ZERO, r["outcome"]) for r in df.collect())


def folded(spark, rows, rules, until=None):
    events = drafts.events_of(made(spark, rows), "who", "what", "kind", "ts", "n")
    return outcomes(drafts.settle(events, rules, None if until is None else ZERO + until))


def test_a_draft_is_sent_once_in_time(spark):
    rows = [("a", "m", "confirm", 0), ("a", "m", "draft", 1), ("a", "m", "draft", 2), ("a", "m", "confirm", 3), ("a", "m", "confirm", 4), ("b", "m", "draft", 5), ("b", "m", "confirm", 106), (None, "m", "draft", 1), ("a", None, "draft", 1)]
    assert folded(spark, rows, Rules(100)) == sorted([("a", "m", 0, "unknown"), ("a", "m", 1, "drafted"), ("a", "m", 2, "repeated"), ("a", "m", 3, "sent"), ("a", "m", 4, "repeated"), ("b", "m", 5, "drafted"), ("b", "m", 105, "lapsed"), ("b", "m", 106, "unknown")])
    assert folded(spark, [("b", "m", "draft", 5), ("b", "m", "confirm", 105)], Rules(100), until=10_000) == [("b", "m", 5, "drafted"), ("b", "m", 105, "sent")]
    assert folded(spark, [], Rules(100), until=5) == []


def test_quotas_hold_back_and_may_be_tried_again(spark):
    rows = [("a", f"m{i}", "draft", i) for i in range(5)] + [("a", f"m{i}", "confirm", 10 + i) for i in range(5)]
    rows += [("a", "m2", "confirm", 10 + HOUR), ("a", "m3", "confirm", 11 + HOUR), ("a", "m3", "confirm", 10 + DAY), ("a", "m4", "confirm", 11 + DAY)]
    got = [x[3] for x in sorted(folded(spark, rows, Rules(2 * DAY, hourly=2, daily=3)), key=lambda x: x[2])]
    assert got == ["drafted"] * 5 + ["sent", "sent", "hour", "hour", "hour", "sent", "day", "sent", "sent"]


def test_the_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((f"s{rng.randrange(4)}", f"m{rng.randrange(6)}", rng.choice(["draft", "confirm", "confirm"]), rng.randrange(200) * 60_000) for _ in range(240)), key=lambda r: r[3])
    rules, parts = Rules(20 * 60_000, hourly=3, daily=9), [rows[:90], rows[90:170], rows[170:]]
    last = rows[-1][3]
    for i, part in enumerate([*parts, [("late", "end", "draft", last + 3 * HOUR)], [("late", "end", "confirm", last + 3 * HOUR + 1)]]):
        offset = sum(len(p) for p in parts[:i])
        df = made(spark, part)
        df.selectExpr("who", "what", "kind", "ts", f"n + {offset} AS n").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    schema = spark.read.parquet(str(tmp_path / "events")).schema
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "events"))
        events = drafts.events_of(stream, "who", "what", "kind", "ts", "n")
        query = drafts.settle_stream(events, rules, "0 seconds").writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = [x for x in outcomes(spark.table("settled")) if x[0] != "late"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == folded(spark, rows, rules, until=last + 2 * HOUR) and {x[3] for x in got} >= {"sent", "lapsed", "hour", "repeated", "unknown"}
