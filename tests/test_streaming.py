"""Streams over files, run until nothing is left, against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, i % 3, T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 4, 5, 100, 101, 102, 2000, 2001, 2002, 90000])]
    batch = spark.createDataFrame(rows + rows[:2], SCHEMA)
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    return batch, spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")


def test_token_bucket(stream):
    batch, live = stream
    want = {r.event_id: r.allowed for r in stateful.token_bucket(batch.dropDuplicates(["event_id"]), "user_id", "ts", "event_id", 1.0).collect()}
    got = {r.event_id: r.allowed for r in drain(stateful.token_bucket(live.dropDuplicates(["event_id"]), "user_id", "ts", "event_id", 1.0), "bucket").collect()}
    assert got == want and want[0] and not want[3] and want[6] and want[9]


def test_debounce(stream):
    batch, live = stream
    want = {(r.user_id, r.first): r.n for r in stateful.debounced(batch, "user_id", "ts", 10_000).collect()}
    got = {(r.user_id, r.first): r.n for r in drain(stateful.debounced(live, "user_id", "ts", 10_000), "bursts").collect()}
    assert want[(0, T0)] == 3 and got.items() <= want.items() and len(got) >= len(want) - 1  # the last burst isn't over yet


def test_fresh_and_replay(stream):
    batch, live = stream
    assert stateful.fresh(batch, ["event_id"], "ts").count() == 13
    assert drain(stateful.fresh(live, ["event_id"], "ts"), "fresh").count() == 13
    assert [r.event_id for r in stateful.replay(batch, "event_id", 10).collect()] == [11, 12]
    assert drain(stateful.replay(live, "event_id", 10), "replay").count() == 2
    assert {(r.user_id, r.n) for r in stateful.monthly_usage(batch, "user_id", "ts").collect()} == {(0, 6), (1, 5), (2, 4)}


def test_publish_once(spark, stream, tmp_path):
    _, live = stream
    sent = []
    for _ in range(2):  # the second run sees the same rows anew
        each = stateful.publish_once(live, f"{tmp_path}/done", lambda df: sent.extend(r.event_id for r in df.collect()))
        q = live.writeStream.foreachBatch(each).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(sent) == list(range(13))


def test_leases(spark):
    jobs = spark.createDataFrame([(i,) for i in range(5)], "job_id int")
    rows = [(1, "claim", 0), (2, "claim", 0), (2, "heartbeat", 95), (3, "claim", 0), (3, "claim", 10), (3, "claim", 20), (4, "claim", 0), (4, "done", 5)]
    events = spark.createDataFrame([(j, k, T0 + dt.timedelta(seconds=s)) for j, k, s in rows], "job_id int, kind string, at timestamp")
    now = spark.range(1).select(F.lit(T0).cast("timestamp").cast("double").alias("x")).first().x + 100
    got = {r.job_id: (r.state, r.attempts) for r in stateful.leases(jobs, events, now, 60, 3).collect()}
    assert got == {0: ("pending", 0), 1: ("pending", 1), 2: ("leased", 1), 3: ("dead", 3), 4: ("done", 1)}


def test_caps_and_growth(spark):
    df = spark.createDataFrame([("s", i, 10, float(i * i), T0 + dt.timedelta(seconds=i)) for i in range(6)], "s string, i int, b int, v double, t timestamp")
    assert stateful.session_caps(df, "s", "i", "b", 4, 1000).count() == 4 and stateful.session_caps(df, "s", "i", "b", 10, 25).count() == 2
    assert [r.rate for r in stateful.growth(df, "s", "t", "v").orderBy("i").collect()] == [None, 1.0, 3.0, 5.0, 7.0, 9.0]
    assert stateful.expired(df, "t", T0 + dt.timedelta(seconds=2)).count() == 3
