"""Stateful stream operators, and their batch twins where the stream's answer is a relation of its input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"
DEBOUNCE_MS = 900


def debounced(events: DataFrame, key: str, at: str, quiet_ms: int = DEBOUNCE_MS, watermark: str = WATERMARK) -> DataFrame:
    """One row for each burst of a key's events, once it has been quiet: a session window, for streams and batches."""
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    burst = F.session_window(at, f"{quiet_ms} milliseconds")
    return rows.groupBy(key, burst.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("first"), "last", "n")


def fresh(events: DataFrame, keys: list[str], at: str, watermark: str = WATERMARK) -> DataFrame:
    """Events whose fingerprint wasn't there yet; a stream forgets fingerprints older than its watermark."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def replay(events: DataFrame, sequence: str, after: int) -> DataFrame:
    """What follows an id; a batch comes in order."""
    rest = events.where(F.col(sequence) > after)
    return rest if events.isStreaming else rest.orderBy(sequence)


def monthly_usage(events: DataFrame, key: str, at: str, watermark: str = WATERMARK) -> DataFrame:
    """Counts by calendar month, which is no window of fixed length."""
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    return rows.groupBy(key, F.date_trunc("month", at).alias("month")).agg(F.count("*").alias("n"))


def _take(tokens: float, last: float | None, now: float, capacity: float) -> tuple[bool, float]:
    """Whether a request passes, and the tokens left; a bucket fills at a sixtieth of its capacity a second."""
    filled = capacity if last is None else min(capacity, tokens + max(0.0, now - last) * capacity / 60)
    return (True, filled - 1) if filled >= 1 else (False, filled)


def token_bucket(events: DataFrame, key: str, at: str, id_col: str, capacity: float) -> DataFrame:
    """id and whether the key's bucket lets the event pass. Works on a stream (state per key, in order of arrival
    within a batch) and on a batch (all of a key's events in order of time, ties by id; events without a time last). A
    batch is one ordered stream for each key, read a block of rows at a time, so no key has to fit in memory."""
    schema = f"{id_col} bigint, allowed boolean"
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(at).cast("timestamp").cast("double").alias("t"), F.col(id_col).cast("long").alias(id_col))

    def later(last: float | None, t: float) -> float:
        return t if last is None else max(last, t)

    if not events.isStreaming:

        def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now: Any = ()  # no key is a tuple
            tokens, last = capacity, None
            for f in frames:
                passed = []
                for k, t in zip(f["k"], f["t"]):
                    if k != now:
                        now, tokens, last = k, capacity, None
                    ok, tokens = _take(tokens, last, t, capacity)
                    last = later(last, t)
                    passed.append(ok)
                yield pd.DataFrame({id_col: f[id_col], "allowed": passed})

        return rows.repartition("k").sortWithinPartitions("k", F.asc_nulls_last("t"), id_col).mapInPandas(ordered, schema)

    def step(_: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        every = pd.concat(list(frames)).sort_values(["t", id_col])
        passed = []
        for t in every["t"]:
            ok, tokens = _take(tokens, last, t, capacity)
            last = later(last, t)
            passed.append(ok)
        state.update((tokens, last))
        yield pd.DataFrame({id_col: every[id_col].to_numpy(), "allowed": passed})

    return rows.groupBy("k").applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def leases(jobs: DataFrame, events: DataFrame, now: float, lease_s: float, most: int, id_col: str = "job_id") -> DataFrame:
    """Jobs after a sweep: those whose lease (from their last claim or heartbeat) is over wait again, or are dead once
    they have been claimed ``most`` times."""
    seen = events.groupBy(id_col).agg(F.max(F.when(F.col("kind").isin("claim", "heartbeat"), F.col("at"))).alias("beat"), F.count_if(F.col("kind") == "claim").alias("attempts"), F.max(F.when(F.col("kind") == "done", 1).otherwise(0)).alias("done"))
    joined = jobs.join(seen, id_col, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    over = F.col("beat").cast("timestamp").cast("double") + lease_s <= now
    state = F.when(F.col("done") == 1, "done").when(F.col("beat").isNull(), "pending").when(over & (F.col("attempts") >= most), "dead").when(over, "pending").otherwise("leased")
    return joined.select(*jobs.columns, "attempts", state.alias("state"))


def expired(reservations: DataFrame, until: str, now: Any) -> DataFrame:
    """Reservations that are over."""
    return reservations.where(F.col(until) <= F.lit(now))


def session_caps(events: DataFrame, session: str, order: str, size: str, max_events: int, max_bytes: int) -> DataFrame:
    """Events within their session's caps on number and bytes, in order."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__n", F.count("*").over(w)).withColumn("__b", F.sum(size).over(w)).where((F.col("__n") <= max_events) & (F.col("__b") <= max_bytes)).drop("__n", "__b")


def publish_once(outbox: DataFrame, published: str, send: Callable[[DataFrame], None], key: str = "event_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sends rows whose key isn't in the published table yet, then adds their keys to it, so a batch
    that is run again sends nothing twice once its keys are written."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(published).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = batch.select(key).limit(0)
        new = batch.dropDuplicates([key]).join(done, key, "left_anti").persist()
        try:
            send(new)
            new.select(key).write.mode("append").parquet(published)
        finally:
            new.unpersist()

    return each


def growth(samples: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """Rate of change between neighbouring samples, in units a second."""
    w = Window.partitionBy(series).orderBy(at)
    seconds = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(w)
    return samples.withColumn("rate", F.when(seconds > 0, (F.col(value) - F.lag(value).over(w)) / seconds))
