"""Event queries: bursts, quotas, histograms and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers
from folioframe.plans.registry import query
from folioframe.session import table
from folioframe.streaming import stateful


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "session_debounce",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, each over after half an hour of quiet."""
    return stateful.debounced(_events(spark, sf_dir), "user_id", "ts", 1_800_000)


@query(
    "token_bucket",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       s AS (SELECT event_id, user_id, n, t, TRUE AS allowed, 1.0::DOUBLE AS tokens FROM e WHERE n = 1
             UNION ALL SELECT event_id, user_id, n, t, filled >= 1, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END
             FROM (SELECT e.event_id, e.user_id, e.n, e.t, least(2.0::DOUBLE, s.tokens + (e.t - s.t) * 2.0::DOUBLE / 60) AS filled FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
       SELECT event_id, allowed FROM s""",
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event passes its user's bucket of two tokens."""
    return stateful.token_bucket(_events(spark, sf_dir), "user_id", "ts", "event_id", 2.0)


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    p = lambda q: F.round(F.percentile(F.col("value").cast("double"), F.lit(q)), 6)
    return _events(spark, sf_dir).groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


EDGES = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("latency_histogram", "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {e}) AS le_{int(e)}" for e in EDGES) + ", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets, count and sum."""
    return _events(spark, sf_dir).groupBy("event_type").agg(*(F.count_if(F.col("value") <= e).alias(f"le_{int(e)}") for e in EDGES), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_dedup_replay", "SELECT DISTINCT user_id, event_type FROM events WHERE event_id > 100")
def stream_dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints that a replay from a cursor brings, each once; the same operators run on streams."""
    return stateful.fresh(stateful.replay(_events(spark, sf_dir), "event_id", 100), ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("event_tail", "SELECT event_id, event_type, user_id FROM events WHERE event_id > 500 AND event_type = 'purchase' ORDER BY event_id LIMIT 100")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after a sequence number, a hundred rows at most."""
    return _events(spark, sf_dir).where("event_id > 500 and event_type = 'purchase'").orderBy("event_id").limit(100).select("event_id", "event_type", "user_id")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_exists(props, '$.k') AS has_k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of a JSON text, and whether its key is there."""
    k = F.get_json_object("props", "$.k")
    return _events(spark, sf_dir).where(k.isNotNull()).select("event_id", k.cast("int").alias("k"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"))


@query("json_allow_list", "SELECT count(*) AS n_violations FROM events WHERE len(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'v'))) > 0")
def json_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many JSON objects have keys that aren't allowed."""
    other = F.array_except(F.json_object_keys("props"), F.array(F.lit("k"), F.lit("v")))
    return _events(spark, sf_dir).agg(F.count_if(F.size(other) > 0).alias("n_violations"))


@query("daily_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a day."""
    by = _events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return by.select(F.col("w.start").alias("day"), "event_type", "n", "mean")


@query("backoff", "SELECT event_id, CAST(pow(2, least(greatest(event_id % 12, 1) - 1, 8)) AS INT) AS wait_s FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait before each attempt."""
    return _events(spark, sf_dir).select("event_id", numbers.backoff_seconds(F.col("event_id") % 12).alias("wait_s"))


@query("expired_leases", "SELECT event_type, count(*) FILTER (ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20') AS expired, count(*) AS n FROM events GROUP BY 1")
def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases of a day that are over at an instant."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.expr("ts + interval 1 day <= timestamp '2024-01-20'")).alias("expired"), F.count("*").alias("n"))


@query("session_caps", "SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER w AS n, sum(length(props)) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n <= 20 AND b <= 150")
def session_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within their user's caps."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", F.length("props").alias("size"))
    return stateful.session_caps(rows, "user_id", "event_id", "size", 20, 150).select("event_id", "user_id")


@query("growth_rate", "SELECT event_id, round((value - lag(value) OVER w) / nullif(epoch(ts) - epoch(lag(ts) OVER w), 0), 6) + 0.0 AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each user's value, in units a second."""
    return stateful.growth(_events(spark, sf_dir), "user_id", "ts", "value").select("event_id", (F.round("rate", 6) + 0.0).alias("rate"))


@query("zipf_weights", "SELECT user_id, round(sum(1.0::DOUBLE / r) OVER (ORDER BY r) / sum(1.0::DOUBLE / r) OVER (), 9) AS cumulative FROM (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY user_id)")
def zipf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative Zipf weights of tenants by rank; a row for each tenant, so few enough to be ordered together."""
    counts = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    ranked = counts.select("user_id", (1 / F.row_number().over(Window.orderBy(F.desc("n"), "user_id"))).alias("w"))
    upto = Window.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select("user_id", F.round(F.sum("w").over(upto) / F.sum("w").over(Window.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 9).alias("cumulative"))


@query("tenant_buckets", "SELECT user_id, CAST(('0x' || left(sha256(CAST(user_id AS VARCHAR)), 8))::BIGINT % 16 AS INT) AS bucket FROM (SELECT DISTINCT user_id FROM events)")
def tenant_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable bucket for each tenant."""
    return _events(spark, sf_dir).select("user_id").distinct().select("user_id", numbers.tenant_bucket(F.col("user_id").cast("string")).cast("int").alias("bucket"))
