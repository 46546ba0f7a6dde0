"""Version queries: orders of a customer stand for the versions of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.operators import versions
from folioframe.plans.registry import query
from folioframe.session import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(
    "asof_version",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each document in effect at an instant."""
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate")
    return versions.as_of(rows, "o_custkey", "o_orderdate", F.lit("1996-06-30").cast("timestamp"), "o_orderkey")


@query(
    "asof_join",
    """WITH p AS (SELECT l_orderkey, l_linenumber, o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
       v AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
       SELECT p.l_orderkey, p.l_linenumber, coalesce(v.o_orderkey, -1) AS version_o_orderkey FROM p ASOF LEFT JOIN v ON p.o_custkey = v.o_custkey AND p.l_shipdate >= v.o_orderdate""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every returned line its customer's latest order when it shipped."""
    orders = _orders(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_shipdate")
    points = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return versions.as_of_join(points, orders, "o_custkey", "l_shipdate", "o_orderdate", "o_orderkey", ["o_orderkey"]).select("l_orderkey", "l_linenumber", F.coalesce("version_o_orderkey", F.lit(-1)).alias("version_o_orderkey"))


@query(
    "interval_conflicts",
    """WITH c AS (SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INT)) AS e, l_returnflag AS v FROM lineitem)
       SELECT a.l_partkey, a.id AS a_id, b.id AS b_id FROM c a JOIN c b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.id < b.id AND a.s < b.e AND b.s < a.e AND a.v IS DISTINCT FROM b.v""",
)
def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one subject that hold at the same time and disagree."""
    claims = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("s"), F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int))").alias("e"), F.col("l_returnflag").alias("v"))
    return versions.interval_conflicts(claims, ["l_partkey", "l_suppkey"], "s", "e", "v", "id").select("l_partkey", "a_id", "b_id")


@query(
    "scd2_publish",
    """SELECT o_orderkey, o_orderdate AS effective_from, lead(o_orderdate) OVER w AS effective_to, lead(o_orderkey) OVER w IS NULL AS is_current
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def scd2_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication: each version ends when the next begins."""
    done = versions.published(_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    return done.select("o_orderkey", F.col("o_orderdate").alias("effective_from"), "effective_to", "is_current")


@query(
    "version_invariants",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_current FROM orders GROUP BY 1
       HAVING count(*) FILTER (o_orderstatus = 'O') <> 1 OR count(*) FILTER (o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-01-01') > 0""",
)
def version_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that break the rule of one current version."""
    rows = _orders(spark, sf_dir).select("o_custkey", (F.col("o_orderstatus") == "O").alias("cur"), "o_orderdate", F.lit(None).cast("timestamp").alias("until"))
    return versions.invariant_violations(rows, "o_custkey", "cur", "o_orderdate", "until", F.lit("1998-01-01").cast("timestamp")).select("o_custkey", "n_current")


@query(
    "version_compare",
    """WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
       SELECT a.o_custkey, a.o_orderkey AS new_key, b.o_orderkey AS old_key, round(a.o_totalprice - b.o_totalprice, 2) AS delta FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.r = 1 AND b.r = 2""",
)
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version against the one before it."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("r"), F.lead("o_orderkey").over(w).alias("old_key"), F.lead("o_totalprice").over(w).alias("old"))
    return rows.where("r = 1 and old_key is not null").select("o_custkey", F.col("o_orderkey").alias("new_key"), "old_key", F.round(F.col("o_totalprice") - F.col("old"), 2).alias("delta"))


@query(
    "version_history",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders""",
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all documents, numbered."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return _orders(spark, sf_dir).select("o_custkey", "o_orderkey", number.alias("version_number"))


@query(
    "lineage_check",
    """SELECT a.l_orderkey, count(DISTINCT a.l_suppkey) = 2 AS two_versions FROM lineitem a WHERE l_linenumber <= 2 GROUP BY 1 HAVING count(*) = 2""",
)
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two versions named together differ, one group for each pair."""
    pairs = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.min("l_suppkey") != F.max("l_suppkey")).alias("two_versions"))
    return pairs.where("n = 2").select("l_orderkey", "two_versions")


@query(
    "conflict_status",
    """WITH s AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'O') AS opened, max(o_orderdate) FILTER (o_orderstatus = 'F') AS resolved FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1)
       SELECT o_custkey, CASE WHEN opened IS NULL THEN 'none' WHEN resolved >= opened THEN 'resolved' ELSE 'open' END AS status FROM s""",
)
def conflict_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conflict's state at an instant: open from its detection until its resolution."""
    date = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    states = _orders(spark, sf_dir).where("o_orderdate <= timestamp '1997-01-01'").groupBy("o_custkey").agg(date("O").alias("opened"), date("F").alias("resolved"))
    return states.select("o_custkey", F.when(F.col("opened").isNull(), "none").when(F.col("resolved") >= F.col("opened"), "resolved").otherwise("open").alias("status"))


@query(
    "lifecycle",
    """WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'published' WHEN 'view' THEN 'indexed' ELSE 'archived' END AS old, CASE WHEN event_id % 2 = 0 THEN 'archived' ELSE 'published' END AS new FROM events)
       SELECT old, new, (old, new) IN (('indexed', 'published'), ('published', 'archived')) AS allowed, count(*) AS n FROM s GROUP BY 1, 2, 3""",
)
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state against the table of what may follow what."""
    old = F.when(F.col("event_type") == "click", "published").when(F.col("event_type") == "view", "indexed").otherwise("archived")
    rows = table(spark, sf_dir, "events").select(old.alias("old"), F.when(F.col("event_id") % 2 == 0, "archived").otherwise("published").alias("new"))
    return rows.groupBy("old", "new", versions.allowed_transition(F.col("old"), F.col("new")).alias("allowed")).agg(F.count("*").alias("n"))
