"""Relational queries: joins, aggregates, set operations, pages and queues over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import numbers, text
from folioframe.plans.registry import query
from folioframe.session import table


@query(
    "acl_visible",
    """
    WITH grants AS (
      SELECT c_custkey AS principal, c_nationkey AS collection FROM customer
      UNION SELECT c.c_custkey, n2.n_nationkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
            JOIN nation n2 ON n.n_regionkey = n2.n_regionkey WHERE c.c_mktsegment = 'BUILDING'
      UNION SELECT c_custkey, n_nationkey FROM customer, nation WHERE c_acctbal > 9000)
    SELECT s.s_suppkey, count(*) AS n_principals FROM supplier s JOIN grants g ON s.s_nationkey = g.collection GROUP BY s.s_suppkey""",
)
def acl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many principals may see each supplier: owners of its collection, members of its group, and those of high
    rank. The three kinds of grant are a union, so no disjunction stands in a join."""
    customer, nation, supplier = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    own = customer.select(F.col("c_custkey").alias("principal"), F.col("c_nationkey").alias("collection"))
    region = nation.select("n_regionkey", F.col("n_nationkey").alias("collection"))
    group = customer.where("c_mktsegment = 'BUILDING'").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey").join(region, "n_regionkey").select(F.col("c_custkey").alias("principal"), "collection")
    every = nation.agg(F.collect_set("n_nationkey").alias("collections"))  # the nations are a fixed, short list
    ranked = customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("principal")).join(F.broadcast(every)).select("principal", F.explode("collections").alias("collection"))
    grants = own.union(group).union(ranked).distinct()
    by_collection = grants.groupBy("collection").agg(F.count("*").alias("n_principals"))
    return supplier.join(by_collection, F.col("s_nationkey") == F.col("collection")).select("s_suppkey", "n_principals")


@query(
    "visible_orders",
    """SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_custkey = o.o_custkey AND r.r_name = 'EUROPE')""",
)
def visible_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join through three tables: orders whose customer lies in a scope."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    scope = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    return table(spark, sf_dir, "orders").join(scope, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("orphan_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join: parts that no large line reserves."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(
    "tenant_join",
    """SELECT n.n_name, r.r_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation n ON c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""",
)
def tenant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join of lines, orders, customers and their places. Lines are summed by order's customer key first, so the
    wide join carries a row for each order only."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "r_name").agg(F.sum("n").alias("n_lines"), F.round(F.sum("r"), 2).alias("revenue"))


@query(
    "left_hydrate",
    """SELECT o.o_orderkey, coalesce(a.n, 0) AS n_returned, coalesce(a.first_ship, o.o_orderdate) AS at FROM orders o
       LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_orderkey = o.o_orderkey""",
)
def left_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to an optional artifact, with defaults where there is none."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"))
    joined = table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_returned"), F.coalesce("first_ship", "o_orderdate").alias("at"))


@query(
    "inventory_drift",
    """WITH e AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 7 <> 0),
            a AS (SELECT l_partkey AS k, CAST(max(l_quantity) AS INT) AS v FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)
       SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'orphan' WHEN e.v <> a.v THEN 'stale' ELSE 'ok' END AS state
       FROM e FULL JOIN a ON e.k = a.k""",
)
def inventory_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against listed keys, both ways, with the kind of difference."""
    expected = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("e"))
    listed = table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").cast("int").alias("a"))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "orphan").when(F.col("e") != F.col("a"), "stale").otherwise("ok")
    return expected.join(listed, "k", "full_outer").select("k", state.alias("state"))


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000 and c_nationkey % 3 <> 0").select(F.col("c_nationkey").alias("k"))
    near = table(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 0").select(F.col("s_nationkey").alias("k"))
    return rich, near


_A = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 AND c_nationkey % 3 <> 0"
_B = "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey % 4 <> 0"


@query("set_union", f"{_A} UNION {_B}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


@query("set_union_all", f"SELECT k, count(*) AS n FROM ({_A} UNION ALL {_B}) GROUP BY k")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionByName(b).groupBy("k").agg(F.count("*").alias("n"))


@query("set_intersect", f"{_A} INTERSECT {_B}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query("set_difference", f"{_A} EXCEPT {_B}")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.subtract(b)


@query(
    "scope_decision",
    f"""WITH a AS (SELECT DISTINCT k FROM ({_A})), b AS (SELECT DISTINCT k FROM ({_B}))
       SELECT (SELECT count(*) FROM a) = 0 OR (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) > 0 AS denied,
              (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS n_allowed""",
)
def scope_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested scope is denied if it is empty or holds anything that isn't allowed."""
    a, b = _nations(spark, sf_dir)
    marked = a.distinct().join(b.distinct().withColumn("ok", F.lit(True)), "k", "left")
    return marked.agg(((F.count("*") == 0) | (F.count_if(F.col("ok").isNull()) > 0)).alias("denied"), F.count("ok").alias("n_allowed"))


@query(
    "keyset_page",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor, newest first, and one row more that tells whether another page follows."""
    at, key = F.lit("1997-01-01").cast("timestamp"), F.lit(1000)
    after = (F.col("o_orderdate") < at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") < key))
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") <= at) & after)  # the first term reaches the scan
    return orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(51).select("o_orderkey", "o_orderdate")


@query(
    "batch_completion",
    """SELECT l_orderkey, count(*) > 0 AND bool_and(l_linestatus = 'F') AS complete, count(*) FILTER (l_returnflag = 'R') AS n_returned,
              coalesce(min(l_linenumber) FILTER (l_linestatus = 'O'), 0) AS first_open FROM lineitem GROUP BY l_orderkey""",
)
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all lines of an order are final, with conditional aggregates."""
    open_ = F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("count(*) > 0 and bool_and(l_linestatus = 'F')").alias("complete"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.coalesce(F.min(open_), F.lit(0)).alias("first_open"))


@query("listed_segments", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def listed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered list of distinct values as text; a handful of segments for each nation."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ", ").alias("segments"))


@query(
    "next_ordinal",
    """SELECT o_custkey, o_orderkey, coalesce((SELECT max(o2.o_orderkey) FROM orders o2 WHERE o2.o_orderdate < TIMESTAMP '1995-01-01'), 0)
              + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def next_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals for new rows after the greatest in use."""
    orders = table(spark, sf_dir, "orders")
    last = orders.where("o_orderdate < timestamp '1995-01-01'").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("last"))  # one row
    new = orders.where("o_orderdate >= timestamp '1998-01-01'").join(F.broadcast(last))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return new.select("o_custkey", "o_orderkey", (F.col("last") + rank).alias("ordinal"))


@query(
    "best_per_group",
    """SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS best FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each group, ties by id: an aggregate that combines on the map side, not a sort of each group."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("x"))
    return best.select("o_custkey", (-F.col("x.k")).alias("o_orderkey"), F.round("x.o_totalprice", 2).alias("best"))


@query(
    "dominant_value",
    """SELECT o_custkey, o_orderpriority AS dominant FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""",
)
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of a group, ties by name."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderpriority"))
    return counts.withColumn("r", first).where("r = 1").select("o_custkey", F.col("o_orderpriority").alias("dominant"))


@query(
    "quota_usage",
    """SELECT c_custkey, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2), 0) AS open_usage, count(o_orderkey) AS n_orders,
              greatest(500000 - coalesce(round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2), 0), 0) AS remaining
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage against a limit: null sums are zero, what remains is never negative."""
    used = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))), 2).alias("u"), F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left")
    open_ = F.coalesce("u", F.lit(0.0))
    return joined.select("c_custkey", open_.alias("open_usage"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.greatest(F.lit(500000) - open_, F.lit(0.0)).alias("remaining"))


@query(
    "quota_drift",
    """WITH counter AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1), actual AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1)
       SELECT k, counter.v AS was, coalesce(actual.v, 0) AS now FROM counter LEFT JOIN actual USING (k) WHERE counter.v <> coalesce(actual.v, 0)""",
)
def quota_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that differ from what is there; tenants without a counter are skipped."""
    both = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderkey") % 10 != 3).alias("was"), F.count("*").alias("now"))
    return both.where("was > 0 and was <> now")


@query(
    "queue_stats",
    """SELECT event_type AS job_type, count(*) FILTER (event_id % 3 = 0) AS pending,
              CAST(floor(epoch(max(ts))) - floor(epoch(min(ts) FILTER (event_id % 3 = 0))) AS BIGINT) AS oldest_age_s FROM events GROUP BY 1""",
)
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and oldest age of each queue."""
    pending = F.col("event_id") % 3 == 0
    age = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min(F.when(pending, F.col("ts"))))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("job_type")).agg(F.count_if(pending).alias("pending"), age.alias("oldest_age_s"))


@query(
    "queue_claim",
    "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 25",
)
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next jobs in queue order. A claim's lock isn't Spark's to take: one writer claims."""
    return table(spark, sf_dir, "events").where("event_type = 'click'").orderBy("ts", "event_id").limit(25).select("event_id", "user_id")


@query(
    "fair_rotation",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events""",
)
def fair_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over tenants: everyone's first job before anyone's second. The order is (turn, tenant)."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", turn.alias("turn"))


@query(
    "role_catalog",
    """SELECT r.role, p.permission FROM (VALUES ('owner', 3), ('editor', 2), ('viewer', 1)) r(role, rank), (VALUES ('read', 1), ('write', 2), ('admin', 3)) p(permission, needs) WHERE r.rank >= p.needs""",
)
def role_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and what they permit, from two constant lists."""
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(n).alias("rank")) for r, n in (("owner", 3), ("editor", 2), ("viewer", 1)))))
    permissions = F.explode(F.array(*(F.struct(F.lit(p).alias("permission"), F.lit(n).alias("needs")) for p, n in (("read", 1), ("write", 2), ("admin", 3)))))
    both = spark.range(1).select(roles.alias("r")).select("r", permissions.alias("p"))
    return both.where("r.rank >= p.needs").select("r.role", "p.permission")


@query(
    "dormant_grants",
    """SELECT c_mktsegment, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ', ' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') GROUP BY 1""",
)
def dormant_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where customers without a late order are, by segment."""
    late = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '1998-01-01'")
    idle = table(spark, sf_dir, "customer").join(late.select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.array_join(F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))), ", ").alias("nations"))


@query(
    "generation_consistency",
    """SELECT n_regionkey, bool_and(coalesce(ok, FALSE)) AS consistent FROM nation LEFT JOIN (SELECT s_nationkey, max(s_acctbal) > 0 AS ok FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1""",
)
def generation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group is consistent if each of its members has a right signature."""
    right = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.max("s_acctbal") > 0).alias("ok"))
    joined = table(spark, sf_dir, "nation").join(right, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.groupBy("n_regionkey").agg(F.expr("bool_and(coalesce(ok, false))").alias("consistent"))


@query(
    "missing_fingerprint",
    """SELECT l_orderkey, left(sha256(string_agg(CAST(l_linenumber AS VARCHAR), chr(0) ORDER BY CAST(l_linenumber AS VARCHAR))), 32) AS fingerprint FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def missing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the sorted ids of a group."""
    from folioframe.functions.identity import fingerprint

    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(fingerprint(F.collect_list(F.col("l_linenumber").cast("string"))).alias("fingerprint"))


@query(
    "range_cover",
    """SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber BETWEEN 5 AND 7 AND l_quantity < 3""",
)
def range_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose range covers a missing ordinal."""
    return table(spark, sf_dir, "lineitem").where("l_linenumber between 5 and 7 and l_quantity < 3").select("l_orderkey").distinct()


@query(
    "idempotent_insert",
    """SELECT k, min(src) AS src FROM (SELECT o_custkey AS k, 'existing' AS src FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT c_custkey, 'new' FROM customer) GROUP BY k""",
)
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows where the key is free, and the rows that were there already."""
    there = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(there, "k", "left_anti")
    return there.withColumn("src", F.lit("existing")).unionByName(new.distinct().withColumn("src", F.lit("new")))


@query(
    "counter_upsert",
    """SELECT k, coalesce(n.v, o.v) AS v FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1) o
       FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1) n USING (k)""",
)
def counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters overwritten by new values, added where there were none."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < timestamp '1995-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("o"))
    new = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return old.join(new, "k", "full_outer").select("k", F.coalesce("n", "o").alias("v"))


@query("csv_guard", r"""SELECT p_partkey, CASE WHEN regexp_matches(c, '^\s*[=+\-@]') THEN '''' || c ELSE c END AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '=' || p_name ELSE p_name END AS c FROM part)""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells made safe for spreadsheets."""
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.csv_guard(cell).alias("cell"))


@query("month_usage", "SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS period_start, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS period_end, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def month_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by calendar month."""
    by = table(spark, sf_dir, "events").groupBy("user_id", numbers.month_start(F.col("ts")).alias("period_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.withColumn("period_end", numbers.month_end(F.col("period_start")))


@query("label_cap", "SELECT CASE WHEN r <= 128 THEN label ELSE 'other' END AS label, sum(n)::BIGINT AS n FROM (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS r FROM (SELECT CAST(user_id AS VARCHAR) AS label, count(*) AS n FROM events GROUP BY 1)) GROUP BY 1")
def label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 128 label values by count; the others fold into one."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("label")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "label").limit(128).select("label", F.lit(True).alias("top"))  # the cap is the feature
    named = counts.join(F.broadcast(top), "label", "left").select(F.when(F.col("top"), F.col("label")).otherwise("other").alias("label"), "n")
    return named.groupBy("label").agg(F.sum("n").alias("n"))


@query(
    "null_safe_changes",
    """SELECT a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE nullif(a.o_orderstatus, 'P') IS DISTINCT FROM nullif(b.o_orderpriority, '1-URGENT')
       AND nullif(a.o_orderstatus, 'P') IS NOT DISTINCT FROM nullif(b.o_orderstatus, 'P')""",
)
def null_safe_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons in which null equals null."""
    null_if = lambda c, v: F.when(F.col(c) != v, F.col(c))
    status, priority = null_if("o_orderstatus", "P"), null_if("o_orderpriority", "1-URGENT")
    return table(spark, sf_dir, "orders").where(~status.eqNullSafe(priority) & status.eqNullSafe(status)).select("o_orderkey")
