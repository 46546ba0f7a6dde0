"""Administrative queries: access, quotas, reconciliation, jobs and generations, with the star schema in their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import identity, numbers, text
from folioframe.operators import markdown, pages, service
from folioframe.plans.registry import query
from folioframe.session import table

_AT = "TIMESTAMP '1997-01-01'"


def _at() -> F.Column:
    return F.lit("1997-01-01").cast("timestamp")


@query("collection_access", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000 OR s_suppkey = 7 OR EXISTS (SELECT 1 FROM part WHERE p_size = s_suppkey % 60 AND p_brand = 'Brand#11')")
def collection_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections that are open, owned, or granted."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("collection_id"), F.when(F.col("s_acctbal") > 8000, "org").otherwise("private").alias("visibility"), F.col("s_suppkey").cast("string").alias("owner_id"))
    sizes = table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select("p_size").distinct()
    g = c.join(sizes, F.col("collection_id") % 60 == F.col("p_size"), "left_semi").select("collection_id", F.lit("g").alias("principal_id"), F.lit("read").alias("access_level"))
    return service.visible(c, g, ["g"], "7").select(F.col("collection_id").alias("s_suppkey"))


@query("access_ranks", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 0 END AS rank FROM customer")
def access_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants as numbers that can be compared."""
    level = F.when(F.col("c_mktsegment") == "BUILDING", "read").when(F.col("c_mktsegment") == "MACHINERY", "write").when(F.col("c_mktsegment") == "AUTOMOBILE", "admin").otherwise("none")
    return table(spark, sf_dir, "customer").select("c_custkey", service.access_rank(level).alias("rank"))


@query("explicit_versions", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def explicit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of named versions."""
    return service.narrowed(table(spark, sf_dir, "orders"), ["1-URGENT", "2-HIGH"], version="o_orderpriority").select("o_orderkey")


@query("no_versions", "SELECT o_orderkey FROM orders WHERE FALSE")
def no_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list of versions names no row."""
    return service.narrowed(table(spark, sf_dir, "orders"), [], version="o_orderpriority").select("o_orderkey")


@query("authorised_hydrate", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'")
def authorised_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates joined to their authoritative rows; what may not be seen falls away."""
    hits = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    out = service.authorised(hits, table(spark, sf_dir, "orders"), "o_orderkey", o_orderstatus=["O", "P"], o_orderpriority="1-URGENT")
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey")


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("org_id"), F.col("o_totalprice").cast("long").alias("amount"), F.when(F.col("o_orderstatus") == "O", "reserved").otherwise("done").alias("state"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    limits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), F.lit(1_500_000).cast("long").alias("limit"))
    return service.quota(limits, orders.where("state = 'done'"), orders, _at())


_Q = f"""q AS (SELECT c_custkey AS org_id, 1500000 AS "limit", coalesce(c, 0)::BIGINT AS committed, coalesce(r, 0)::BIGINT AS reserved, greatest(1500000 - coalesce(c, 0) - coalesce(r, 0), 0)::BIGINT AS remaining FROM customer
       LEFT JOIN (SELECT o_custkey, sum(trunc(o_totalprice)::BIGINT) FILTER (o_orderstatus <> 'O') AS c, sum(trunc(o_totalprice)::BIGINT) FILTER (o_orderstatus = 'O' AND o_orderdate > {_AT}) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("quota_snapshot", f"WITH {_Q} SELECT org_id, committed, reserved, remaining FROM q")
def quota_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed, reserved and remaining of each tenant."""
    return _quota(spark, sf_dir).select("org_id", "committed", "reserved", "remaining")


@query("quota_reserve", f"WITH {_Q} SELECT org_id, CASE WHEN org_id % 5 = 0 THEN 'invalid' WHEN org_id % 5 * 200000 > remaining THEN 'exceeded' ELSE 'reserved' END AS outcome FROM q")
def quota_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request of each tenant fits."""
    asks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), (F.col("c_custkey") % 5 * 200_000).alias("amount"))
    return service.reserve(_quota(spark, sf_dir), asks).select("org_id", "outcome")


@query("reservation_settle", "SELECT l_orderkey, l_linenumber, least(20, l_quantity::INT) AS committed, greatest(20 - l_quantity::INT, 0) AS refunded, greatest(l_quantity::INT - 20, 0) AS over FROM lineitem")
def reservation_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each finished reservation of twenty commits and gives back."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", service.settled(F.lit(20), F.col("l_quantity").cast("int")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(
    "reconcile_objects",
    """WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey % 11 <> 0), l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS c FROM orders WHERE o_orderkey % 7 <> 0)
       SELECT state, count(*) AS n FROM (SELECT CASE WHEN l.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'orphan' WHEN e.s <> l.s OR e.c <> l.c THEN 'stale' ELSE 'ok' END AS state FROM e FULL JOIN l ON e.k = l.k) GROUP BY 1""",
)
def reconcile_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by what reconciliation says of them."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    e = o.where(k % 11 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    listed = o.where(k % 7 != 0).select(k.alias("k"), F.when(k % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 17 != 0, F.col("o_custkey")).alias("c"))
    return service.reconciled(e, listed, "k", ["s", "c"]).groupBy("state").agg(F.count("*").alias("n"))


@query("index_cutover", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 AND s_suppkey % 2 = 0 THEN 'draining' WHEN s_nationkey = 3 THEN 'active' WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'shadow' END AS state FROM supplier WHERE s_nationkey <> 3 OR EXISTS (SELECT 1 FROM supplier x WHERE x.s_nationkey = 3 AND x.s_suppkey % 2 = 1)")
def index_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection's shadow index becomes the active one."""
    g = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("collection_id"), F.when(F.col("s_suppkey") % 2 == 0, "active").otherwise("shadow").alias("state"))
    return service.cut_over(g, F.lit(3)).select("s_suppkey", "state")


@query("signature_violations", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus IS DISTINCT FROM o_orderstatus")
def signature_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that don't agree with their generation."""
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("generation_id"), F.col("l_linestatus").alias("signature"))
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation_id"), F.col("o_orderstatus").alias("signature"))
    return service.signature_violations(chunks, g).select("l_orderkey", "l_linenumber")


@query("cancel_children", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 AND l_linestatus = 'O' THEN 'cancelled' ELSE CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'done' END END AS state FROM lineitem")
def cancel_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting children of cancelled parents."""
    jobs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("parent_id"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("state"))
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("job_id"))
    return service.cancelled(jobs, parents).select("l_orderkey", "l_linenumber", "state")


@query("purge_sessions", "SELECT count(*) AS n_left, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1993-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)) AS n_events FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1993-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def purge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after a hundred expired sessions are purged."""
    sessions, events = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    left, rest, _ = service.purge_expired(sessions, events, "o_orderkey", "o_orderdate", F.lit("1993-01-01").cast("timestamp"), 100)
    return left.agg(F.count("*").alias("n_left")).join(F.broadcast(rest.agg(F.count("*").alias("n_events"))))


@query("queue_forecast", "SELECT event_id, round(greatest((value - 20) * 0.5, 0), 6) AS queue, round(CASE WHEN value <= 0 OR 20 >= value THEN 0 ELSE 30 * (1 - 20 / value) END, 6) AS oldest_minutes, 20 >= value AS stable FROM events")
def queue_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue half an hour on, at each event's rate of arrival."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("arrivals"), F.lit(20.0).alias("service"), F.lit(30.0).alias("minutes"))
    return service.queue_forecast(rows).select("event_id", F.round("queue", 6).alias("queue"), F.round("oldest_minutes", 6).alias("oldest_minutes"), "stable")


@query("member_listing", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5")
def member_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their names."""
    users = table(spark, sf_dir, "customer").where("c_nationkey = 5").select("c_custkey", "c_name")
    return table(spark, sf_dir, "orders").join(users, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("published_versions", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred published versions."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderdate")


@query("stale_operations", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def stale_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty oldest operations left unfinished."""
    ops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("operation_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("updated_at"))
    return service.stale_operations(ops, ["O", "P"], F.lit("1996-01-01").cast("timestamp"), 50).select(F.col("operation_id").alias("o_orderkey"))


@query("url_tree", "SELECT DISTINCT array_to_string(p[1:i], '/') AS node, p[i] AS name, i::INT AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages)) WHERE p[i] <> ''")
def url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder and page of the URLs."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    return service.tree_nodes(paths, "p")


@query("page_trust", r"""SELECT doc_id, n >= 80 AND a >= 40 AND 5 * a >= n AND w >= 8 AS trusted FROM (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n, length(regexp_replace(text, '[^\pL\pN]', '', 'g')) AS a,
          len(list_filter(string_split_regex(text, '\s+'), lambda x: length(regexp_replace(x, '[^\pL]', '', 'g')) >= 2)) AS w FROM documents)""")
def page_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text may be trusted."""
    return table(spark, sf_dir, "documents").select("doc_id", pages.is_trustworthy(F.col("text")).alias("trusted"))


_WORDS_OF = r"list_filter(string_split_regex(lower({0}), '[^\pL\pN]+'), lambda x: x <> '')"


@query(
    "word_coverage",
    rf"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '^[^ ]+ ', '') AS rest FROM documents),
        b AS (SELECT doc_id, t, count(*) AS b FROM (SELECT doc_id, unnest({_WORDS_OF.format("text")}) AS t FROM d) GROUP BY 1, 2),
        a AS (SELECT doc_id, t, count(*) AS a FROM (SELECT doc_id, unnest({_WORDS_OF.format("rest")}) AS t FROM d) GROUP BY 1, 2)
        SELECT doc_id, 10 * sum(least(2, coalesce(a, 0), b)) >= 9 * sum(least(2, b)) AS covered FROM b LEFT JOIN a USING (doc_id, t) GROUP BY 1""",
)
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text without its first word still has most of its words."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return rows.select("doc_id", pages.covers(F.regexp_replace("text", "^[^ ]+ ", ""), F.col("text")).alias("covered"))


@query("input_checksum", "SELECT doc_id, sha256(unhex(lpad(to_hex(strlen(source)), 16, '0')) || encode(source) || unhex(lpad(to_hex(strlen(text)), 16, '0')) || encode(text)) AS checksum FROM documents")
def input_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over length-delimited fields."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.digest(F.encode("source", "UTF-8"), F.encode("text", "UTF-8")).alias("checksum"))


@query("merge_documents", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'theirs' WHEN 2 THEN 'ours' ELSE 'conflict' END AS outcome FROM documents")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side a three-way merge takes."""
    k, t = F.col("doc_id") % 4, F.col("text")
    ours, theirs = F.when(k.isin(2, 3), F.concat(t, F.lit("!"))).otherwise(t), F.when(k.isin(1, 3), F.concat(t, F.lit("?"))).otherwise(t)
    merged = table(spark, sf_dir, "documents").select("doc_id", t, ours.alias("o"), theirs.alias("th"), markdown.three_way_merge(t, ours, theirs).alias("m"))
    return merged.select("doc_id", F.when(F.col("m.conflict"), "conflict").when(F.col("m.markdown") == t, "text").when(F.col("m.markdown") == F.col("o"), "ours").otherwise("theirs").alias("outcome"))


@query("answer_pieces")
def answer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into pieces for a stream."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pages.pieces("text").alias("pieces"))


@query("word_error")
def word_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean word error rate of turns without their first word, by role."""
    rows = table(spark, sf_dir, "conversations").select("role", pages.wer(F.col("text"), F.regexp_replace("text", r"^\S+ ", "")).alias("wer"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.avg("wer").alias("wer"))


@query("stable_units", "SELECT user_id, round((('0x' || left(sha256(CAST(user_id AS VARCHAR)), 13))::BIGINT)::DOUBLE / 4503599627370496, 9) AS unit FROM (SELECT DISTINCT user_id FROM events)")
def stable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number in [0, 1) for each tenant that never changes."""
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.round(numbers.stable_unit(F.col("user_id").cast("string")), 9).alias("unit"))
