"""Administrative data operations: access, quotas, reconciliation, jobs and index generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a grant permits, least first.
RANKS = ("read", "write", "admin")


def access_rank(level: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(RANKS, 1):
        out = F.when(level == name, i).otherwise(out)
    return out


def visible(collections: DataFrame, grants: DataFrame, principals: Sequence[str], user: str, least: str = "read") -> DataFrame:
    """Collections that all may see, that the user owns, or that a grant to one of the principals opens. A union of ids
    and one semi-join, in place of a disjunction of EXISTS."""
    open_ = collections.where((F.col("visibility") == "org") | (F.col("owner_id") == user)).select("collection_id")
    granted = grants.where(F.col("principal_id").isin(*principals) & (access_rank(F.col("access_level")) >= RANKS.index(least) + 1)).select("collection_id")
    return collections.join(open_.union(granted).distinct(), "collection_id", "left_semi")


def narrowed(rows: DataFrame, versions: Sequence[str] | None, version: str = "version_id", current: str = "is_current") -> DataFrame:
    """Current rows, or those of named versions; an empty list of versions names no row."""
    return rows.where(current) if versions is None else rows.where(F.col(version).isin(*versions)) if versions else rows.limit(0)


def authorised(candidates: DataFrame, truth: DataFrame, key: str, **required) -> DataFrame:
    """Candidates whose authoritative row has the required values; the others fall away without a word."""
    fits = truth
    for name, value in required.items():
        fits = fits.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return candidates.join(fits, key)


def all_in_scope(candidates: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """The candidates, if every one of them is in scope; else the whole batch is refused."""
    if candidates.join(scope, key, "left_anti").limit(1).count():
        raise PermissionError("a candidate lies outside the scope")
    return candidates


def optional(rows: DataFrame, **values) -> DataFrame:
    """Rows that have the given values; a value of None asks for nothing."""
    for name, value in values.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def quota(limits: DataFrame, committed: DataFrame, reservations: DataFrame, now: Column, key: str = "org_id") -> DataFrame:
    """Limit, committed, reserved and remaining of each tenant; reservations count until they are over."""
    used = committed.groupBy(key).agg(F.sum("amount").alias("committed"))
    held = reservations.where((F.col("state") == "reserved") & (F.col("expires_at") > now)).groupBy(key).agg(F.sum("amount").alias("reserved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = limits.join(used, key, "left").join(held, key, "left").select(key, "limit", zero("committed"), zero("reserved"))
    return rows.withColumn("remaining", F.greatest(F.col("limit") - F.col("committed") - F.col("reserved"), F.lit(0)))


def reserve(quotas: DataFrame, requests: DataFrame, key: str = "org_id") -> DataFrame:
    """Whether each request (one for each tenant) fits what remains; amounts must be positive."""
    rows = requests.join(quotas, key, "left")
    return rows.withColumn("outcome", F.when(F.col("amount") <= 0, "invalid").when(F.col("limit").isNull(), "unconfigured").when(F.col("amount") > F.col("remaining"), "exceeded").otherwise("reserved"))


def settled(reservation: Column, actual: Column) -> Column:
    """What a finished reservation commits and gives back."""
    return F.struct(F.least(reservation, actual).alias("committed"), F.greatest(reservation - actual, F.lit(0)).alias("refunded"), F.greatest(actual - reservation, F.lit(0)).alias("over"))


def counter_drift(counters: DataFrame, actual: DataFrame, key: str = "org_id") -> DataFrame:
    """Counters that differ from what is there, as they should be; tenants without a counter are left alone."""
    rows = counters.join(actual.select(key, F.col("value").alias("now")), key, "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return rows.where(F.col("value") != F.col("now")).select(key, F.col("value").alias("was"), "now")


def reconciled(expected: DataFrame, listed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Each key as ok, missing, orphan or stale; a field that is null on either side says nothing."""
    a = expected.select(key, F.struct(*fields).alias("e"))
    b = listed.select(key, F.struct(*fields).alias("l"))
    same = F.lit(True)
    for f in fields:
        same = same & (F.col(f"e.{f}").isNull() | F.col(f"l.{f}").isNull() | (F.col(f"e.{f}") == F.col(f"l.{f}")))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("l").isNull(), "missing").when(F.col("e").isNull(), "orphan").when(~same, "stale").otherwise("ok").alias("state"))


def to_repair(missing: DataFrame, stale: DataFrame, key: str) -> DataFrame:
    """Missing and stale ids, each once, in order."""
    return missing.select(key).union(stale.select(key)).distinct().orderBy(key)


UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def backfilled(rows: DataFrame, payload: str, names: Sequence[str], target: DataFrame, key: str) -> DataFrame:
    """Ids out of a JSON payload under the first of several names that holds a UUID, where the target table has it."""
    found = F.coalesce(*(F.when(F.get_json_object(payload, f"$.{n}").rlike(UUID), F.get_json_object(payload, f"$.{n}")) for n in names))
    known = target.select(F.col(key).alias("__known")).distinct()
    joined = rows.withColumn("__found", found).join(known, F.col("__found") == F.col("__known"), "left")
    return joined.withColumn(key, F.coalesce(F.col(key), F.col("__known"))).select(*rows.columns)


def purge_expired(sessions: DataFrame, events: DataFrame, key: str, until: str, now: Column, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and events that stay after a purge of at most 1 to 500 expired sessions, and the purged ids."""
    gone = sessions.where(F.col(until) <= now).orderBy(until, key).limit(max(1, min(most, 500))).select(key)
    return sessions.join(gone, key, "left_anti"), events.join(gone, key, "left_anti"), gone


def recovered(producers: DataFrame, beat: str, now: Column, stale_s: int) -> DataFrame:
    """Streams whose producer has been silent too long fail; the others stay."""
    silent = (F.col("state") == "running") & (F.col(beat) < now - F.make_dt_interval(secs=F.lit(stale_s)))
    return producers.withColumn("state", F.when(silent, "failed").otherwise(F.col("state")))


def cut_over(generations: DataFrame, collection: Column) -> DataFrame:
    """The collection's active index drains and its shadow becomes active, if it has a shadow."""
    has = generations.where((F.col("state") == "shadow") & (F.col("collection_id") == collection)).select("collection_id").distinct().withColumn("__ready", F.lit(True))
    rows = generations.join(has, "collection_id", "left")
    state = F.when(F.col("__ready") & (F.col("state") == "active"), "draining").when(F.col("__ready") & (F.col("state") == "shadow"), "active").otherwise(F.col("state"))
    return rows.withColumn("state", state).select(*generations.columns)


def consistent(generations: DataFrame, signature: str, key: str = "org_id") -> bool:
    """Whether every tenant's active index has the right signature and none a wrong one; none at all is consistent."""
    per = generations.groupBy(key).agg(F.bool_or((F.col("state") == "active") & (F.col("signature") != signature)).alias("wrong"), F.bool_or((F.col("state") == "active") & (F.col("signature") == signature)).alias("right"))
    return not per.where("wrong or not right").limit(1).count()


def signature_violations(chunks: DataFrame, generations: DataFrame) -> DataFrame:
    """Chunks whose signature isn't that of their generation."""
    g = generations.select("generation_id", F.col("signature").alias("__right"))
    return chunks.join(g, "generation_id", "left").where(~F.col("signature").eqNullSafe(F.col("__right"))).drop("__right")


def seeded(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """A job for the current version of every live document that has none yet."""
    live = documents.where("is_current and deleted_at is null").select("document_id", "version_id")
    return live.join(jobs.select("version_id"), "version_id", "left_anti").select("document_id", "version_id")


def cancelled(jobs: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of the given parents that wait or are leased are cancelled."""
    hit = parents.select(F.col("job_id").alias("parent_id"), F.lit(True).alias("__hit")).distinct()
    state = F.when(F.col("__hit") & F.col("state").isin("pending", "leased"), "cancelled").otherwise(F.col("state"))
    return jobs.join(hit, "parent_id", "left").withColumn("state", state).select(*jobs.columns)


def triaged(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions take effect on open conflicts only; others are settled for good."""
    d = decisions.select("conflict_id", F.col("status").alias("__new"))
    status = F.when((F.col("status") == "open") & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("status"))
    return conflicts.join(d, "conflict_id", "left").withColumn("status", status).select(*conflicts.columns)


def open_conflicts(conflicts: DataFrame, claims: DataFrame, limit: int = 100) -> DataFrame:
    """The newest open conflicts with both their claims, each pair in one order."""
    side = lambda s: claims.select(F.col("claim_id").alias(f"claim_{s}_id"), F.struct(*(c for c in claims.columns if c != "claim_id")).alias(f"claim_{s}"))
    newest = conflicts.where("status = 'open' and claim_a_id < claim_b_id").orderBy(F.desc("detected_at"), "conflict_id").limit(limit)
    return newest.join(side("a"), "claim_a_id").join(side("b"), "claim_b_id")


def purge_plan(chunks: DataFrame, generations: DataFrame, key: str) -> DataFrame:
    """Signatures whose vectors must go, from both places that know them."""
    return chunks.select(key).union(generations.select(key)).where(F.col(key).isNotNull()).distinct()


def stale_operations(operations: DataFrame, states: Sequence[str], before: Column, limit: int) -> DataFrame:
    """Operations of some states untouched since an instant, oldest first."""
    return operations.where(F.col("state").isin(*states) & (F.col("updated_at") < before)).orderBy("updated_at", "operation_id").limit(limit)


def queue_forecast(rows: DataFrame) -> DataFrame:
    """A fluid queue after some minutes: what has piled up, and how old its oldest is."""
    hours = F.col("minutes") / 60
    age = F.when((F.col("arrivals") <= 0) | (F.col("service") >= F.col("arrivals")), 0.0).otherwise(F.col("minutes") * (1 - F.col("service") / F.col("arrivals")))
    return rows.withColumn("queue", F.greatest((F.col("arrivals") - F.col("service")) * hours, F.lit(0.0))).withColumn("oldest_minutes", age).withColumn("stable", F.col("service") >= F.col("arrivals"))


def tree_nodes(paths: DataFrame, path: str) -> DataFrame:
    """Every folder and file of a tree: its path, name and depth."""
    parts = F.split(path, "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), F.element_at(parts, i).alias("name"), i.alias("depth")))
    return paths.select(F.explode(each).alias("n")).select("n.*").where("name <> ''").distinct()
