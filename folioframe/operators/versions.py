"""Versions: as-of resolution, publication, intervals and conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """Half-open validity; an open end is never over."""
    return (start <= at) & (end.isNull() | (end > at))


def published(versions: DataFrame, key: str, start: str, order: str) -> DataFrame:
    """Each version with the instant that the next one supersedes it (null for the current one)."""
    follow = Window.partitionBy(key).orderBy(start, order)
    return versions.withColumn("effective_to", F.lead(start).over(follow)).withColumn("is_current", F.lead(F.lit(1)).over(follow).isNull())


def publication_errors(versions: DataFrame, start: str, now: Column) -> DataFrame:
    """Versions that can't be published: those that begin in the future."""
    return versions.where(F.col(start) > now)


def as_of(versions: DataFrame, key: str, start: str, at: Column, tie: str, end: str | None = None) -> DataFrame:
    """The latest version of each key that is in effect at an instant; ties go to the greater ``tie``. An aggregate
    that combines on the map side picks it, so no group is sorted."""
    alive = versions.where(valid_at(at, F.col(start), F.col(end)) if end else F.col(start) <= at)
    latest = alive.groupBy(key).agg(F.max(F.struct(start, tie, F.struct(*(c for c in versions.columns if c != key)).alias("row"))).alias("best"))
    return latest.select(key, "best.row.*")


def as_of_join(points: DataFrame, versions: DataFrame, key: str, at: str, start: str, tie: str, keep: Sequence[str]) -> DataFrame:
    """For every point the version in effect at its instant: versions and points stand in one ordered stream for each
    key, and the last version carries forward, so the join costs one shuffle and no pairs."""
    fields = [F.col(c) for c in keep]
    rows = versions.select(key, F.col(start).alias("__at"), F.col(tie).cast("long").alias("__tie"), F.struct(*fields).alias("__v"), F.lit(None).alias("__p"))
    asks = points.select(key, F.col(at).alias("__at"), F.lit(2**62).alias("__tie"), F.lit(None).cast(rows.schema["__v"].dataType).alias("__v"), F.struct(*points.columns).alias("__p"))
    both = rows.withColumn("__p", F.lit(None).cast(asks.schema["__p"].dataType)).unionByName(asks)
    carried = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy("__at", "__tie").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__v", carried).where("__p is not null").select("__p.*", *(F.col(f"__v.{c}").alias(f"version_{c}") for c in keep))


def interval_conflicts(claims: DataFrame, keys: Sequence[str], start: str, end: str, value: str, id_col: str, bucket_days: int = 30) -> DataFrame:
    """Pairs of claims of one key whose intervals overlap and whose values differ. Claims are dealt to the calendar
    buckets they touch, so a hot key's claims meet only those of the same time; a pair is reported in the bucket of
    its overlap's beginning only, and so once."""
    day = lambda c: F.floor(F.unix_timestamp(c) / (86400 * bucket_days))
    rows = claims.select(*keys, id_col, start, end, value)
    dealt = rows.withColumn("bucket", F.explode(F.sequence(day(start), F.greatest(day(start), day(end)))))
    side = lambda s: dealt.select(*keys, "bucket", *(F.col(c).alias(f"{s}_{n}") for c, n in ((id_col, "id"), (start, "start"), (end, "end"), (value, "value"))))
    pairs = side("a").join(side("b"), [*keys, "bucket"])
    overlap = (F.col("a_id") < F.col("b_id")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & ~F.col("a_value").eqNullSafe(F.col("b_value"))
    return pairs.where(overlap & (F.col("bucket") == day(F.greatest("a_start", "b_start")))).drop("bucket")


#: What may follow what in a document's life.
TRANSITIONS = (
    ("draft", "uploaded"), ("uploaded", "converting"), ("converting", "converted"), ("converting", "failed"), ("failed", "converting"), ("converted", "indexing"),
    ("indexing", "indexed"), ("indexing", "failed"), ("indexed", "published"), ("published", "superseded"), ("published", "archived"), ("superseded", "archived"), ("archived", "deleted"), ("failed", "deleted"),
)


def allowed_transition(old: Column, new: Column, table: Sequence[tuple[str, str]] = TRANSITIONS) -> Column:
    """Whether a change of state is in the table."""
    return F.concat_ws(">", old, new).isin(*(f"{a}>{b}" for a, b in table))


def invariant_violations(versions: DataFrame, key: str, current: str, start: str, end: str, now: Column) -> DataFrame:
    """Keys without exactly one current version, or whose current one is over or yet to come."""
    is_current = F.col(current)
    checked = versions.groupBy(key).agg(F.count_if(is_current).alias("n_current"), F.count_if(is_current & F.col(end).isNotNull() & (F.col(end) <= now)).alias("expired"), F.count_if(is_current & (F.col(start) > now)).alias("future"))
    return checked.where("n_current <> 1 or expired > 0 or future > 0")
