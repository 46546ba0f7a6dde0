"""Tables in the folder that all executors share, and what databases do to tables: upserts and incremental rewrites."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a local session gets a folder of its own;
    on a cluster, whose machines share no such folder, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='folio-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Spark's setting that a query's shuffle files go when it ends; else they stay until the driver's JVM happens to collect garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df written as Parquet to the shared folder and read again; a filter on the columns of by reads only what it needs.
    What was shuffled for the write is no one else's and leaves the disk with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def insert_new(there: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is there, and the new rows whose keys are free; of new rows with one key, one."""
    return there.unionByName(new.dropDuplicates(list(keys)).join(there.select(*keys), list(keys), "left_anti"))


def upsert(there: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of those with their keys."""
    fresh = new.dropDuplicates(list(keys))
    return there.join(fresh.select(*keys), list(keys), "left_anti").select(*there.columns).unionByName(fresh)


def replace_group(there: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """An index upsert: all rows of the groups that new touches give way to its rows."""
    return there.join(new.select(group).distinct(), group, "left_anti").select(*there.columns).unionByName(new)


def changed(documents: DataFrame, indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents whose id, content hash and signature the index doesn't have: the ones to do again."""
    return documents.join(indexed.select(*keys), list(keys), "left_anti")


def checked_vectors(chunks: DataFrame, vector_col: str, dims: int, most: int) -> DataFrame:
    """Chunks whose vector has the right shape; more of them than the embedded store may hold is an error."""
    right = chunks.where(F.size(vector_col) == dims)
    n = right.count()
    if n > most:
        raise ValueError(f"{n} vectors are more than the {most} that one scan may read")
    return right


def repaired(rows: DataFrame, truth: DataFrame, key: str, col: str) -> DataFrame:
    """An update from a join: the column takes the other table's value where that has one that differs."""
    right = truth.select(key, F.col(col).alias("__new"))
    return rows.join(right, key, "left").withColumn(col, F.coalesce("__new", col)).drop("__new")
