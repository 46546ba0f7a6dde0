"""Folders as sources: probes, listings and streams of new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text
from folioframe.sources import formats



def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with size, time and format; nothing of their contents is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), "modificationTime", formats.format_of(F.col("path")).alias("format"))


def watched(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of files whose names fit the pattern (either case); hidden and temporary ones are passed over."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    name = name_of(F.col("path"))
    return files.where(text.glob_matches(name, pattern) & ~text.hidden_or_temporary(name))


def unseen(files: DataFrame, seen: DataFrame, rule: str) -> DataFrame:
    """Files that a rule hasn't seen yet, or that have grown newer since."""
    last = seen.where(F.col("rule") == rule).groupBy("path").agg(F.max("modificationTime").alias("__last"))
    return files.join(last, "path", "left").where(F.col("__last").isNull() | (F.col("modificationTime") > F.col("__last"))).drop("__last")
