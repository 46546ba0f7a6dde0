"""Session settings and access to the input tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of the engine needs for right results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own session to the operators."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folioframe")
    builder = builder.config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "12g"))
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": "8", **conf}.items():
        builder = builder.config(k, v)
    # the workers import this package by name
    builder = builder.config("spark.executorEnv.PYTHONPATH", os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")]))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path goes to Spark's reader untouched, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
