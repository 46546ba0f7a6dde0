"""The llm queries with SQL twins, and all of them over the smallest tables."""

import pytest

import __spark_entry__
from compare import assert_same
from folioframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_whole_table(spark, sf_dir, name):
    table = "pages" if name.startswith("op3") else "embeddings" if name.startswith("op10") else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, sf_dir)
    if name.startswith("op10"):
        assert got.count() == 20 * ((n + 19) // 20)
    elif name.startswith("op5"):
        assert got.select("doc_id").distinct().count() == n
    elif not name.startswith("op4"):
        assert got.count() == n
    assert name in __spark_entry__.queries()
