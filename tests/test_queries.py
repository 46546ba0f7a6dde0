"""Every query with a SQL twin gives the twin's rows; every other one runs."""

import pytest

import __spark_entry__
from compare import assert_same
from folioframe.plans import registry

WITH = sorted(registry.ORACLE)
WITHOUT = sorted(set(registry.QUERIES) - set(registry.ORACLE))


@pytest.mark.parametrize("name", WITH)
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE[name], sf_dir)


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_twice_the_same_name():
    with pytest.raises(ValueError):
        registry.query(WITH[0])(lambda s, d: None)
