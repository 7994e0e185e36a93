"""Every registered query with a DuckDB twin gives the same rows on the smallest tables."""

from __future__ import annotations

import pytest

from lodestone.plans import catalog
from oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == duck_rows(catalog.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_give_rows(spark, sf_dir, name):
    assert not catalog.QUERIES[name](spark, sf_dir).isEmpty()
