"""Every query of the library against its SQL, as the driver compares them, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences

from seqloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert differences(spark, sf, name, QUERIES[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_repeats_itself(spark, sf, name):
    """Queries without SQL: some rows, no column that is all null, and the same rows again. Their values are tested apart."""
    once, again = (sorted(map(str, QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert once and once == again
    df = QUERIES[name](spark, sf)
    from pyspark.sql import functions as F

    seen = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    assert all(seen)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
