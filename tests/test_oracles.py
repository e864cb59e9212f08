"""Every registered query that SQL can say gives the rows of its SQL, over whole tables at the smallest scale."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from oddlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def same(a, b):
    a, b = (x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiub" and b[c].dtype.kind in "fiub":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
