"""Every query of the archive engine that has an oracle gives its rows."""

import os

import duckdb
import pandas as pd
import pytest

from folioworks.plans.catalog import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    def value(v):
        return "" if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(str(value(v)) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, db, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    expected = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
