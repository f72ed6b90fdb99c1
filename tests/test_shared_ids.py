"""Entities of two kinds that have one id, as a large archive's parts and places do."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioworks.plans.catalog import registry
from tests.test_oracles import FOLDER, TABLES, rows


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["entity_rename", "entity_detach_sweep"])
def test_parts_with_the_ids_of_places(spark, tmp_path, name):
    for t in TABLES:
        if t != "part":
            os.symlink(f"{FOLDER}/{t}.parquet", tmp_path / f"{t}.parquet")
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    part.unionByName(part.limit(20).withColumn("p_partkey", F.monotonically_increasing_id() + 1_000_000)).write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'part' else ''}'")
    expected = db.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    assert len(expected) and rows(got) == rows(expected)
