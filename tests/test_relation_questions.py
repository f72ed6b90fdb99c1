"""Questions of pairs: made slice by slice, of ids that several entities have, and with nothing left on disk."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioworks.operators import network, relations
from folioworks.plans.catalog import registry
from folioworks.sources import shared
from tests.test_network_hubs import brute, members
from tests.test_oracles import FOLDER, TABLES, rows


@pytest.mark.parametrize("block", [20, 1000])
def test_slices_and_hubs_give_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(network, "SLICE", 30_000)
    data, df = members(spark)
    want = {}
    for (kind, record, a, b), n in brute(data).items():
        want.setdefault((a, b), []).append((kind, record, n))
    want = {p: sorted(x) for p, x in want.items() if sum(n for _, _, n in x) >= 3}
    parts = list(network.shared_first(network.counted(df), 3, 2, block))
    assert len(parts) > 2  # about 80,000 pairs
    got = [(r["source"], r["target"], list(zip(r["kinds"], r["evidence"]))) for part in parts for r in part.collect()]
    assert len(got) == len(want) and {(a, b): x for a, b, x in got} == {p: [(k, i) for k, i, _ in x[:2]] for p, x in want.items()}


def _on_disk(spark):
    """Shuffle files, and what is staged."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
    return {f for f in files if "/shuffle_" in f and f.endswith(".data")}, set(os.listdir(shared.folder(spark).removeprefix("file://")))


def test_what_is_exchanged_and_staged_on_the_way_goes(spark):
    _, df = members(spark)
    names = df.select("entity_id").distinct().select("entity_id", F.concat(F.lit("name "), "entity_id").alias("name"))
    shuffles, folders = _on_disk(spark)
    with shared.brief():
        asked = relations.chosen(network.counted(df), names, 3)
    after = _on_disk(spark)
    assert not after[0] - shuffles and {f.split("-")[0] for f in after[1] - folders} == {"asked"} and asked.count() > 0


def test_alike_names_carry_their_ids(spark):
    df = spark.createDataFrame([("d", i, e, "buyer") for i in range(3) for e in (1, 2, 3)], "kind string, record_id long, entity_id long, role string")
    names = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "Bob")], "entity_id long, name string")
    got = relations.chosen(network.counted(df), names, 3).collect()
    assert {(r["a_name"], r["b_name"]) for r in got} == {("Ann #1", "Ann #2"), ("Ann", "Bob")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["relationship_answers", "relationship_run"])
def test_customers_with_the_ids_of_parts_and_places(spark, tmp_path, name):
    """As at 360 times sf0.1: an id's entities are a question each, and parts and places stand among the people."""
    db = duckdb.connect()
    moved = {"customer": "c_custkey + 1999990 AS c_custkey", "orders": "o_custkey + 1999990 AS o_custkey", "part": "p_partkey + 999990 AS p_partkey", "lineitem": "l_partkey + 999990 AS l_partkey"}
    for t in TABLES:
        path = f"{tmp_path}/{t}.parquet"
        if t in moved:
            db.execute(f"COPY (SELECT * REPLACE ({moved[t]}) FROM '{FOLDER}/{t}.parquet') TO '{path}' (FORMAT parquet)")
        else:
            os.symlink(f"{FOLDER}/{t}.parquet", path)
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    expected = db.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    assert len(expected) and rows(got) == rows(expected)
