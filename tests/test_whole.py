"""Queries that once took an id subset or cut rare rows give all rows, under both of their names."""

import os

import pytest

from folioworks.plans.catalog import registry
from tests.test_oracles import FOLDER

PARTIAL = "record_detail_entities entity_groups_by_type txns_ordered edge_evidence entity_merge fts_tokens token_frequencies".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", PARTIAL)
def test_both_names_give_all_rows(spark, name):
    assert f"{name}_all" in registry.oracle_sql()
    some, all_ = (registry.queries()[n](spark, FOLDER) for n in (name, f"{name}_all"))
    assert all_.columns == some.columns
    assert some.exceptAll(all_).count() == 0 and all_.count() == some.count()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_rows_of_every_document_are_there(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    got = {n: registry.queries()[n](spark, FOLDER) for n in PARTIAL}
    assert got["txns_ordered"].count() == lines.count()
    assert got["entity_groups_by_type"].select("document_id").distinct().count() == lines.select("l_orderkey").distinct().count()
    assert got["fts_tokens"].where("tf = 1").count() > 0 and got["token_frequencies"].where("tf = 1").count() > 0
