"""A merge of entities is dealt over tasks by the number of links."""

from folioworks.operators import entities


def test_tasks_follow_the_links(spark, monkeypatch):
    monkeypatch.setattr(entities, "LINKS", 100)
    rows = [(d, e, r) for d in range(500) for e in (1, 2, 3) for r in ("seller", None)] + [(7, 1, "seller")]
    got = entities.merged(spark.createDataFrame(rows, "document_id long, entity_id long, role string"), 1, 2)
    assert got.rdd.getNumPartitions() > 30
    found = sorted((x["document_id"], x["entity_id"], x["role"] or "") for x in got.collect())
    moved = [(d, 1 if e == 2 else e, r) for d, e, r in rows]
    assert found == sorted([*{x for x in moved if x[2]}, *((d, e, "") for d, e, r in moved if r is None)])
