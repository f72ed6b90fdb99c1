"""Pairs of records with very many entities, and nearest vectors, against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from folioworks.operators import nearest, network


def members(spark):
    rng = random.Random(1)
    rows = [("d", 1, e, "buyer") for e in range(400)] + [("d", 1, e, "seller") for e in range(0, 400, 3)] + [("g", 1, e, "owner") for e in range(0, 400, 7)]
    rows += [(rng.choice("dg"), rng.randint(2, 60), rng.randint(0, 80), rng.choice(["buyer", "seller"])) for _ in range(600)]
    return rows, spark.createDataFrame(rows, "kind string, record_id long, entity_id long, role string")


def brute(rows):
    by = {}
    for kind, record, e, _ in rows:
        by.setdefault((kind, record), Counter())[e] += 1
    return {(k, r, a, b): n[a] * n[b] for (k, r), n in by.items() for a, b in combinations(sorted(n), 2)}


def test_hubs_are_paired_block_by_block(spark):
    rows, df = members(spark)
    for block in (20, network.BLOCK):
        got = network.paired(df, block).collect()
        assert {(r["kind"], r["record_id"], r["source"], r["target"]): r["n"] for r in got} == brute(rows) and len(got) == len(brute(rows))
    held = network.blocked(df, 20).groupBy("kind", "record_id", "i", "j", "side").count().agg(F.max("count"), F.count_if(F.col("j") > 5)).first()
    assert held[0] < 60 and held[1] > 20  # no task of a hub makes more than 60 x 60 of its 80,000 pairs


def test_lists_of_shared_records(spark):
    rows, df = members(spark)
    want = {}
    for (k, r, a, b), n in brute(rows).items():
        want.setdefault((a, b), {"d": [], "g": []})[k] += [r] * n
    got = {(r["source"], r["target"]): {"d": r["documents"], "g": r["groups"]} for r in network.pair_records(df, 3).collect()}
    assert got == {p: {k: sorted(v) for k, v in x.items()} for p, x in want.items() if len(x["d"]) + len(x["g"]) >= 3}


def cosine(x, y):
    if x is None or len(x) != len(y):
        return 0.0
    norm = [float(np.sqrt(np.dot(v, v))) or 1.0 for v in (x, y)]
    return round(float(np.dot(x, y)) / (norm[0] * norm[1]), 6)


def test_nearest_dense_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(700)] + [(700, [0.0] * 4), (701, [1.0]), (702, None)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(7)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    want = set()
    for q, x in vectors:
        if q % 50 == 0:
            order = sorted(((-cosine(v, x), i) for i, v in vectors))[:6]
            want |= {(q, i, n, -s) for n, (s, i) in enumerate(order, 1)}
    for block in (3, 1024):
        assert {(r["query_id"], r["id"], r["rank"], r["score"] + 0.0) for r in nearest.dense(df, asked, 6, block).collect()} == want
    plan = nearest.dense(df, asked, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_nearest_sparse_vectors(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.choice([-1.0, 0.5, 1.0, 0.0])) for i in range(300) for s in rng.sample(range(40), rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "id long, slot int, weight double").repartition(5)
    by = {}
    for i, s, w in rows:
        by.setdefault(i, {})[s] = w
    want = set()
    for q in range(0, 300, 30):
        scores = sorted((-round(sum(by[q][s] * v[s] for s in by[q].keys() & v.keys()), 6), i) for i, v in by.items() if by[q].keys() & v.keys())
        want |= {(q, i, n, -s + 0.0) for n, (s, i) in enumerate(scores[:9], 1)}
    assert {(r["query_id"], r["id"], r["rank"], r["score"] + 0.0) for r in nearest.sparse(df, df.where("id % 30 = 0"), 9, 64, 4).collect()} == want


def test_candidates_of_a_task_are_bounded():
    rng = np.random.default_rng(4)
    best, all_ = nearest.Best(5, 3), []
    for n in range(20):
        scores = np.round(rng.random((5, 50)), 2)
        best.add(scores, np.arange(50) + 50 * n)
        all_.append(scores)
        assert len(best.id) <= 15
    whole = np.concatenate(all_, axis=1)
    for q in range(5):
        assert best.id[best.question == q].tolist() == np.lexsort((np.arange(1000), -whole[q]))[:3].tolist()
