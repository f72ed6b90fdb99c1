"""Pairs are dealt over tasks by their number."""

from folioworks.operators import network
from tests.test_network_hubs import brute, members


def test_tasks_follow_the_pairs(spark, monkeypatch):
    rows, df = members(spark)
    want = {}
    for (kind, _, a, b), n in brute(rows).items():
        want.setdefault((a, b), {}).setdefault(kind, []).append(n)
    monkeypatch.setattr(network, "PAIRS", 1000)
    got = network.edges(df, 2)
    assert got.rdd.getNumPartitions() > 50  # about 80,000 pairs
    kept = {p: [n for x in by.values() if sum(x) >= 2 for n in x] for p, by in want.items()}
    assert {(r["source"], r["target"]): (r["weight"], r["shared_records"]) for r in got.collect()} == {p: (sum(x), len(x)) for p, x in kept.items() if x}
