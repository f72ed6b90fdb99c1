"""Tiered packing: an exact round trip of ids, full windows, and balanced steps."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioworks.llm import tiers
from tests.llm import fixtures as fx


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_full_and_hold_every_token_once(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 30, 500, 3000])
    lengths = np.array([rng.choice([1, rng.randint(1, 40), rng.randint(1, 2047), 2047, 128, 512, 513]) for _ in range(n)])
    windows = tiers.arranged(lengths)
    held = Counter()
    for w in windows:
        size = sum(p[0] for p in w)
        assert size & (size - 1) == 0 and 0 < size <= 2048
        for length, item, start in w:
            assert length > 0
            held.update((item, at) for at in range(start, start + length))
    assert held == Counter((i, at) for i, n in enumerate(lengths.tolist()) for at in range(n))
    odd = [w for w in windows if sum(p[0] for p in w) not in tiers.TIERS]
    assert len(odd) <= sum(t.bit_length() for t in tiers.TIERS)


def test_documents_are_mostly_whole():
    rng = random.Random(1)
    lengths = np.array([int(rng.lognormvariate(5.5, 1)) % 2047 + 1 for _ in range(4000)])
    cut = {i for w in tiers.arranged(lengths) for n, i, _ in w if n < lengths[i]}
    assert len(cut) < 0.4 * len(lengths)


def test_steps_are_balanced():
    rng = random.Random(2)
    costs = [rng.randint(1000, 4_000_000) for _ in range(803)]
    got = tiers.steps(costs, 8)
    sizes, sums = Counter(got), Counter()
    for g, c in zip(got, costs):
        sums[g] += c
    assert max(sizes.values()) <= 8 and max(sizes.values()) - min(sizes.values()) <= 1
    assert max(sums.values()) < 1.35 * min(sums.values())


@pytest.mark.parametrize("group", [7, tiers.GROUP])
def test_round_trip(spark, group):
    df = fx.docs(spark)
    got = tiers.pack(df, group=group).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = Counter()
    for d, t in fx.pairs(df):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine[d] += len(ids)
        if sum(1 for e, _ in fx.pairs(df) if e == d) == 1:
            pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d)
            assert all(r["doc_tokens"] == len(ids) for r in got if r["doc_id"] == d)
            assert [s for s, _, _ in pieces] == np.cumsum([0, *(n for _, n, _ in pieces)])[:-1].tolist() and sum(n for _, n, _ in pieces) == len(ids)
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["length"]
    assert held == mine
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows)])[:-1].tolist()
        size = sum(r["length"] for r in rows)
        assert {r["tier"] for r in rows} == {size} and size & (size - 1) == 0 and len({r["step_group"] for r in rows}) == 1
    steps = {(r["step_group"], r["tier"]) for r in got}
    assert len({s for s, _ in steps}) == len(steps)
    tokens = Counter()
    for r in got:
        tokens[r["step_group"]] += r["length"]
    assert max(tokens.values()) <= tiers.STEP


def test_empty(spark):
    assert tiers.pack(fx.empty(spark)).count() == 0
