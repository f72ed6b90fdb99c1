"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioworks.llm import spelling
from tests.llm import fixtures as fx

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_off(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(rows):
    n, out, form = counted(rows), {}, {}
    for w in n:
        near = [x for x in n if one_off(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form[w], n[w], len(near), n[form[w]] if form[w] else None)
    result = {}
    for w, (f, c, m, fc) in out.items():
        root = w
        while form[root]:
            root = form[root]
        result[w] = (f, root, c, m, fc)
    return result


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def texts(seed, words=120):
    rng = random.Random(seed)
    letters = "aeiounrstlé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(words)]
    rows = []
    for d in range(60):
        out = []
        for _ in range(150):
            w = rng.choice(base[: 1 + int(len(base) * rng.random() ** 2)])
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :], w.upper()])
            out.append(w)
        rows.append((d, rng.choice([" ", ", ", "1", "× —"]).join(out)))
    return rows


@pytest.mark.parametrize("node", [3, 40, spelling.NODE])
def test_variants(spark, node):
    rows = texts(node) + [(None, None), (7, ""), (None, "Étude étude ÉTUDE Straße strasse straSSe " * 4), (3, "anagram naagram margana " * 5)]
    df = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)], "doc_id long, text string, word string, n int").repartition(4)
    got = result(spelling.variants(df, node))
    assert got == brute(rows)
    assert sum(1 for x in got.values() if x[0]) > 50 and any(x[0] != x[1] and x[0] for x in got.values())


def test_nodes_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODES", 2)
    rows = texts(5, 60)
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), 15)) == brute(rows)


def test_fixture_and_empty(spark):
    assert result(spelling.variants(fx.docs(spark))) == brute(fx.pairs(fx.docs(spark)))
    assert spelling.variants(fx.empty(spark)).count() == 0


def test_long_words(spark):
    long = "ab" * 60_000
    rows = [(1, f"{long} {long}x {long[:-1]}c {long}xy " * 6), (2, f"{long} word" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.variants(df)) == brute(rows)


def test_leaves_of_many_anagrams(monkeypatch):
    """Words of one vector and those that have one letter more, less or another one."""
    rng = random.Random(4)
    words = sorted({"".join(rng.sample("rrtnslae", 8)) for _ in range(600)} | {"".join(rng.sample("rrtnslaee", 9)) for _ in range(300)} | {"".join(rng.sample("rrtnslai", 8)) for _ in range(300)})
    w = spelling._Words(words)
    found = Counter()
    for i, j in spelling.pairs(w, w, leaf=5):
        ok = spelling.verified(w, i, w, j)
        found.update((a, b) for a, b in zip(i[ok].tolist(), j[ok].tolist()))
    assert max(found.values()) == 1
    same = {frozenset(p) for p in found}
    assert same == {frozenset((i, j)) for i in range(len(words)) for j in range(i) if one_off(words[i], words[j])}


def test_candidates_are_few():
    """What reaches a leaf is a small part of all pairs."""
    words = sorted({w for _, t in texts(9, 2000) for w in re.findall(r"[a-zé]{5,}", t)})
    w = spelling._Words(words)
    n = sum(len(i) for i, _ in spelling.pairs(w, w))
    assert n < 0.02 * len(words) ** 2


def test_blocks_hold_every_meeting_once(spark):
    rows = [("p", f"w{i}", 3, 0) for i in range(50)] + [("p", f"g{i}", 3, 1) for i in range(300)] + [("q", "w", 3, 0)]
    reach = spark.createDataFrame(rows, "path string, word string, n long, spent int")
    got = spelling._blocks(reach, 10).collect()
    assert max(Counter((r["path"], r["row"], r["column"], r["own"]) for r in got).values()) <= 80
    own = {(r["path"], r["row"], r["column"]): [] for r in got}
    for r in got:
        if r["own"]:
            own[r["path"], r["row"], r["column"]].append(r["word"])
    met = Counter((x, r["word"]) for r in got if not r["own"] for x in own[r["path"], r["row"], r["column"]])
    assert set(met.values()) == {1} and len(met) == 50 * 350 + 1


def test_bytes_are_compared_whole():
    a, b = spelling._Words(["abcdefgh", "abc", "aaaaa"]), spelling._Words(["abcdexgh", "abcd", "aaaa"])
    assert spelling.verified(a, np.arange(3), b, np.arange(3)).tolist() == [True, True, True]
    assert spelling.verified(a, np.array([0, 1]), b, np.array([1, 2])).tolist() == [False, False]
