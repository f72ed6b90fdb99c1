"""Substring, near and line dedup against brute force."""

import hashlib
import re
from collections import Counter

from folioworks.llm import line_dedup, links, near_dedup, substring_dedup
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows, n=13):
    words = [(d, WORD.findall(t)) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, fx.key(d)), fx.key(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < fx.key(d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(spark):
    for seed in range(2):
        df = fx.docs(spark, seed)
        got = substring_dedup.substring_dedup(df).drop("kept_text").collect()
        assert Counter(map(tuple, got)) == brute_substrings(fx.pairs(df))
    assert substring_dedup.substring_dedup(fx.empty(spark)).count() == 0


def sets(t, n):
    w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, n, percent):
    all_ = [sets(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(all_):
        for j in range(i):
            both = len(a & all_[j])
            if a and all_[j] and 100 * both >= percent * len(a | all_[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), fx.key(d)), fx.key(d))
    return Counter((d, len(all_[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_dedup(spark):
    df = fx.docs(spark)
    for n, percent in ((3, 85), (2, 60)):
        got = near_dedup.near_duplicates(df, n, percent, bands=60, rows=3).select("k", "n_shingles", "root_k").collect()
        assert Counter((None if k == fx.key(None) else k, s, r) for k, s, r in got) == brute_components(fx.pairs(df), n, percent)
    assert near_dedup.near_duplicates(fx.empty(spark)).count() == 0


def test_large_group_of_near_copies_keeps_its_links(spark):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).select("k", "n_shingles", "root_k").collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 3, 85)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in links.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_patience():
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([], [1]) == []


def shared(early, late, stands=2):
    """What `aligned` gets of two sequences of single-line runs."""
    return [{"early": 1, "run": x, "starts": [i for i, y in enumerate(late) if y == x], "ends": [i for i, y in enumerate(late) if y == x], "places": [i for i, y in enumerate(early) if y == x][: late.count(x)], "stands": stands} for x in set(early) & set(late)]


def test_aligned_runs_go_first_and_the_rest_by_the_index():
    assert line_dedup.aligned(shared([1, 2, 3, 4], [4, 1, 2, 3])) == ([0, 1, 2, 3], 3)  # the long block is aligned, not the line that crosses it
    assert line_dedup.aligned(shared([1, 2, 3], [7, 3, 2, 1])) == ([1, 2, 3], 1)
    assert line_dedup.aligned(shared([1, 2, 3], [1, 9, 2, 3, 1])) == ([0, 2, 3, 4], 3)
    common, other = shared([1, 2], [1, 2], 900), shared([5], [9, 9, 5])
    assert line_dedup.aligned(common) == ([0, 1], 2)  # no run that it shares is rarer
    assert line_dedup.aligned(common + [{**x, "early": 2} for x in other]) == ([0, 1, 2], 1) and line_dedup.aligned([]) == ([], 0)


def test_alignment_decides(spark, monkeypatch):
    """Most of what goes is aligned; without the diff nothing is."""
    df = fx.docs(spark)
    one = line_dedup.line_dedup(df).agg({"n_removed": "sum", "n_aligned": "sum"}).first()
    assert one["sum(n_aligned)"] >= 0.9 * one["sum(n_removed)"] > 0
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.aligned(shared([1, 2, 3], [1, 2, 3])) == ([0, 1, 2], 0)


def test_runs_by_brute_force():
    import random

    import numpy as np

    rng = random.Random(6)
    for least in (1, 3, 5):
        docs = [[(rng.randint(1, 4), rng.randint(1, 3)) for _ in range(rng.randint(0, 9))] for _ in range(40)]
        want = set()
        for d, lines in enumerate(docs):
            for step in (1, -1):
                for i in range(len(lines)):
                    j, total = i, lines[i][1]
                    while total < least and 0 <= j + step < len(lines):
                        j += step
                        total += lines[j][1]
                    if total >= least:
                        want.add((d, min(i, j), max(i, j), tuple(x for x, _ in lines[min(i, j) : max(i, j) + 1]), step if i != j else 1))
        flat = [(d, n, *x) for d, lines in enumerate(docs) for n, x in enumerate(lines)]
        doc, place, line, words = (np.array(x) for x in zip(*flat))
        d, r, s, e = line_dedup.runs(line.astype(np.uint64), words, doc, place, least)
        assert len(d) == len(want) and {x[:3] for x in want} == set(zip(d.tolist(), s.tolist(), e.tolist()))
        names = {}
        for x, y, z, run in zip(d.tolist(), s.tolist(), e.tolist(), r.tolist()):
            names.setdefault(run, set()).add(tuple(v for v, _ in docs[x][y : z + 1]))
        assert max(map(len, names.values())) == 1  # a name is one sequence of lines


def test_a_document_of_many_partners_takes_linear_time(spark):
    import time

    took = []
    for n in (3000, 12_000):
        rows = [(i, f"line {i} that an earlier document has\nown {i}") for i in range(n)]
        rows.append((n, "\n".join(x for i in range(n) for x in (f"line {i} that an earlier document has", f"more {i}"))))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.time()
        got = line_dedup.line_dedup(df).where(f"k = {n}").first()
        took.append(time.time() - began)
        assert (got["n_removed"], got["n_aligned"]) == (n, n)
    assert took[1] < 4 * took[0] + 10


def test_equal_rows_are_one_document(spark):
    rows = [(1, "the first line of five words")] + [(None, "the first line of five words\nand one more of five words")] * 5000 + [(2, "and one more of five words\nx")] * 2000
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("k", "n_removed", "kept_text").count().collect()
    assert sorted((r["n_removed"], r["kept_text"], r["count"]) for r in got) == [(0, "the first line of five words\nand one more of five words", 5000), (1, "", 1), (1, "x", 2000)]


def test_line_dedup(spark):
    df = fx.docs(spark)
    got = line_dedup.line_dedup(df).collect()
    rows = fx.pairs(df)
    assert len(got) == len(rows)
    first = {}
    for d, t in rows:
        for line in t.split("\n"):
            first[line] = min(first.get(line, fx.key(d)), fx.key(d))
    removed = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(fx.key(d), []).append(t.split("\n"))
    for r in got:
        kept = Counter(r["kept_text"].split("\n"))
        lines = next(x for x in texts[r["k"]] if len(x) == r["n_lines"] and not kept - Counter(x) or r["kept_text"] == "")
        for line in (Counter(lines) - kept if r["n_removed"] else ()):
            assert not line.strip() or first[line] < r["k"]  # an earlier document keeps it
        removed += r["n_removed"]
    assert removed > 20
    copies = {r["k"]: r["n_removed"] for r in got}
    assert copies[60] > 0 and copies[0] == 0
    assert line_dedup.line_dedup(fx.empty(spark)).count() == 0


def test_lines_that_stand_twice_in_the_first_holder_are_aligned(spark):
    assert line_dedup.patience([1, 5, 2, 5, 3], [8, 5, 9]) == [(1, 1)]
    assert line_dedup.patience([1, 5, 6, 2, 5, 6, 3], [8, 5, 6, 9, 5, 6, 7]) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    twice = "a passage of more than five words"
    rows = [(1, f"x\n{twice}\ny\n{twice}\nz"), *((i, f"u{i}\n{twice}\nw{i}") for i in range(2, 6))]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["k"]: r["kept_text"] for r in got} == {1: rows[0][1], **{i: f"u{i}\nw{i}" for i in range(2, 6)}}


def brute_lines(rows, least=line_dedup.WORDS):
    """Counts of the lines, not blank ones, that stay of each row: those in no block of so many words that an earlier row has."""
    solid = [(fx.key(d), [x for x in t.split("\n") if x.strip()]) for d, t in rows]
    first = {}
    for d, lines in solid:
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                first[tuple(lines[i:j])] = min(first.get(tuple(lines[i:j]), d), d)
    out = []
    for d, lines in solid:
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if first[tuple(lines[i:j])] < d and sum(len(x.split()) for x in lines[i:j]) >= least:
                    gone.update(range(i, j))
        out.append((d, tuple(x for i, x in enumerate(lines) if i not in gone)))
    return Counter(out)


def test_line_dedup_finds_every_shared_block(spark):
    import random

    rng = random.Random(11)
    verse, prose = [f"v{i} of verse"[: 2 + 9 * (i % 2)] for i in range(6)], [f"p{i} is a line of prose" for i in range(4)]
    rows = [(i, f"own {i}\n{x}\nmore {i}") for i, x in enumerate(verse)]  # earlier lone holders
    rows += [(10, "\n".join(prose[::-1])), (11, "\n".join(prose)), (12, "\n".join(prose))]  # another order first
    rows += [(20, "\n".join(["b", *verse])), (21, "\n".join(["c", *verse[:3], "", *verse[3:], "d"]))]
    rows += [(30 + i, "\n".join(rng.choice([*verse, *prose, "", "z", "y x"]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(None, "\n".join(verse)), (40, "repeated id\n" + prose[0])]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), fx.docs(spark)):
        got = line_dedup.line_dedup(docs).collect()
        assert Counter((r["k"], tuple(x for x in r["kept_text"].split("\n") if x.strip())) for r in got) == brute_lines(fx.pairs(docs))


def components(rows, n, percent):
    """Groups of the rows' numbers that links of at least so much similarity join; rows without words are one group."""
    all_ = [sets(t, n) for _, t in rows]
    groups = []
    for i, a in enumerate(all_):
        linked = lambda j: 100 * len(a & all_[j]) >= percent * len(a | all_[j]) if a and all_[j] else not a and not all_[j]  # noqa: B023, E731
        near = [g for g in groups if any(linked(j) for j in g)]
        groups = [g for g in groups if g not in near] + [sum(near, [i])]
    return groups


def test_lines_of_a_long_text_are_dropped_in_linear_time(spark):
    import time

    shared = [f"line {i} that both of them have" for i in range(20_000)]
    late = [x for i, line in enumerate(shared) for x in (line, f"own {i}")]
    docs = spark.createDataFrame([(1, "\n".join(shared)), (2, "\n".join(late))], "doc_id long, text string")
    began = time.time()
    got = {r["k"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[2]["n_removed"] == 20_000 and got[2]["kept_text"] == "\n".join(late[1::2]) and time.time() - began < 60


def test_spread_join_deals_frequent_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folioworks.llm import common

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("salt"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 and key <> 7")
    expected = Counter(map(tuple, rows.join(counts, "key").select("key", "salt", "n").collect()))
    for least in (1, 256, 10**6):
        monkeypatch.setattr(common, "ROWS", least)
        got = common.spread_join(rows, counts, "key", "salt", counts)
        assert got.columns == ["key", "salt", "n"]
        assert Counter(map(tuple, got.collect())) == expected
        assert common.spread_join(rows.limit(0), counts.limit(0), "key", "salt", counts.limit(0)).count() == 0


def test_equal_rows_share_one_list_of_spans(spark):
    import time

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words)] + [(2, f"{words} end")] * 20_000
    began = time.time()
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("doc_id", "n_removed", "kept_text").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, words, 1), (2, 40, "end", 20_000)] and time.time() - began < 90
