"""The stored index, versions made once, and deep pages."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioworks.operators import pages, segments
from folioworks.operators.segments import Conflict, Index
from folioworks.sources import log, shared

TEXTS = {1: "red fox, red dog", 2: "a red fox runs", 3: "Fox and dog", 4: "", 5: "redder reds", 6: None, 7: "dog fox red"}


def table(spark, texts):
    return spark.createDataFrame([(i, f"Title {i}", t, None, "note") for i, t in texts.items()], "id long, title string, description string, transcription string, annotation string")


def expected(texts, words):
    said = {i: [re.findall(r"\w+", x.lower()) for x in (f"Title {i}", t or "", "", "note")] for i, t in texts.items()}
    size = {i: sum(map(len, f)) for i, f in said.items()}
    if len(words) == 1:
        tf = {i: sum(w.startswith(words[0]) for f in fs for w in f) for i, fs in said.items()}
    else:
        tf = {i: sum(f[k : k + len(words)] == words for f in fs for k in range(len(f))) for i, fs in said.items()}
    hit, mean = [i for i in tf if tf[i]], sum(size.values()) / len(size)
    idf = max(math.log((len(size) - len(hit) + 0.5) / (len(hit) + 0.5)), 1e-6)
    return {i: (tf[i], round(idf * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * size[i] / mean)), 6)) for i in hit}


def found(index, typed):
    return {r["id"]: (r["tf"], r["score"]) for r in index.scored(typed).collect()}


def same(index, texts, brief=True):
    for typed in ("fo", "red fox", "red fox runs") if brief else ("red", "dog", "r", "fox red", '"dog"', "nothing", "title 3"):
        got, want = found(index, typed), expected(texts, typed.strip('"').split())
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want), typed


def test_updates_and_merges_equal_a_rebuild(spark):
    index, texts = Index(spark, shared.place(spark, "index")), dict(TEXTS)
    index.update(table(spark, texts))
    same(index, texts)
    changed = {2: "the dog is red", 8: "a new red fox"}
    texts |= changed
    del texts[3], texts[4]
    index.update(table(spark, changed), spark.createDataFrame([(3,), (4,), (4,), (99,), (8,)], "id long"))  # 99 isn't there, 8 is changed as well
    same(index, texts)
    for bucket in index.buckets(["red", "fox"]):
        index.merge(bucket)
    same(index, texts)
    again = {3: "red fox once more", 2: None}
    texts |= again
    index.update(table(spark, again))
    same(index, texts)
    index.merge(index.buckets(["red"])[0])
    same(index, texts)
    same(index, texts, brief=False)
    assert index.version().n_docs == len(texts)
    assert found(index, "  ") == {} and found(Index(spark, shared.place(spark, "none")), "red") == {}


def test_a_search_reads_its_bucket_and_no_text(spark):
    index = Index(spark, shared.place(spark, "index"))
    index.update(table(spark, TEXTS))
    for typed, words in (("fox", ["fox"]), ("red fox", ["red", "fox"])):
        rows = index.phrase(words) if len(words) > 1 else index.prefix(words[0])
        read = {int(x) for f in rows.inputFiles() if "/postings/" in f for x in re.findall(r"bucket=(\d+)", f)}
        assert read == set(index.buckets(words)), typed
        assert "term" in rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]


def test_readers_keep_their_version_and_one_of_two_writers_fails(spark, monkeypatch):
    index = Index(spark, shared.place(spark, "index"))
    old = index.update(table(spark, TEXTS))
    index.update(table(spark, {1: "fox"}))
    before = {r["id"] for r in index.prefix("dog", old).collect()}
    assert before == {1, 3, 7} and {r["id"] for r in index.prefix("dog").collect()} == {3, 7}
    monkeypatch.setattr(Index, "version", lambda self: old)
    with pytest.raises(Conflict):
        index.update(table(spark, {2: "lost"}))
    monkeypatch.undo()
    assert {r["id"] for r in index.prefix("runs").collect()} == {2}


def test_an_entry_is_made_once(spark):
    folder = shared.place(spark, "log")
    assert log.last(spark, folder) == (-1, None)
    assert log.put(spark, folder, 0, {"a": 1}) and not log.put(spark, folder, 0, {"a": 2})
    open(f"{folder.removeprefix('file://')}/{5:012d}.json", "w").close()  # of a writer that died
    assert log.last(spark, folder, 0.2) == (5, {"a": 1})
    os.remove(f"{folder.removeprefix('file://')}/{5:012d}.json")
    assert log.put(spark, folder, 1, {"b": "é"}) and log.last(spark, folder) == (1, {"b": "é"}) and log.read(spark, folder, 0) == {"a": 1}


def test_deep_pages(spark):
    df = spark.range(60_000).select("id", (F.col("id") * 7919 % 1000).alias("key"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("other"))
    order = [F.desc_nulls_last("other"), F.asc("key"), F.asc("id")]
    rows = sorted(df.collect(), key=lambda r: (r["other"] is None, -(r["other"] or 0), r["key"], r["id"]))
    for number, size in ((1, 50), (201, 50), (700, 80), (300, 200), (301, 200), (99_999, 50)):
        assert pages.page(df, order, number, size).collect() == rows[(number - 1) * size : number * size]
    ranged = pages.ranged(df, order, 30)
    sizes = pages.counts(ranged)
    assert sum(n for _, n in sizes) == 60_000 and len(sizes) > 20
    which, before = pages.picked(sizes, 30_000, 50)
    assert 1 <= len(which) <= 2 and before < dict(sizes)[which[0]]
    files = pages.numbered(ranged, order, sizes, 30_000, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in files or "PartitionFilters: [range" in files


def test_picked_ranges():
    sizes = [(0, 10), (2, 5), (3, 20)]
    assert pages.picked(sizes, 0, 10) == ([0], 0) and pages.picked(sizes, 9, 2) == ([0, 2], 9)
    assert pages.picked(sizes, 10, 5) == ([2], 0) and pages.picked(sizes, 14, 30) == ([2, 3], 4) and pages.picked(sizes, 35, 5)[0] == []
    assert segments.BUCKETS > 1


def test_a_large_segment_is_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(segments, "WORDS", 500)
    texts = {i: f"red fox {i % 7} " * 20 + "fox" for i in range(100)}
    index = Index(spark, shared.place(spark, "index"), buckets=2, splits=1)
    index.update(table(spark, texts))
    index.merge(index.buckets(["fox"])[0])
    for typed in ("fo", "red fox"):
        got, want = found(index, typed), expected(texts, typed.split())
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)
    rows = spark.read.parquet(f"{index.path}/postings/segment=0").groupBy(F.input_file_name()).agg(F.sum(F.size("positions"))).collect()
    assert len(rows) > 10 and max(r[1] for r in rows) < 1500  # 6,300 words, most of them in few terms


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """A segment is written in one pass: no words are staged to be read again."""
    names, staged = [], shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
    index = Index(spark, shared.place(spark, "index"), buckets=2, splits=1)
    index.update(table(spark, TEXTS))
    assert names == ["terms"] and index.version().total == sum(len(re.findall(r"\w+", f"Title {i} {t or ''} note")) for i, t in TEXTS.items())
