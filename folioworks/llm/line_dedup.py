"""Op 4, line dedup by pairwise alignment.

The unit is a run: the shortest block of lines, from a line on or up to it, with at least WORDS words; a line
of that many is a run of its own, and every block that can be deleted is made of runs. A run belongs to the
first document that holds it. A later document is paired with each first holder of a rare run that it has:
one that stands in at most RARE places, or than which none that it shares is rarer; both sequences of the runs that bind the two, with their places, are
aligned by patience diff, the rarest runs first, and what is aligned is deleted from the later document. Runs
that the alignment leaves, because they stand in another order or their holder shares no rare run, are deleted
by the index of first holders itself: so nothing that an earlier document has stays, and `n_aligned` says how
many lines the alignment took.

A document's runs go to their holders and come back with these holders' places, as many for each run as the
document has itself. So the exchange is in proportion to the documents' lines, whatever the partners.

Results: a line goes if it lies in a block of at least WORDS words that an earlier document has
too, blank lines left out; lines end at line feeds and are compared as they are; blank lines pair nothing and
go with the block around them; a null or empty text has one empty line; rows that repeat a
doc_id are told apart by their texts, equal rows are one document and get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common, textkit

#: A run's words at least, and the places in which a rare one stands at most, in all documents.
WORDS, RARE = 5, 100


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal items, by anchors that are unique in both parts, then what adjoins them.

    A part without such an anchor is aligned by its rarest shared item, the n-th one with the n-th.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        seen: dict[int, list[int]] = {}
        for side, items, start, stop in ((0, a, i0, i1), (1, b, j0, j1)):
            for n in range(start, stop):
                x = seen.setdefault(items[n], [0, 0, 0, 0])
                x[side] += 1
                x[2 + side] = n
        pairs = sorted((x[2], x[3]) for x in seen.values() if x[0] == x[1] == 1)
        if not pairs:
            rare = min(((x[0] * x[1], x[2]) for x in seen.values() if x[0] and x[1]), default=None)
            if rare:
                item = a[rare[1]]
                pairs = list(zip((n for n in range(i0, i1) if a[n] == item), (n for n in range(j0, j1) if b[n] == item)))
        tails, ends, back = [], [], [-1] * len(pairs)  # longest increasing run of places in b
        for n, (_, j) in enumerate(pairs):
            p = bisect_left(tails, j)
            back[n] = ends[p - 1] if p else -1
            tails[p : p + 1], ends[p : p + 1] = [j], [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if chain:
            edges = [(i0 - 1, j0 - 1), *chain[::-1], (i1, j1)]
            out += chain
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def _joined(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int, seed: int):
    """Of each line, the run that begins there: hash, number of further lines, and whether it has words enough."""
    n = len(hashes)
    total, run, more = words.copy(), hashes.copy(), np.zeros(n, np.int64)
    at = np.arange(n)
    for step in range(1, least):
        going = at[: max(0, n - step)]
        going = going[(total[going] < least) & (doc[going] == doc[going + step])]
        run[going] = textkit.mix(textkit.mix(run[going] + textkit.u64(0x9E3779B97F4A7C15 * seed)) * textkit.u64(0x9E3779B97F4A7C15) + hashes[going + step])
        total[going] += words[going + step]
        more[going] = step
    return run, more, total >= least


def runs(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, place: np.ndarray, least: int):
    """(doc, run, start, end) of the runs of solid lines, in order of documents and runs; arrays of one length."""
    run, more, ok = _joined(hashes, words, doc, least, 1)
    found = [(doc[ok], run[ok], place[ok], place[np.flatnonzero(ok) + more[ok]])]
    run, more, ok = (x[::-1] for x in _joined(hashes[::-1], words[::-1], doc[::-1], least, 2))
    ok = ok & (more > 0)  # a run of one line has been
    found.append((doc[ok], run[ok], place[np.flatnonzero(ok) - more[ok]], place[ok]))
    out = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((out[2], out[1], out[0]))
    return tuple(x[order] for x in out)


_RUNS = "k long, h long, run long, starts array<int>, ends array<int>"


def _listed(least: int):
    """A row for each run of each document, with its places."""

    def run(batches):
        for batch in batches:
            lines, words = (batch.column(c) for c in ("lines", "words"))
            size = np.diff(lines.offsets.to_numpy())
            values = lines.flatten()
            solid = np.flatnonzero(~values.is_null().to_numpy(zero_copy_only=False))
            doc = np.repeat(np.arange(len(size)), size)[solid]
            place = (np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size))[solid]
            hashes = values.fill_null(0).to_numpy(zero_copy_only=False)[solid].view(np.uint64)
            d, r, start, end = runs(hashes, words.flatten().to_numpy(zero_copy_only=False)[solid].astype(np.int64), doc, place, least)
            new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]))) if len(d) else np.zeros(0, np.int64)
            edges = pa.array(np.append(new, len(d)).astype(np.int32))
            places = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(d[new])) for c in ("k", "h")), textkit.longs(r[new]), *places], ["k", "h", "run", "starts", "ends"])

    return run


def aligned(shared: list[dict], rare: int = RARE) -> tuple[list[int], int]:
    """Places that go of a document, and how many of them by alignment.

    shared: of each run that an earlier document has, `early` (its first holder), run, starts, ends, places (in that
    document, as many as starts at most) and stands (in how many places of all documents).
    """
    least = max(rare, min((x["stands"] for x in shared), default=0))
    partners: dict[tuple, list[dict]] = {}
    for x in shared:
        partners.setdefault(x["early"], []).append(x)
    gone: set[int] = set()
    for those in partners.values():
        if any(x["stands"] <= least for x in those):
            late = sorted((s, e, x["run"]) for x in those for s, e in zip(x["starts"], x["ends"]))
            early = sorted((p, x["run"]) for x in those for p in x["places"])
            for _, j in patience([r for _, r in early], [r for _, _, r in late]):
                gone.update(range(late[j][0], late[j][1] + 1))
    n = len(gone)
    for x in shared:
        for start, end in zip(x["starts"], x["ends"]):
            gone.update(range(start, end + 1))
    return sorted(gone), n


def _dropped(rare: int):
    def run(batches):
        for batch in batches:
            # one document's runs at a time are Python objects
            got = [aligned([{**x, "early": (x["early"]["k"], x["early"]["h"])} for x in shared.as_py()], rare) for shared in batch.column("shared")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.int64())], ["k", "h", "drop", "n_aligned"])

    return run


def line_dedup(docs: DataFrame, least_words: int = WORDS, rare: int = RARE) -> DataFrame:
    """k, h, n_lines, n_removed, n_aligned and kept_text of each row of docs."""
    base = common.keyed(docs)
    blank = r"^[\s]*$"
    split = F.split("text", "\n", -1)
    lines = base.select(
        "k", "h",
        F.transform(split, lambda x: F.when(~x.rlike(blank), F.xxhash64(x))).alias("lines"),
        F.transform(split, lambda x: F.regexp_count(x, F.lit(r"\S+")).cast("int")).alias("words"),
    )
    lines = common.staged(lines.dropDuplicates(["k", "h"]), "lines")
    one = lines.mapInArrow(_listed(least_words), _RUNS).withColumn("node", F.struct("k", "h"))
    first = one.groupBy("run").agg(F.min(F.struct("node", F.col("starts").alias("places"))).alias("f"), F.max("node").alias("last"), F.count("*").alias("n"), F.sum(F.size("starts")).alias("stands")).where("f.node < last")
    first = common.staged(first.select("run", F.col("f.node").alias("early"), "f.places", "n", "stands"), "first-holders")
    hits = common.spread_join(one.select("node", "run", "starts", "ends"), first, "run", "node", first).where("early.k < node.k")
    hits = hits.select("node.k", "node.h", F.struct("early", "run", "starts", "ends", F.slice("places", F.lit(1), F.size("starts")).alias("places"), "stands").alias("x"))
    drop = hits.groupBy("k", "h").agg(F.collect_list("x").alias("shared")).mapInArrow(_dropped(rare), "k long, h long, drop array<int>, n_aligned long")
    out = base.join(drop, ["k", "h"], "left").withColumn("lines", split)
    # what lies between one dropped line and the next
    cuts = F.col("drop")
    parts = F.zip_with(F.concat(F.array(F.lit(-1)), cuts), F.concat(cuts, F.array(F.size("lines"))), lambda x, y: F.slice("lines", x + 2, y - x - 1))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    return out.select("k", "h", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_aligned", F.lit(0)).alias("n_aligned"), kept.alias("kept_text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(common.table(spark, sf_dir, "documents"))
    return out.select(common.doc_id(), "n_lines", "n_removed", "n_aligned", F.sha2("kept_text", 256).alias("kept_sha256"))
