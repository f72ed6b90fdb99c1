"""Op 3, near duplicates by SetSketch registers.

A document's set holds its distinct shingles of words (A-Z lower-cased). A register is the
exponentially spaced, truncated minimum of one hash over the set: floor(1 - log_b(min)),
kept in 16 bits, so sketches of parts merge by their maximum and two sets agree in a
register with a probability of about their Jaccard similarity. Bands of registers propose
pairs; the joint likelihood of all registers, given the exact set sizes, drops hopeless
ones; the full sets confirm the rest with integers, and what they confirm stays.

Equal sets are one class, and only class representatives are compared. Within a bucket of a
band nodes are compared with its leader, not with each other. What a node differs in from
the leader is kept: a node that the leader doesn't link is compared with the others by those
differences, in blocks of bounded size, which loses no link that the bands propose.

Results: empty sets (null, empty or blank texts) link with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are nodes of their own that share
the id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common, links
from folioworks.llm import textkit as tk

BANDS, ROWS = 24, 5
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: A pair goes on to its full sets unless the estimate is so many standard errors below the threshold.
ERRORS = 6
#: Nodes of a side of a block.
BLOCK = 256


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after another, and each row's count."""
    data = tk.lower(data)
    w = tk.words(data, off)
    h = tk.span_hash(data, w.start, w.end)
    at, gram = tk.grams(h, w.first, n)
    edge = np.searchsorted(at, w.first)
    sets = []
    for r in range(len(off) - 1):
        i, j = w.first[r], w.first[r + 1]
        if 0 < j - i < n:
            sets.append(tk.grams(h[i:j], np.array([0, j - i]), int(j - i))[1])
        else:
            sets.append(np.unique(gram[edge[r] : edge[r + 1]]))
    return np.concatenate(sets) if sets else gram, np.array([len(x) for x in sets], np.int64)


def registers(values: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """SetSketch registers of each row's values, (rows, count); an empty row has zeros."""
    out = np.zeros((len(sizes), count), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begin = (np.cumsum(sizes) - sizes)[full]
    keys = tk.mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    for i in range(count):
        low = np.minimum.reduceat(values * (keys[2 * i] | tk.u64(1)) + keys[2 * i + 1], begin)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[full, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of row pairs of registers whose set sizes are known."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        up = fit(low + third) < fit(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def _features(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            key, hash_ = batch.column("k"), batch.column("h")
            for b in tk.blocks(batch.column("text")):
                values, sizes = shingle_sets(b.data, b.off, n)
                regs = registers(values, sizes, bands * rows)
                total = np.concatenate([[0], np.cumsum(values, dtype=np.uint64)]).astype(np.uint64)
                mixed = np.concatenate([[0], np.cumsum(tk.mix(values), dtype=np.uint64)]).astype(np.uint64)
                end = np.cumsum(sizes)
                one, two = total[end] - total[end - sizes], mixed[end] - mixed[end - sizes]
                band = np.zeros((len(sizes), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    band = tk.mix(band * tk.u64(0x9E3779B97F4A7C15) + regs[:, i::rows])
                raw = pa.array([x.tobytes() for x in regs], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [key[b.rows], hash_[b.rows], tk.longs(sizes), tk.longs(one), tk.longs(two), tk.lists(band.ravel(), np.full(len(sizes), bands)), raw],
                    ["k", "h", "n", "one", "two", "bands", "regs"],
                )

    return run


def _promising(threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_registers(batch.column(c)) for c in ("regs_a", "regs_b"))
                got = likely_jaccard(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(got >= _least(threshold, a.shape[1])))

    return run


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _least(threshold: float, count: int) -> float:
    return threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / count)


def _differences(n: int, percent: int):
    """Of each pair: both sizes, whether its full sets link, and what one set has and the other hasn't."""

    def run(batches):
        last, mine = None, None
        for batch in batches:
            n_a, n_b, linked, diffs = [], [], [], []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if last is None or not x.equals(last):  # rows of one leader mostly stand together
                    data = np.frombuffer(x, np.uint8)
                    last, mine = x, shingle_sets(data, np.array([0, len(data)]), n)[0]
                data = np.frombuffer(y, np.uint8)
                theirs = shingle_sets(data, np.array([0, len(data)]), n)[0]
                diff = np.setxor1d(mine, theirs, assume_unique=True)
                total = len(mine) + len(theirs)
                n_a.append(len(mine))
                n_b.append(len(theirs))
                linked.append(100 * (total - len(diff)) >= percent * (total + len(diff)))
                diffs.append(diff)
            sizes = np.array([len(d) for d in diffs], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(linked, pa.bool_()), tk.lists(np.concatenate(diffs) if diffs else np.zeros(0, np.uint64), sizes)],
                ["a", "b", "n_a", "n_b", "linked", "diff"],
            )

    return run


def _blocks(percent: int):
    """Links between the open and all nodes of a block, from what they differ in from their leader; as many as keep its components."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        open_ = block.column("open").to_numpy(zero_copy_only=False)
        at, to = np.flatnonzero(open_), np.flatnonzero(~open_)
        size, nodes = block.column("n").to_numpy(), block.column("node").to_pylist()
        diff = block.column("diff").chunk(0) if block.num_rows else pa.array([], pa.list_(pa.int64()))
        value, number = diff.flatten().to_numpy(), np.diff(diff.offsets.to_numpy())
        row = np.repeat(np.arange(len(number)), number)
        _, column, count = np.unique(value, return_inverse=True, return_counts=True)
        often = np.cumsum(count > 1) - 1
        row, column = row[count[column] > 1], often[column[count[column] > 1]]
        both = np.zeros((len(at), len(to)), np.float32)
        for i in range(0, int((count > 1).sum()), 4096):
            part = (column >= i) & (column < i + 4096)
            has = np.zeros((len(number), 4096), np.float32)
            has[row[part], column[part] - i] = 1
            both += has[at] @ has[to].T
        apart = number[at][:, None] + number[to][None] - 2 * both.astype(np.int64)
        total = size[at][:, None] + size[to][None]
        x, y = np.nonzero(100 * (total - apart) >= percent * (total + apart))
        root = {}

        def find(v):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        out = []
        for i, j in zip(at[x].tolist(), to[y].tolist(), strict=True):
            one, two = ((nodes[k]["k"], nodes[k]["h"]) for k in (i, j))
            if find(one) != find(two):
                root[find(one)] = find(two)
                out.append((nodes[i], nodes[j]))
        kind = pa.struct([("k", pa.int64()), ("h", pa.int64())])
        return pa.table({"a": pa.array([p[0] for p in out], kind), "b": pa.array([p[1] for p in out], kind)})

    return run


_NODE = "struct<k:bigint,h:bigint>"


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: k, h (see common.keyed), n_shingles, and root_k, root_h: the component's smallest node.

    With the defaults a pair at the threshold shares no band with a probability below 1e-6.
    """
    base = common.keyed(docs)
    features = common.staged(base.mapInArrow(_features(shingle, bands, rows), "k long, h long, n long, one long, two long, bands array<long>, regs binary"), "sketches")
    same = ["n", "one", "two"]
    classes = features.where("n > 0").groupBy(same).agg(F.min(F.struct("k", "h")).alias("node"), F.any_value("bands").alias("bands"))
    classes = common.staged(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), "node")
    # each bucket's smallest node leads it; the others are compared with it
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1")
    shared = common.staged(shared, "shared")
    buckets = common.staged(common.spread_join(buckets, shared, "bucket", "node", shared).select("a", "node"), "buckets")
    involved = buckets.select("node.k", "node.h").distinct()
    texts = base.join(involved, ["k", "h"]).dropDuplicates(["k", "h"]).select(F.struct("k", "h").alias("node"), "text")
    texts = common.staged(texts, "texts")
    sketches = features.join(involved, ["k", "h"]).dropDuplicates(["k", "h"]).select(F.struct("k", "h").alias("node"), "n", "regs")
    sketches = common.staged(sketches, "involved")

    def side(df, name):
        return df.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in df.columns[1:]))

    pairs = common.staged(buckets.select("a", F.col("node").alias("b")).where("a <> b").distinct(), "pairs")
    led = common.staged(pairs.groupBy("a").agg(F.count("*").alias("n")), "led")
    pairs = common.spread_join(pairs, led, "a", "b", led)
    alone, more = pairs.where("n = 1").drop("n"), pairs.where("n > 1").drop("n")
    alone = alone.join(side(sketches, "b"), "b").join(side(sketches, "a"), "a").mapInArrow(_promising(percent / 100), f"a {_NODE}, b {_NODE}")
    compared = alone.union(more).join(side(texts, "b"), "b")
    compared = common.spread_join(compared, side(texts, "a"), "a", "b", led).select("a", "b", "text_a", "text_b")
    compared = compared.mapInArrow(_differences(shingle, percent), f"a {_NODE}, b {_NODE}, n_a long, n_b long, linked boolean, diff array<long>")
    compared = common.staged(compared, "compared")
    found = compared.where("linked").select("a", "b")
    # a node that its leader doesn't link can link with others it leads: compared in blocks of bounded size
    groups = compared.groupBy("a").agg(F.count("*").alias("all"), F.count_if(~F.col("linked")).alias("open")).where("open > 0 and all > 1")
    groups = common.staged(groups, "groups")
    member = common.spread_join(compared, groups, "a", "b", groups, "all")
    parts = {name: F.ceil(F.col(name) / BLOCK).cast("int") for name in ("all", "open")}

    def dealt(rows, mine: str, other: str):
        spread = F.explode(F.sequence(F.lit(0), parts[other] - 1)).alias(other)
        return rows.select("a", F.pmod(F.xxhash64("b"), parts[mine]).cast("int").alias(mine), spread, F.lit(mine == "open").alias("is_open"), F.col("b").alias("node"), F.col("n_b").alias("n"), "diff")

    blocks = dealt(member.where("not linked"), "open", "all").unionByName(dealt(member, "all", "open")).withColumnsRenamed({"open": "i", "all": "j", "is_open": "open"})
    found = found.union(blocks.groupBy("a", "i", "j").applyInArrow(_blocks(percent), f"a {_NODE}, b {_NODE}"))
    out = features.join(classes.select(*same, "node"), same, "left").select("k", "h", F.col("n").alias("n_shingles"), F.coalesce("node", F.struct("k", "h")).alias("node"))
    out = out.join(links.components(found), "node", "left").withColumn("node", F.coalesce("root", "node"))
    return out.select("k", "h", "n_shingles", F.col("node.k").alias("root_k"), F.col("node.h").alias("root_h"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select(common.doc_id(), "n_shingles", common.doc_id("root_k").alias("component_id"), (F.col("k") == F.col("root_k")).alias("kept"))
