"""Op 1, exact substring dedup by recompression.

Each document's words are renamed in rounds. A round first names every run of one symbol,
then every pair of a left and a right symbol; which side a symbol stands on is a bit of its
name. A name is a hash of what it stands for, so all tasks of all rounds give equal
substrings equal names without exchanging any. The parse of a substring can depend on its
surroundings only near its ends: every symbol carries the range of words that fixes it, and
a symbol whose range lies inside a window of n words appears in every copy of the window.

Each window is held by one such symbol, of the highest round, then the smallest name; the
name is of the symbol and of the words that fix it.
Symbols that two documents share reveal the spans of windows that can repeat; those alone are
verified, first whole spans by a name of all their words, then, where spans of one symbol
differ, their windows; with the symbol's name a span or window is told by 128 bits.

A name that very many documents share is no hot group: minimums are aggregated before they are
exchanged, kept only where two documents have the span, and staged, so that they are joined back
to the spans as any skewed join is, whose large side is split. A document's shared names are
gathered by a hash of its row, so rows of a null or repeated doc_id stay apart.

Results: a null or empty text has no words; a document with fewer than n words loses none;
equal rows (also of one doc_id) get equal results, and a window of the same doc_id doesn't
count as earlier; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.llm import textkit as tk

WINDOW = 13
ROUNDS = 2
_NONE = tk.u64(-1)
_POWER = 0xF1357AEA2E62A9C5


def recompress(sym: np.ndarray, first: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each round: names, and the range of words [lo, hi) that fixes each. Rows are apart; a range reaches over a row's edge if the edge matters."""
    n = len(sym)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for level in range(rounds):
        # runs of one symbol
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(sym))
        count = stop - begin
        base, row2 = sym[begin], row[begin]
        name = np.where(count > 1, tk.mix(base * tk.u64(0xD6E8FEB86659FD93) + count.astype(np.uint64)), base)
        # both neighbours, or the row's edges, tell where a run ends
        left = np.where(begin > 0, lo[np.maximum(begin - 1, 0)], -1)
        right = np.where(stop < len(sym), hi[np.minimum(stop, len(sym) - 1)], n + 1)
        same_l = np.zeros(len(begin), bool)
        same_l[1:] = row2[1:] == row2[:-1]
        same_r = np.append(same_l[1:], False) if len(begin) else same_l
        left = np.where(same_l, left, lo[begin] - n - 1)
        right = np.where(same_r, right, hi[stop - 1] + n + 1)
        lo, hi = np.minimum(lo[begin], left), np.maximum(hi[stop - 1], right)
        # pairs of a left and a right symbol
        side = tk.mix(base + tk.u64(level * 2 + 1)) & tk.u64(1)
        pair = np.zeros(len(name), bool)
        pair[:-1] = (side[:-1] == 0) & (side[1:] == 1) & same_l[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        nxt = np.minimum(np.arange(len(name)) + 1, max(len(name) - 1, 0))
        name = np.where(pair, tk.mix(name * tk.u64(0xA24BAED4963EE407) + name[nxt]), name)
        lo, hi = np.where(pair, np.minimum(lo, lo[nxt]), lo), np.where(pair, np.maximum(hi, hi[nxt]), hi)
        keep = ~second
        sym, row, lo, hi = name[keep], row2[keep], lo[keep], hi[keep]
        yield sym, lo, hi


def _least_covering(value: np.ndarray, begin: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Of each place, the least value whose range begin..last (inclusive) covers it, or _NONE.

    A range is two of a power of two's length that may overlap; longer ones are handed down to their halves.
    """
    length = last - begin + 1
    scale = np.frexp(length.astype(np.float64))[1] - 1
    out = None
    for j in range(int(scale.max(initial=0)), -1, -1):
        now = np.full(size, _NONE)
        if out is not None:
            now = np.minimum(now, out)
            now[1 << j :] = np.minimum(now[1 << j :], out[: size - (1 << j)])
        mine = np.flatnonzero(scale == j)
        if len(mine):
            np.minimum.at(now, begin[mine], value[mine])
            np.minimum.at(now, last[mine] + 1 - (1 << j), value[mine])
        out = now
    return out


def holders(h: np.ndarray, first: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, holder) of every window of n words: the name of the symbol that stands for it."""
    at, whole = tk.grams(h, first, n, seed=3)
    if not len(at):
        return at, whole
    held = np.zeros(len(h), np.uint64)
    held[at] = whole  # only windows inside long runs have no symbol of their own
    # sums of words times powers, by which a range of words is hashed
    power, inverse = (np.multiply.accumulate(np.concatenate([[tk.u64(1)], np.full(len(h), tk.u64(m))])) for m in (_POWER, pow(_POWER, -1, 2**64)))
    sums = np.concatenate([[tk.u64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])
    for level, (sym, lo, hi) in enumerate(recompress(h, first, rounds)):
        fits = np.flatnonzero(hi - lo <= n)
        # the words that fix the symbol are in every window that it stands for
        name = tk.mix(sym[fits] + tk.u64(level) + (sums[hi[fits]] - sums[lo[fits]]) * inverse[lo[fits]])
        best = _least_covering(name, np.maximum(hi[fits] - n, 0), lo[fits], len(h))
        held = np.where(best < _NONE, best, held)
    return at, held[at]


def _blocks(batch: pa.RecordBatch):
    for b in tk.blocks(batch.column("text")):
        w = tk.words(b.data, b.off)
        yield b, w, tk.span_hash(b.data, w.start, w.end)


def _holders(n: int, rounds: int):
    def run(batches):
        for batch in batches:
            key = batch.column("owner").to_numpy()
            for b, w, h in _blocks(batch):
                at, name = holders(h, w.first, n, rounds)
                row = np.searchsorted(w.first, at, "right") - 1
                # a row's neighbouring windows mostly share their holder
                fresh = np.ones(len(at), bool)
                fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
                name, row = name[fresh], row[fresh]
                yield pa.RecordBatch.from_arrays([tk.longs(name), pa.array(key[b.rows][row])], ["name", "owner"])

    return run


def _spans(n: int, rounds: int):
    """Runs of windows with one shared holder: a name of all their words, and of each window."""

    def run(batches):
        for batch in batches:
            key, hash_, shared = batch.column("k").to_numpy(), batch.column("h").to_numpy(), batch.column("names")
            for b, w, h in _blocks(batch):
                at, name = holders(h, w.first, n, rounds)
                row = np.searchsorted(w.first, at, "right") - 1
                # a row's own shared names; a chance match of row and name is verified as the others are
                own = shared.slice(b.rows.start, b.rows.stop - b.rows.start)
                owner = np.repeat(np.arange(len(own), dtype=np.uint64), np.diff(own.offsets.to_numpy()))
                keep = np.isin(tk.mix(name + row.astype(np.uint64) * tk.u64(_POWER)), tk.mix(own.flatten().to_numpy().view(np.uint64) + owner * tk.u64(_POWER)))
                at, row, name = at[keep], row[keep], name[keep]
                if not len(at):
                    continue
                window = np.zeros(len(at), np.uint64)
                for j in range(n):
                    window = window * tk.u64(0xD1342543DE82EF95) + h[at + j]
                window = tk.mix(window)
                new = np.ones(len(at), bool)
                new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(at)))
                place = (np.arange(len(at)) - np.repeat(begin, size)).astype(np.uint64)
                span = tk.mix(np.add.reduceat(tk.mix(window + place * tk.u64(0x9E3779B97F4A7C15)), begin) + size.astype(np.uint64))
                at, row, name = at[begin], row[begin], name[begin]
                yield pa.RecordBatch.from_arrays(
                    [tk.longs(name), tk.longs(span), pa.array(key[b.rows][row]), pa.array(hash_[b.rows][row]), pa.array((at - w.first[row]).astype(np.int32)), pa.array(size.astype(np.int32)), tk.lists(window, size)],
                    ["name", "span", "k", "h", "at", "size", "windows"],
                )

    return run


def _cut(n: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("k", "n_words", "n_removed", "kept_sha256", "kept_text")}
            key, drop = batch.column("k").to_numpy(), batch.column("drop")
            for b in tk.blocks(batch.column("text")):
                w = tk.words(b.data, b.off)
                data = b.data.tobytes()
                for r in range(b.rows.stop - b.rows.start):
                    start, end = w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]]
                    gone = np.zeros(len(start) + 1, np.int64)
                    mine = drop[b.rows.start + r].values
                    if mine is not None and len(mine):
                        at, size = (mine.field(f).to_numpy() for f in ("at", "size"))
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + size - 1 + n, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    kept = b" ".join([data[i:j] for i, j in zip(start[keep].tolist(), end[keep].tolist())])
                    for c, v in zip(out, (key[b.rows.start + r], len(start), len(start) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by a space)."""
    base = common.keyed(docs).withColumn("owner", F.xxhash64("k", "h"))
    symbols = base.select("owner", "text").mapInArrow(_holders(window, rounds), "name long, owner long")
    shared = symbols.groupBy("name").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("name")
    names = symbols.join(shared, "name").groupBy("owner").agg(F.collect_set("name").alias("names"))
    names = common.staged(names, "names")
    spans = base.join(names, "owner").mapInArrow(_spans(window, rounds), "name long, span long, k long, h long, at int, size int, windows array<long>")
    spans = common.staged(spans, "spans")
    # a span that an earlier document has whole
    earliest = spans.groupBy("name", "span").agg(F.min("k").alias("earliest"), F.max("k").alias("latest")).where("earliest < latest").drop("latest")
    earliest = common.staged(earliest, "earliest")
    whole = spans.select("name", "span", "k", "h", "at", "size").join(earliest, ["name", "span"]).where("earliest < k").select("k", "h", "at", "size")
    # the first of each span can still have single windows in other, earlier spans of its holder
    several = spans.groupBy("name").agg(F.min("span").alias("a"), F.max("span").alias("b")).where("a < b").select("name")
    several = common.staged(several, "several")
    first = spans.join(several, "name").join(earliest, ["name", "span"], "left").where("earliest is null or earliest = k")
    single = first.select("name", "k", "h", F.posexplode("windows").alias("step", "window"), "at").select("name", "window", "k", "h", (F.col("at") + F.col("step")).alias("at"))
    single = common.staged(single, "windows")
    before = single.groupBy("name", "window").agg(F.min("k").alias("earliest"), F.max("k").alias("latest")).where("earliest < latest").drop("latest")
    before = common.staged(before, "before")
    parts = single.join(before, ["name", "window"]).where("earliest < k").select("k", "h", "at", F.lit(1).alias("size"))
    # equal rows have equal spans: each is in the list once
    drop = common.staged(whole.union(parts), "drop").groupBy("k", "h").agg(F.collect_set(F.struct("at", "size")).alias("drop"))
    return base.join(drop, ["k", "h"], "left").select("k", "text", "drop").mapInArrow(_cut(window), "k long, n_words long, n_removed long, kept_sha256 string, kept_text string").select(common.doc_id(), "n_words", "n_removed", "kept_sha256", "kept_text")


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(common.table(spark, sf_dir, "documents")).drop("kept_text")
