"""Op 10, benchmark decontamination by the q-gram lemma.

Texts are compared with A-Z lower-cased and white space runs as one space, by characters. A
benchmark item is searched by three overlapping halves, its first, middle and last: if a
document holds the whole item within the edit budget, the first or the last lies in it within
its own; any three quarters of the item hold the middle one, so they are found if their edits
are within a half's budget. Items under HALVED characters are searched whole, and, from twice
SHORTEST on, by their middle half, which counts if three quarters of the item stand around it
within the budget. Items under SHORTEST characters are searched exactly, on word boundaries.
A half of m characters found with k edits shares m - q + 1 - k q of its q-grams with the document on diagonals at most k
apart; shared q-grams are counted in overlapping bands of diagonals, bands that meet the
bound are verified by an alignment on the band's diagonals and k more at either side, and what
it finds within k edits is a hit.

The benchmark is sent to tasks in blocks of bounded bytes, each a pass over the documents.
Results: one row per document row and item; null and empty texts and items have none; rows that
repeat a doc_id are searched each; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.llm import textkit as tk

Q = 8
BUDGET = 0.08
#: Items shorter than this are searched exactly.
SHORTEST = 16
#: Items shorter than this are searched whole and by three quarters.
HALVED = 80
#: Bytes of benchmark texts that one pass holds.
PASS_BYTES = 16 << 20
_TABLE_BITS = 22


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased characters with single spaces, rows' new offsets, and which of the characters were kept."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where(blank, np.uint32(32), data + np.uint32(32) * ((data >= 65) & (data <= 90)))
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[off[:-1][off[:-1] < len(data)]] = True
    if keep.all():
        return data, off, keep
    return data[keep], np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off], keep


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


_K = 0x9E3779B97F4A7C15


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each place on: of two, then of four, then of eight."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    out, size = data.astype(np.uint64), 1
    while size < Q:
        out = out[:-size] * tk.u64(pow(_K, size, 2**64)) + out[size:]
        size *= 2
    return out


def hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of so many characters from each of the places on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * tk.u64(_K) + data[at + j]
    return out


def alignment(pattern: np.ndarray, text: np.ndarray, budget: int, first: int = 0, width: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the pattern's best place in the text if it takes at most so many edits.

    Only diagonals (place in the text less place in the pattern) from `first` on are used, so many as `width` says.
    """
    m, n = len(pattern), len(text)
    width = n + 1 if width is None else width
    low, high = max(0, first), min(n - m, first + width - 1)
    if low <= high:  # as it is
        same = (np.lib.stride_tricks.sliding_window_view(text[low : high + m], m) == pattern).all(1)
        if same.any():
            at = low + int(np.argmax(same))
            return 0, at, at + m
    far = budget + m + 1
    steps = np.arange(width)
    padded = np.full(width + m + 1, 2**32 - 1, np.uint32)  # padded[x] is the character at first + x
    inside = slice(max(0, -first), max(0, min(len(padded), n - first)))
    padded[inside] = text[max(0, first) : max(0, first) + max(0, inside.stop - inside.start)]
    begin = first + steps
    row = np.where((begin >= 0) & (begin <= n), 0, far)
    for i, c in enumerate(pattern):
        up, diagonal = np.append(row[1:], far) + 1, row + (padded[i : i + width] != c)
        use = diagonal <= up
        best, start = np.where(use, diagonal, up), np.where(use, begin, np.append(begin[1:], 0))
        place = first + i + 1 + steps
        best = np.where((place >= 0) & (place <= n), best, far)
        # a run of insertions: the least of best[j] - j so far
        lead = np.minimum.accumulate(best - steps)
        source = np.maximum.accumulate(np.where(best - steps == lead, steps, 0))
        row, begin = np.where(place <= n, lead + steps, far), start[source]
        if row.min() > budget:
            return None
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), first + m + end


class Patterns:
    """The halves of one block of items, where each q-gram stands in them, and the items too short for that."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        self.texts, self.item, self.around, self.short = [], [], [], {}
        for number, text in items:
            raw = characters(text or "")
            whole = normal(raw, np.array([0, len(raw)]))[0]
            solid = np.flatnonzero(whole != 32)
            whole = whole[solid[0] : solid[-1] + 1] if len(solid) else whole[:0]
            if len(whole) >= SHORTEST:
                cut, quarter = len(whole) // 2, len(whole) // 4
                middle = whole[quarter : quarter + cut]
                if len(whole) >= HALVED:
                    parts = [(whole[:cut], None), (middle, None), (whole[cut:], None)]
                else:
                    parts = [(whole, None), (middle, whole)] if cut >= SHORTEST else [(whole, None)]
                self.texts += [x for x, _ in parts]
                self.around += [x for _, x in parts]
                self.item += [number] * len(parts)
            elif len(whole):
                self.short.setdefault(len(whole), {}).setdefault(whole.tobytes(), []).append(number)
        size = np.array([len(x) for x in self.texts], np.int64)
        self.budget = np.floor(size * budget).astype(np.int64)
        self.bound = np.maximum(1, size - Q + 1 - self.budget * Q)
        codes = [grams(x) for x in self.texts]
        code = np.concatenate([*codes, np.zeros(0, np.uint64)])
        order = np.argsort(code, kind="stable")
        which = np.repeat(np.arange(len(codes)), [len(c) for c in codes]).astype(np.int64)
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)]).astype(np.int64)
        self.code, self.begin = np.unique(code[order], return_index=True)
        self.which, self.place = which[order], place[order]
        self.begin = np.append(self.begin, len(order))
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self._slot(self.code)] = True
        self.band = max(16, 2 * int(self.budget.max(initial=0)))

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * tk.u64(0x9E3779B97F4A7C15)) >> tk.u64(64 - _TABLE_BITS)).astype(np.int64)

    def candidates(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, pattern, least diagonal) of the bands whose shared q-grams meet the bound."""
        code = grams(data)
        at = np.flatnonzero(self.maybe[self._slot(code)]) if len(code) else np.zeros(0, np.int64)
        if not len(at) or not len(self.code):
            return []
        found = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        real = self.code[found] == code[at]
        at, found = at[real], found[real]
        row = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[row + 1]
        at, found, row = at[inside], found[inside], row[inside]
        number = self.begin[found + 1] - self.begin[found]
        index = np.repeat(self.begin[found] - np.cumsum(number) + number, number) + np.arange(int(number.sum()))
        which, diagonal = self.which[index], np.repeat(at - off[row], number) - self.place[index] + (1 << 12)
        row = np.repeat(row, number)
        out = []
        for shift in (0, self.band // 2):  # overlapping bands: one holds all diagonals that lie together
            band = (diagonal + shift) // self.band
            order = np.lexsort((band, which, row))
            r, w, b = row[order], which[order], band[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1]) | (b[1:] != b[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(r)))
            meet = count >= self.bound[w[begin]]
            out += zip(r[begin][meet].tolist(), w[begin][meet].tolist(), (b[begin][meet] * self.band - shift - (1 << 12)).tolist())
        return sorted(set(out))


    def exact(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, start, end) of the short items' first exact places on word boundaries."""
        if not self.short or not len(data):
            return []
        word = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data == 95)
        edge = np.ones(len(data) + 1, bool)  # at an end of a row, or not amid a word
        edge[1:-1] = ~(word[1:] & word[:-1])
        edge[off] = True
        out = []
        for size, texts in self.short.items():
            if size > len(data):
                continue
            at = np.flatnonzero(edge[: len(data) - size + 1] & edge[size:])
            row = np.searchsorted(off, at, "right") - 1
            inside = at + size <= off[row + 1]
            at, row = at[inside], row[inside]
            code = hashes(data, at, size)
            known = np.array([hashes(np.frombuffer(x, np.uint32), np.zeros(1, np.int64), size)[0] for x in texts], np.uint64)
            there = np.isin(code, known)
            at, row, code = at[there], row[there], code[there]
            for n in np.unique(np.stack([row.astype(np.uint64), code], 1), axis=0, return_index=True)[1] if len(at) else ():
                start = int(at[n])
                out += ((int(row[n]), item, start, start + size) for item in texts.get(data[start : start + size].tobytes(), ()))
        return out


def three_quarters(whole: np.ndarray, text: np.ndarray, budget: float) -> tuple[int, int, int] | None:
    """The best alignment of three quarters of the item, from any place on, within their edit budget."""
    size = -(-3 * len(whole) // 4)
    found = (alignment(whole[i : i + size], text, int(size * budget)) for i in range(len(whole) - size + 1))
    return min((x for x in found if x), default=None)


def _hits(items: list[tuple[int, str]], budget: float):
    schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        patterns = Patterns(items, budget)
        for batch in batches:
            key, hash_, rows = batch.column("k").to_numpy(), batch.column("h").to_numpy(), []
            for b in tk.blocks(batch.column("text")):
                begin = np.concatenate([[0], np.cumsum(pc.utf8_length(batch.column("text")[b.rows]).to_numpy(), dtype=np.int64)])  # in characters
                data, off, kept = normal(characters(b.data.tobytes().decode()), begin)
                best, found, short = {}, patterns.candidates(data, off), patterns.exact(data, off)
                old = np.flatnonzero(kept) if found or short else None  # each kept character's old place
                for r, w, diagonal in found:
                    text, k = data[off[r] : off[r + 1]], int(patterns.budget[w])
                    got, low = alignment(patterns.texts[w], text, k, diagonal - k, patterns.band + 2 * k + 1), 0
                    whole = patterns.around[w]
                    if got and whole is not None:
                        low = max(0, diagonal - k - len(whole))
                        got = three_quarters(whole, text[low : diagonal + patterns.band + k + 2 * len(whole)], budget)
                    if got:
                        edits, start, end = got[0], int(old[off[r] + low + got[1]]), int(old[off[r] + low + got[2] - 1]) + 1
                        name = (r, patterns.item[w])
                        best[name] = min(best.get(name, (edits, start, end)), (edits, start, end))
                for r, item, start, end in short:
                    best[r, item] = min(best.get((r, item), (1, 0, 0)), (0, int(old[start]), int(old[end - 1]) + 1))
                rows += ((key[b.rows][r], hash_[b.rows][r], item, edits, start - begin[r], end - begin[r]) for (r, item), (edits, start, end) in best.items())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """k, h, item_id, edits, start, end (code points) for each document and benchmark item that it holds."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    base, out = common.keyed(docs), None
    for i in range(passes):
        # a block of about PASS_BYTES, checked above
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()]
        hits = base.mapInArrow(_hits(block, budget), "k long, h long, item_id long, edits long, start long, end long")
        out = hits if out is None else out.unionByName(hits)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every contaminated document, the fewest edits and where the passage stands."""
    out = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select(common.doc_id(), "item_id", "edits", F.col("start").alias("passage_start"), F.col("end").alias("passage_end"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    hits = contaminated(docs, benchmark, budget).select("k", "h").distinct()
    return common.matched(docs, hits, "left_anti").select(*(F.col(common.quoted(c)) for c in docs.columns))
