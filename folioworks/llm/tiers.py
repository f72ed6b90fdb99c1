"""Op 12, hierarchical packing: documents of several lengths into windows of several sizes, without padding.

Every document is tokenized whole and closed by an end id. What fills windows of the longest size is cut
off at once; the rest of each document is routed to the tier of the smallest window that holds it. Rests
are dealt by their rows into groups of bounded size, and in each group the tiers are packed from the longest
window down: best fit decreasing among the tier's own rests, then each window's gap is filled from the
shorter tiers, by the largest whole rest that fits as long as there is one, else by the beginning of the
shortest one that is longer, whose end stays in the pool. Where the shorter tiers have run out, the emptiest
windows are taken apart to fill the others, and what one last window holds goes into windows whose sizes are
the powers of two that it is the sum of. So every window is full, and none needs padding.

Windows of one size are dealt over step groups of STEP tokens, by turns in order of their attention cost
(the sum of squared piece lengths), so steps have windows of one size, as many or one fewer, and near equal
costs.

Results: a null or empty text is the end id alone; rows that repeat a doc_id are packed each, dealt by
their row's number; a very long text fills windows of its own but for its rest; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common, packing

#: Window sizes, powers of two.
TIERS = (128, 512, 2048)
END = 1
#: Rests that one task packs, and tokens of a step.
GROUP, STEP = 8192, 1 << 14

_COLUMNS = "k long, row long, start long, length long, doc_tokens long, ids_crc32 long"


def _rests(vocabulary: str, ranks: str, longest: int):
    """Documents as pieces: full windows of the longest size, and the rest with its ids, two bytes each where they fit."""
    schema = pa.schema([(c, pa.int64()) for c in ("k", "row", "start", "length", "doc_tokens", "ids_crc32")] + [("ids", pa.binary())])

    def run(batches):
        encode = packing.encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for k, row, text in zip(*(batch.column(c).to_pylist() for c in ("k", "row", "text")), strict=True):
                ids = np.append(encode(text), np.array([END], "<u4"))
                for at in range(0, len(ids), longest):
                    piece = ids[at : at + longest]
                    kept = None if len(piece) == longest else piece.astype("<u2" if piece.max() < 1 << 16 else "<u4").tobytes()
                    rows.append((k, row, at, len(piece), len(ids), zlib.crc32(piece.tobytes()), kept))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return run


class _Pool:
    """Pieces (length, item, start) by length."""

    def __init__(self, pieces):
        self.by: dict[int, list] = {}
        self.some = 0  # bit n: there is a piece of length n
        for p in pieces:
            self.put(p)

    def put(self, p) -> None:
        self.by.setdefault(p[0], []).append(p)
        self.some |= 1 << p[0]

    def _take(self, n: int):
        p = self.by[n].pop()
        if not self.by[n]:
            self.some ^= 1 << n
        return p

    def fitting(self, gap: int):
        """The longest piece of at most so many tokens."""
        n = (self.some & ((1 << (gap + 1)) - 1)).bit_length() - 1
        return self._take(n) if n >= 0 else None

    def beginning(self, gap: int, below: int):
        """The beginning of the shortest piece that is longer than the gap, and of at most `below` tokens."""
        over = self.some >> (gap + 1)
        n = gap + (over & -over).bit_length()
        if not over or n > below:
            return None
        _, item, start = self._take(n)
        self.put((n - gap, item, start + gap))
        return gap, item, start

    def filled(self, window: list, gap: int, below: int) -> int:
        """Fills a window's gap from pieces of at most `below` tokens; returns what is left of the gap."""
        while gap > 0 and (p := self.fitting(min(gap, below)) or self.beginning(gap, below)):
            window.append(p)
            gap -= p[0]
        return gap


def arranged(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Full windows, each a list of pieces (length, item, start), of items shorter than the longest window."""
    pool, out = _Pool((int(n), i, 0) for i, n in enumerate(lengths)), []
    for width, below in zip(reversed(tiers), (*reversed(tiers[:-1]), 0)):
        mine = []
        while (p := pool.fitting(width)) and p[0] > below:
            mine.append(p)
        if p:
            pool.put(p)
        where = packing.best_fit(np.array([p[0] for p in mine], np.int64), width)
        windows: list[list] = [[] for _ in range(int(where.max(initial=-1)) + 1)]
        for p, b in zip(mine, where.tolist()):
            windows[b].append(p)
        held = lambda w: sum(p[0] for p in w)
        open_ = []
        for w in sorted(windows, key=held, reverse=True):
            (open_ if pool.filled(w, width - held(w), below) else out).append(w)
        while len(open_) > 1:  # the shorter tiers have run out
            spare = _Pool(open_.pop())
            while open_ and spare.some:
                w = open_[0]
                if not spare.filled(w, width - held(w), width):
                    out.append(open_.pop(0))
            rest = [p for ps in spare.by.values() for p in ps]
            if rest:
                open_.append(rest)
        if open_:
            spare, left = _Pool(open_[0]), held(open_[0])
            for bit in reversed(range(width.bit_length())):
                if left >> bit & 1:
                    spare.filled(w := [], 1 << bit, width)
                    out.append(w)
    return out


def steps(costs: list[int], each: int) -> list[int]:
    """The step group of each window, at most `each` in one: by turns, there and back, in order of cost."""
    groups = max(1, -(-len(costs) // each))
    out = [0] * len(costs)
    for n, i in enumerate(sorted(range(len(costs)), key=costs.__getitem__, reverse=True)):
        turn, place = divmod(n, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


def _packed(tiers: tuple[int, ...], step: int):
    names = ("k", "row", "start", "length", "doc_tokens", "ids_crc32")
    more = ("sequence_id", "offset", "tier", "step_group")

    def run(group: pa.Table) -> pa.Table:
        rows, number = group.to_pylist(), group.column("g")[0].as_py() << 32
        short = [r for r in rows if r["ids"] is not None]
        windows = arranged(np.array([r["length"] for r in short], np.int64), tiers)
        windows = [[(n, short[i], at) for n, i, at in w] for w in windows] + [[(r["length"], r, 0)] for r in rows if r["ids"] is None]
        sizes = [sum(n for n, _, _ in w) for w in windows]
        group_of, before = [0] * len(windows), 0
        for size in sorted(set(sizes)):
            which = [i for i, s in enumerate(sizes) if s == size]
            dealt = steps([sum(n * n for n, _, _ in windows[i]) for i in which], max(1, step // size))
            for i, s in zip(which, dealt):
                group_of[i] = number + before + s
            before += max(dealt) + 1
        out = {c: [] for c in names + more}
        for i, w in enumerate(windows):
            offset = 0
            for n, r, at in w:
                crc = r["ids_crc32"]
                if n < r["length"]:
                    ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['length']}")[at : at + n]
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                for c, v in zip(out, (r["k"], r["row"], r["start"] + at, n, r["doc_tokens"], crc, number + i, offset, sizes[i], group_of[i])):
                    out[c].append(v)
                offset += n
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str = public_tokenizers.path("byte_bpe_50k.json"), ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken"), group: int = GROUP, step: int = STEP) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its window's size), step_group.

    tiers: powers of two, ascending; the last is a sequence's size.
    """
    rows = common.keyed(docs).select("k", F.monotonically_increasing_id().alias("row"), "text")
    rests = common.staged(rows.mapInArrow(_rests(vocabulary, ranks, tiers[-1]), f"{_COLUMNS}, ids binary"), "rests")  # row numbers are fixed here
    groups = max(1, -(-rests.count() // group))
    dealt = rests.withColumn("g", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInArrow(_packed(tiers, step), f"{_COLUMNS}, sequence_id long, offset long, tier long, step_group long")
    return packed.select(common.doc_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
