"""Op 9, packing token sequences: best fit, then a swap-based local search.

Every document is tokenized whole, closed by an end id and, only if longer than a sequence,
cut into full pieces behind a shorter first one. Pieces are dealt by a hash into groups of
bounded size; in each, best fit decreasing fills sequences, and a local search then takes
the sequences that have room, the emptiest first: documents move to others, or go one for one
or two for one against shorter ones, whenever the sum of squared fills grows, until sequences
empty. The search ends at the least number of sequences that the lengths allow, or after a
round over all sequences with room in which none became empty.

Results: a null or empty text is the end id alone; rows that repeat a doc_id are packed each,
dealt by their row's number, so however many equal ones spread over the groups; a text of one
long run of any character is encoded like others; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common

CAPACITY = 2048
END = 0
#: Pieces that one task packs.
GROUP = 20_000
#: Texts of these characters get the same ids from both libraries; others go to the reference one.
_PLAIN = re.compile(r"[\t-\r -~\xa0-ɏ]*")
#: So do texts with a run of white space as long as this: the faster library's pattern gives up at a million.
_RUN = 100_000


def plain(text: str) -> bool:
    """Whether the faster library gives the text the reference's ids."""
    if not _PLAIN.fullmatch(text) or "<|" in text:
        return False
    return len(text) < _RUN or max(map(len, re.findall(r"\s\s+", text)), default=0) < _RUN


def encoder(vocabulary: str, ranks: str):
    """text -> ids of the byte-level BPE in the two files, which hold one vocabulary."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    full = []

    def encode(text: str) -> np.ndarray:
        if plain(text):
            return np.array(fast.encode_ordinary(text), "<u4")
        if not full:
            full.append(Tokenizer.from_file(vocabulary))
        return np.array(full[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def _pieces(vocabulary: str, ranks: str, capacity: int):
    schema = pa.schema([("k", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for k, row, text in zip(*(batch.column(c).to_pylist() for c in ("k", "row", "text")), strict=True):
                ids = np.append(encode(text), np.array([END], "<u4"))
                cut = len(ids) % capacity or capacity
                edges = [0, *range(min(cut, len(ids)), len(ids) + 1, capacity)]
                rows += [(k, row, n, i, j - i, zlib.crc32(ids[i:j].tobytes())) for n, (i, j) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, longest first into the fullest bin that has room."""
    where = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, 0  # bit r: a bin with r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i] = b
        if r > n:
            room[r - n].append(b)
            some |= 1 << (r - n)
    return where


def local_search(lengths: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """Empties bins by moves and by one-for-one and two-for-one exchanges that increase the sum of squared fills."""
    where = where.copy()
    fill = np.bincount(where, lengths, minlength=int(where.max(initial=-1)) + 1).astype(np.int64)
    live = np.flatnonzero(fill[where] < capacity)  # pieces of full bins stay
    size, place = lengths[live], where[live]
    least = -(-int(size.sum()) // capacity)
    open_ = np.unique(place)
    while len(open_) > least:
        before = len(open_)
        for low in open_[np.argsort(fill[open_], kind="stable")].tolist():
            while _improved(low, size, place, fill, capacity):
                pass
            before -= fill[low] == 0
            if before == least:
                break
        emptied, open_ = before < len(open_), np.unique(place)
        if not emptied:
            break
    where[live] = place
    return where


def _improved(low: int, size: np.ndarray, place: np.ndarray, fill: np.ndarray, capacity: int) -> bool:
    """Makes the move or exchange of one bin's pieces that raises the sum of squared fills most; False if none does."""
    mine = np.flatnonzero(place == low)
    # pieces of one length are alike, here and, with the room beside them, in the other bins
    of, first, count = np.unique(size[mine], return_index=True, return_counts=True)
    give = {int(n): (int(mine[i]),) for n, i in zip(of, first)}
    for x in range(len(of)):
        for y in range(x, len(of)):
            two = np.flatnonzero(size[mine] == of[x])[:2] if x == y else (first[x], first[y])
            if x != y or count[x] > 1:
                give.setdefault(int(of[x] + of[y]), tuple(int(mine[i]) for i in two))
    others = np.flatnonzero(place != low)
    kind = size[others] * (capacity + 1) + capacity - fill[place[others]]
    kind, at_first = np.unique(kind, return_index=True)
    length, left = kind // (capacity + 1), kind % (capacity + 1)
    ahead, best = capacity - left - fill[low], None
    for n, which in give.items():
        gain = n - length  # for one document of another bin
        score = np.where((gain > 0) & (gain <= left), gain * (ahead + gain), 0)
        at = int(np.argmax(score)) if len(score) else 0
        if len(score) and score[at] > 0 and (best is None or score[at] > best[0]):
            best = (int(score[at]), which, int(others[at_first[at]]), True)
        if len(which) == 1 and len(score):
            score = np.where(left >= n, n * (ahead + n), 0)
            at = int(np.argmax(score))
            if score[at] > 0 and (best is None or score[at] >= best[0]):
                best = (int(score[at]), which, int(others[at_first[at]]), False)
    if best is None:
        return False
    _, which, at, exchange = best
    to, change = int(place[at]), int(size[list(which)].sum())
    place[list(which)] = to
    if exchange:
        place[at] = low
        change -= int(size[at])
    fill[to] += change
    fill[low] -= change
    return True


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        lengths, number = group.column("length").to_numpy(), group.column("g").to_numpy()
        where = local_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        _, begin = np.unique(where[order], return_index=True)
        offset = np.zeros(len(order), np.int64)
        offset[order] = before - np.repeat(before[begin], np.diff(np.append(begin, len(order))))
        return group.drop_columns(["g"]).append_column("sequence_id", pa.array((number << 32) + where)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = public_tokenizers.path("byte_bpe_50k.json"), ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    columns = "k long, row long, piece int, start long, length long, ids_crc32 long"
    rows = common.keyed(docs).select("k", F.monotonically_increasing_id().alias("row"), "text")
    pieces = common.staged(rows.mapInArrow(_pieces(vocabulary, ranks, capacity), columns), "pieces")  # row numbers are fixed here
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInArrow(_packed(capacity), f"{columns}, sequence_id long, offset long")
    return packed.select(common.doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
