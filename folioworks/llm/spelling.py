"""Op 13, spelling variants: a trie of letter-group counts, searched with a budget of one surplus and one deficit.

A word's vector counts its letters in each group of GROUPS. One replaced, inserted or deleted letter raises
one count by one at most and lowers one by one at most. The vectors form a trie, a level for each
group; a search for a word's near words follows the branches whose counts are its own, one that is higher by
one and one that is lower by one, and so comes to leaves whose words are verified letter by letter. Each
pair is found from one side: the first count that differs is the higher one of the word that is found.

The trie is as large as the vocabulary, so its upper levels are walked by Spark: a node of more words than
NODE is opened, and the words that reach it, with what they have spent, are joined with its children. A node
that is small enough, with the words that reach it, is a task's group, where a depth-first search of many
words at a time goes on. Where many words reach a node, or a node of the last level holds many, both are dealt
into blocks of bounded size, every block against every other. Words of one leaf and length are paired by an
equal first or second half, not all with all.

Results: a null text has no words, a null doc_id counts as empty in the number that damages a run; rows that
repeat a doc_id or text count each; words are compared whole, however long; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common

#: Letter groups, in the order of the trie's levels; all others are one more group.
GROUPS = ("e", "a", "i", "o", "u", "n", "r", "t", "s", "l", "h", "cdg", "bmpw")
#: Words shorter, or rarer, are none; a form is so many times as frequent as its word.
LETTERS, OFTEN, TIMES = 5, 3, 2
#: Of so many damaged runs one loses a letter.
DAMAGED = 97
#: Words of a node or block that a task takes, and of a leaf whose words are compared with all that reach it.
NODE, LEAF = 20_000, 24
#: Nodes of a level that are broadcast; more are joined by a shuffle in which a node of many words is dealt over several tasks.
NODES = 50_000
#: Bytes that are compared at once.
BLOCK = 1 << 23

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_LEVEL = np.full(256, len(GROUPS), np.int64)
for _n, _letters in enumerate(GROUPS):
    _LEVEL[[*_letters.encode("latin-1")]] = _n


def vocabulary(docs: DataFrame, letters: int = LETTERS, often: int = OFTEN) -> DataFrame:
    """(word, n) of the damaged runs of letters."""
    runs = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _count(word: Column, group: str) -> Column:
    return F.length(word) - F.length(F.translate(word, group, ""))


def _joined(rows: DataFrame, nodes: DataFrame, n: str) -> DataFrame:
    """rows joined with their nodes' row (path, n, ...); n: about how many rows a node has."""
    nodes = common.staged(nodes, "spelling-level")
    if nodes.count() <= NODES:
        return rows.join(F.broadcast(nodes), "path")
    return common.spread_join(rows, nodes, "path", "word", nodes, n)


def _dealt(words: DataFrame, node: int) -> DataFrame:
    """(path, word, n, spent): the words that reach each node of at most so many words, or of the last level.

    spent: 0 for words of the node itself, 1 for those that have spent a surplus, 2 for both.
    """
    active = words.select(F.lit("").alias("path"), "word", "n", F.lit(0).alias("spent"))
    done, size = None, words.count()
    for group in GROUPS if size > node else ():
        own = _count(F.col("word"), group)
        step = F.when(F.col("spent") == 0, F.array(F.struct(own.alias("c"), F.lit(0).alias("s")), F.struct((own + 1).alias("c"), F.lit(1).alias("s"))))
        step = step.when(F.col("spent") == 1, F.array(F.struct(own.alias("c"), F.lit(1).alias("s")), F.struct((own - 1).alias("c"), F.lit(2).alias("s")))).otherwise(F.array(F.struct(own.alias("c"), F.lit(2).alias("s"))))
        to = active.select("path", "word", "n", F.explode(step).alias("to")).select(F.concat_ws(",", "path", "to.c").alias("path"), "word", "n", F.col("to.s").alias("spent"))
        nodes = active.where("spent = 0").groupBy(F.concat_ws(",", "path", own).alias("path")).agg(F.count("*").alias("held"))
        to = common.staged(_joined(to, nodes, "held"), "spelling-reach")
        small = to.where(F.col("held") <= node).drop("held")
        done = small if done is None else done.unionByName(small)
        active = to.where(F.col("held") > node).drop("held")
        if active.isEmpty():
            return done
    return active if done is None else done.unionByName(active)


def _blocks(reach: DataFrame, node: int) -> DataFrame:
    """(path, row, column, word, n, spent, own): each node's own words in rows, and those that reach it in columns, of bounded blocks."""
    counts = reach.groupBy("path").agg(F.count_if(F.col("spent") == 0).alias("own_n"), F.count("*").alias("all_n"))
    counts = counts.select("path", "all_n", F.ceil(F.col("own_n") / node).cast("int").alias("rows"), F.ceil(F.col("all_n") / (4 * node)).cast("int").alias("columns"))
    rows = _joined(reach, counts, "all_n")
    place = F.xxhash64("word")
    own = rows.where("spent = 0").select("path", F.pmod(place, "rows").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), "word", "n", "spent", F.lit(True).alias("own"))
    guests = rows.select("path", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(place, "columns").cast("int").alias("column"), "word", "n", "spent", F.lit(False).alias("own"))
    return own.unionByName(guests)


class _Words:
    """Words as bytes one after another, a byte for each letter, and their vectors."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        width = len(GROUPS) + 1
        which = np.repeat(np.arange(len(raw)), self.size) * width + _LEVEL[self.data[:-1]]
        self.vector = np.bincount(which, minlength=len(raw) * width).reshape(-1, width).astype(np.int32)

    def half(self, which: np.ndarray, n: int, last: bool) -> list[bytes]:
        begin = self.start[which] + (self.size[which] - n if last else 0)
        return [self.data[b : b + n].tobytes() for b in begin.tolist()]


def _matching(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray, n: np.ndarray, last: bool) -> np.ndarray:
    """How many of n letters agree from the beginning, or the end, on."""
    width = int(n.max(initial=0))
    place = np.arange(width)
    inside = place < n[:, None]
    if last:
        p, q = (w.start[x][:, None] + w.size[x][:, None] - 1 - place for w, x in ((a, i), (b, j)))
    else:
        p, q = (w.start[x][:, None] + place for w, x in ((a, i), (b, j)))
    differ = (a.data[np.where(inside, p, 0)] != b.data[np.where(inside, q, 0)]) | ~inside
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(i), np.int64)


def verified(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b differ by exactly one letter: what agrees at both ends is all but that one."""
    out = np.zeros(len(i), bool)
    order = np.argsort(a.size[i], kind="stable")
    at = 0
    while at < len(order):
        here = order[at : at + max(1, BLOCK // int(a.size[i[order[min(at + 4096, len(order) - 1)]]] + 1))][:4096]
        x, y = i[here], j[here]
        short, long = np.minimum(a.size[x], b.size[y]), np.maximum(a.size[x], b.size[y])
        head = _matching(a, x, b, y, short, False)
        some = np.flatnonzero((long - short <= 1) & ((head < short) | (long > short)))
        tail = _matching(a, x[some], b, y[some], short[some], True)
        out[here[some]] = np.minimum(head[some] + tail, short[some]) >= short[some] - (short[some] == long[some])
        at += len(here)
    return out


def pairs(own: _Words, guests: _Words, leaf: int = LEAF):
    """Candidates (own, guest) as arrays, from a depth-first search for all guests at once.

    Levels above the node are gone through again: a guest's counts there differ from the node's by what it has spent.
    """
    width = len(GROUPS) + 1
    order = np.lexsort(own.vector.T[::-1])
    vector = own.vector[order]
    many = len(guests.size)
    stack = [(0, len(order), 0, np.arange(many), np.zeros(many, np.int8))]
    while stack:
        lo, hi, level, guest, state = stack.pop()
        if level == width and hi - lo > leaf:
            yield from _halves(own, order[lo:hi], guests, guest, state)
        elif hi - lo <= leaf or level == width:
            each = max(1, (1 << 20) // max(1, (hi - lo) * (width - level)))
            for k in range(0, len(guest), each):
                g, s = guest[k : k + each], state[k : k + each]
                differ = vector[None, lo:hi, level:] - guests.vector[g][:, None, level:]
                more, less = np.maximum(differ, 0).sum(axis=2), np.maximum(-differ, 0).sum(axis=2)
                first = np.take_along_axis(differ, (differ != 0).argmax(axis=2)[:, :, None], axis=2)[:, :, 0] if level < width else np.zeros(more.shape, int)
                fits = (more + (s > 0)[:, None] <= 1) & (less + (s > 1)[:, None] <= 1) & ((s > 0)[:, None] | (first >= 0))
                x, y = np.nonzero(fits)
                yield order[lo + y], g[x]
        else:
            column = vector[lo:hi, level]
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), hi - lo]
            mine = guests.vector[guest, level]
            for begin, end in zip(edges, edges[1:]):
                differ = int(column[begin]) - mine
                ok = (differ == 0) | ((differ == 1) & (state == 0)) | ((differ == -1) & (state == 1))
                if ok.any():
                    stack.append((lo + begin, lo + end, level + 1, guest[ok], (state[ok] + (differ[ok] != 0)).astype(np.int8)))


def _halves(own: _Words, mine: np.ndarray, guests: _Words, guest: np.ndarray, state: np.ndarray):
    """Candidates of a full leaf: an edit leaves the first or the last half of the shorter word as it is."""
    for s in np.unique(state).tolist():
        g = guest[state == s]
        half = int(min(own.size[mine[0]], guests.size[g[0]])) // 2
        for last in (False, True):
            by: dict[bytes, list[int]] = {}
            for i, key in zip(mine.tolist(), own.half(mine, half, last)):
                by.setdefault(key, []).append(i)
            for j, key in zip(g.tolist(), guests.half(g, half, last)):
                if key in by:
                    found = np.array(by[key])
                    if last:  # those with an equal first half have been
                        seen = np.array([x == y for x, y in zip(own.half(found, half, False), guests.half(np.full(len(found), j), half, False))])
                        found = found[~seen]
                    yield found, np.full(len(found), j)


_SIDES = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _near(group: pa.Table) -> pa.Table:
    mine = group.column("own").to_numpy(zero_copy_only=False)
    a, b = group.filter(pa.array(mine)), group.filter(pa.array(~mine))
    words, others = a.column("word").to_pylist(), b.column("word").to_pylist()
    own, guests = _Words(words), _Words(others)
    left, right = [], []
    for i, j in _gathered(pairs(own, guests)):
        same = own.vector[i] == guests.vector[j]
        once = ~same.all(axis=1)
        once[~once] = [words[x] < others[y] for x, y in zip(i[~once].tolist(), j[~once].tolist())]  # of equal vectors both find each other
        i, j = i[once], j[once]
        ok = verified(own, i, guests, j)
        left.append(i[ok])
        right.append(j[ok])
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    x, y = a.select(["word", "n"]).take(pa.array(i)), b.select(["word", "n"]).take(pa.array(j))
    return pa.concat_tables([pa.table([x["word"], y["word"], y["n"]], schema=_SIDES), pa.table([y["word"], x["word"], x["n"]], schema=_SIDES)])


def _gathered(parts, size: int = 1 << 18):
    """The candidates' arrays put together to about so many."""
    now, n = [], 0
    for p in parts:
        now.append(p)
        n += len(p[0])
        if n >= size:
            yield tuple(np.concatenate([x[k] for x in now]) for k in (0, 1))
            now, n = [], 0
    if now:
        yield tuple(np.concatenate([x[k] for x in now]) for k in (0, 1))


def near_words(words: DataFrame, node: int = NODE) -> DataFrame:
    """(word, near, near_n): all that differ from a word (word, n) by exactly one letter."""
    common.importable(words.sparkSession)
    return _blocks(_dealt(words, node), node).groupBy("path", "row", "column").applyInArrow(_near, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: forms are followed, twice as far each round; a form is twice as frequent, so chains are short."""
    now = common.staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = common.staged(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = further.drop("moved")
        if further.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, node: int = NODE) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = common.staged(vocabulary(docs), "spelling-words")
    best = near_words(words, node).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    found = found.withColumn("form_n", F.when(F.col("form_n") >= TIMES * F.col("n"), F.col("form_n")))
    found = common.staged(found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "spelling-forms")
    rooted = found.join(_roots(found.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))
