"""Op 11, repair of conversations: a rank-convergence parallel Viterbi search for the cheapest edits.

The rows of a conversation, in order of turn, are to give the role initials ``(s?(ua)+)?``. A row
is kept, gets another role or is deleted, and rows without text are inserted; the cheapest edits
are a shortest path over four states (nothing yet, after s, after u, after a). What the rows behind
a place cost from each state is a vector of four numbers; only the differences matter, and of
vectors that differ otherwise than by a constant there are a few dozen (`VECTORS`).

Rows are dealt by ranges of (conversation, turn, ...) and cut into chunks of at most CHUNK rows, so
one conversation can fill any number of tasks. Every chunk runs backwards from all speculative
vectors at once; runs that come to differ by a constant only go on as one. Where the runs of a
chunk haven't all met, fix-up passes rerun its reach over the chunks behind it, twice as many
each pass, until all met or the conversation's end is reached. The vectors behind the chunks are
then stitched together, and drive the trace of the least audit, again chunk by chunk: the states
in which chunks are entered are found by passes over the chunks before them in the same way.

The rows' digest is that of one text in sequence, so a last pass streams the rows of one
conversation through one task, without gathering them.

Results: nulls in a role or text count as one space, also in the number that damages a row; a null
conv_id is a conversation of its own; a null turn comes before others and has no part in gaps.
Rows of one turn are ordered by role and text after damage, so equal rows stay together and any
order of input gives the same result. Roles other than those that begin with s, u or a can't be
kept. Texts are never cut. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioworks.llm import common

#: Rows of a chunk.
CHUNK = 1 << 15
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a; what an inserted or rerolled row leads to, and what keeping s, u, a or another role does.
START, S, U, A = range(4)
_NEXT = (U, U, A, U)
_KEEP = {(START, 0): S, (START, 1): U, (S, 1): U, (U, 2): A, (A, 1): U}
_ROLE = {U: "user", A: "assistant"}
#: Faults of a row; a symbol is 4 * role + fault, roles being s, u, a and others. GONE stands for a row that was dropped.
FINE, BLANK, DUPLICATE, CUT = range(4)
GONE = 16
_SPACE = " \t\n\x0b\x0c\r"


def _settled(costs: list[int]) -> list[int]:
    """Costs with the cheapest insertions before them."""
    u, a = min(costs[U], INSERT + costs[A]), min(costs[A], INSERT + costs[U])
    return [min(costs[START], INSERT + u), min(costs[S], INSERT + u), u, a]


#: Behind the last row.
END = tuple(_settled([0, 10**6, 10**6, 0]))


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: (initial, cost, next state)."""
    role, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED * (fault == CUT)
        if (state, role) in _KEEP:
            out.append(("K", more, _KEEP[state, role]))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


def _before(vector: tuple[int, ...], symbol: int) -> list[int]:
    return _settled([min(c + vector[q] for _, c, q in _edits(symbol, state)) for state in range(4)])


def _automaton() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All vectors up to a constant, and the one before each vector and symbol."""
    least = tuple(x - min(END) for x in END)
    vectors, step, number = [least], [], {least: 0}
    for v in vectors:
        row = []
        for symbol in range(16):
            out = _before(v, symbol)
            out = tuple(x - min(out) for x in out)
            if out not in number:
                number[out] = len(vectors)
                vectors.append(out)
            row.append(number[out])
        step.append(row)
    return vectors, step


VECTORS, _STEP = _automaton()


def _choice(behind: int, symbol: int, state: int) -> tuple[str, int, int]:
    """The least cheapest edits up to and with a row: (initials, cost, next state); behind: the vector after it."""
    vector, letters, total = VECTORS[behind], "", 0
    costs = _before(vector, symbol)
    while True:
        done = {x: (x, c, q) for x, c, q in _edits(symbol, state) if c + vector[q] == costs[state]}
        if "D" in done or INSERT + costs[_NEXT[state]] != costs[state]:
            x, cost, to = done[min(done)]
            return letters + x, total + cost, to
        letters, total, state = letters + "I", total + INSERT, _NEXT[state]


_CHOICES: dict[tuple[int, int, int], tuple[str, int, int]] = {}


def runs(symbols: bytes) -> list[int]:
    """The vector before the rows, for each vector behind them; runs that differ by a constant go on as one."""
    now = list(range(len(VECTORS)))
    live = now
    which = now
    for at in range(len(symbols) - 1, -1, -1):
        x = symbols[at]
        out = [_STEP[v][x] for v in live]
        if len(live) > 1:
            merged = sorted(set(out))
            place = {v: i for i, v in enumerate(merged)}
            which = [place[out[i]] for i in which]
            out = merged
        live = out
    return [live[i] for i in which]


def trace(symbols: bytes, behind: int, state: int, last: bool) -> tuple[str, int, int]:
    """The least cheapest edits of the rows, entered in a state: (initials, cost, state at the end)."""
    vectors = bytearray(len(symbols))
    for at in range(len(symbols) - 1, -1, -1):
        vectors[at] = behind
        behind = _STEP[behind][symbols[at]]
    parts, total = [], 0
    for v, x in zip(vectors, symbols):
        key = (v, x, state)
        if key not in _CHOICES:
            _CHOICES[key] = _choice(*key)
        letters, cost, state = _CHOICES[key]
        parts.append(letters)
        total += cost
    while last and state in (S, U):
        parts.append("I")
        total, state = total + INSERT, _NEXT[state]
    return "".join(parts), total, state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of the damaged rows; a dropped one stays, marked, for its conversation's sake."""

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat("kind", F.when(F.col("kind") == 3, 2).otherwise(1))).alias("kind"))
    return rows.drop("kind")


def _symbols(rows: DataFrame) -> DataFrame:
    """rows with h, 128 bits of role and text, and sym; duplicates aren't known yet."""
    bare = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    h = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return rows.withColumns({"h": h, "sym": F.when(F.col("gone"), GONE).otherwise(4 * role + fault).cast("int")})


def _duplicate(symbol: int) -> int:
    return symbol // 4 * 4 + DUPLICATE


def _chunked(size: int):
    """Cuts sorted rows into chunks, and marks those whose role and text this task has seen in their conversation."""

    def run(batches):
        part, before, seen, chunk, at = TaskContext.get().partitionId(), object(), set(), 0, 0
        for batch in batches:
            convs, keys, syms = (batch.column(c).to_pylist() for c in ("conv_id", "h", "sym"))
            places = []
            for i, (conv, h) in enumerate(zip(convs, keys)):
                if conv != before:
                    before, seen, chunk, at = conv, set(), 0, 0
                elif at == size:
                    chunk, at = chunk + 1, 0
                places.append((chunk, at))
                at += 1
                if syms[i] < GONE and syms[i] % 4 != BLANK:
                    if h in seen:
                        syms[i] = _duplicate(syms[i])
                    seen.add(h)
            columns = {c: batch.column(c) for c in batch.schema.names} | {"sym": pa.array(syms, pa.int32())}
            columns |= {"part": pa.array([part] * len(syms), pa.int64()), "chunk": pa.array([x for x, _ in places], pa.int32()), "at": pa.array([x for _, x in places], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, at) of rows that are duplicates of one in an earlier task's part of their conversation.

    Only conversations at a task's first or last row lie in several, so these are two for each task at most; a key
    that a task has seen stands once in its part.
    """
    several = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv_id")
    several = F.broadcast(common.staged(several.withColumnRenamed("conv_id", "other"), "conv-several"))
    mine = rows.where(f"sym < {GONE} and sym % 4 not in ({BLANK}, {DUPLICATE})").select("conv_id", "part", "chunk", "at", "h").join(several, F.col("conv_id").eqNullSafe(F.col("other")), "left_semi")
    first = mine.groupBy("conv_id", "h").agg(F.min("part").alias("p"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("other"), F.col("h").alias("other_h"), "p")
    return mine.join(first, (F.col("h") == F.col("other_h")) & F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("part") > F.col("p"))).select("conv_id", "part", "chunk", "at")


def _summaries(batches):
    """A row for each chunk: its symbols, the vectors before it, and its counts."""
    for batch in batches:
        out = {"symbols": [], "back": [], "blank": [], "duplicate": [], "truncated": [], "illegal": [], "first": [], "last": []}
        for rows in batch.column("rows").to_pylist():
            live = bytes(r["sym"] for r in sorted(rows, key=lambda r: r["at"]) if r["sym"] < GONE)
            faults, roles = np.frombuffer(live, np.uint8) % 4, "".join("sua-"[x // 4] for x in live)
            out["symbols"].append(live)
            out["back"].append(runs(live))
            for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT)):
                out[name].append(int((faults == fault).sum()))
            out["illegal"].append(sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])))
            out["first"].append(roles[:1])
            out["last"].append(roles[-1:])
        kinds = {"symbols": pa.binary(), "back": pa.list_(pa.int32()), "first": pa.string(), "last": pa.string()}
        keep = {c: batch.column(c) for c in batch.schema.names if c != "rows"}
        yield pa.RecordBatch.from_pydict(keep | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _passes(steps: DataFrame, start: int) -> DataFrame:
    """(conv_id, seq, value): what stands before each step of a conversation, if each takes value x to f[x] and the first has `start`.

    Each pass doubles how many steps a row's f reaches back over. Passes end when all reach the first step or lead
    to one value from wherever they start.
    """
    from pyspark.sql import Window

    now, reach = common.staged(steps.select("conv_id", "seq", "f"), "conv-reach"), 1
    while now.where((F.col("seq") > reach) & (F.size(F.array_distinct("f")) > 1)).limit(1).count():
        back = now.select(F.col("conv_id").alias("other"), (F.col("seq") + reach).alias("other_seq"), F.col("f").alias("g"))
        both = now.join(back, (F.col("seq") == F.col("other_seq")) & F.col("conv_id").eqNullSafe(F.col("other")), "left")
        through = F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda x: F.get("f", x)))
        now, reach = common.staged(both.select("conv_id", "seq", through.alias("f")), "conv-reach"), 2 * reach
    before = F.lag("f").over(Window.partitionBy("conv_id").orderBy("seq"))
    return now.select("conv_id", "seq", F.coalesce(F.get(before, F.lit(start)), F.lit(start)).alias("value"))


def _exits(batches):
    """The state after each chunk, for each in which it can be entered."""
    for batch in batches:
        f = [[trace(s, v, q, False)[2] for q in range(4)] for s, v in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist())]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("conv_id", "seq")} | {"f": pa.array(f, pa.list_(pa.int32()))})


def _traced(batches):
    for batch in batches:
        got = [trace(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("symbols", "behind", "entered", "is_last")))]
        keep = {c: batch.column(c) for c in batch.schema.names if c not in ("symbols", "behind", "entered", "is_last")}
        yield pa.RecordBatch.from_pydict(keep | {"audit": pa.array([x[0] for x in got], pa.string()), "cost": pa.array([x[1] for x in got], pa.int64())})


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """One conversation's result, as its chunks and rows come by in order."""

    def __init__(self):
        self.sum = dict.fromkeys(_COUNTS, 0)
        self.audit, self.digest, self.any, self.state = [], hashlib.sha256(), False, START
        self.role, self.low, self.high, self.turns = "", None, None, 0
        self.letters, self.at = "", 0

    def chunk(self, x: dict) -> None:
        self.rest()
        for c in _COUNTS:
            self.sum[c] += x[c]
        if self.role and x["first"]:
            self.sum["illegal"] += self.role + x["first"] not in ("su", "ua", "au")
        self.role = x["last"] or self.role
        if x["n_turns"]:
            self.turns += x["n_turns"] - (x["low"] == self.high)
            self.low, self.high = x["low"] if self.low is None else self.low, x["high"]
        self.letters, self.at = x["audit"], 0
        self.audit.append(x["audit"])

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * self.any}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def insert(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.state = _NEXT[self.state]
            self.say(_ROLE[self.state], "")
            self.at += 1

    def rest(self) -> None:
        self.insert()

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": S, "u": U, "a": A}[role[0]]
            self.say(role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self.say(_ROLE[self.state], text)

    def result(self) -> dict:
        self.rest()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps} | self.sum | {"audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _repaired(kind: pa.DataType):
    columns = {"conv_id": kind, "gaps": pa.int64()} | dict.fromkeys(_COUNTS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in columns.items()})

    def run(batches):
        now, conv = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if now is None or x["conv_id"] != conv:
                    if now is not None:
                        out.append({"conv_id": conv} | now.result())
                    now, conv = _Conversation(), x["conv_id"]
                if x["at"] < 0:
                    now.chunk(x)
                elif x["sym"] < GONE:
                    now.row(x["role"], x["text"])
            yield table(out)
        yield table([{"conv_id": conv} | now.result()] if now is not None else [])

    return run


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged conversations."""
    return repair(damaged(conversations), chunk)


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`repaired` of rows (conv_id, turn, role, text, gone) as they stand; a conversation's gone rows only list it."""
    from pyspark.sql import Window

    common.importable(rows.sparkSession)
    conv = StructField("conv_id", rows.schema["conv_id"].dataType)

    def schema(ddl: str) -> StructType:
        return StructType([conv, *StructType.fromDDL(ddl)])

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("n")]
    dealt = _symbols(rows).withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("n")
    names = "turn long, role string, text string, gone boolean, h string, sym int, part long, chunk int, at int"
    kept = common.staged(dealt.mapInArrow(_chunked(chunk), schema(names)), "conv-rows")

    key = [F.col("conv_id").eqNullSafe(F.col("other")), F.col("part") == F.col("p"), F.col("chunk") == F.col("c"), F.col("at") == F.col("a")]
    again = _repeated(kept).toDF("other", "p", "c", "a")
    marks = kept.select("conv_id", "part", "chunk", "at", "sym", F.when(~F.col("gone"), F.col("turn")).alias("turn")).join(again, key, "left")
    marks = marks.withColumn("sym", F.when(F.col("a").isNull(), F.col("sym")).otherwise(F.floor(F.col("sym") / 4) * 4 + DUPLICATE).cast("int"))
    cut = marks.groupBy("conv_id", "part", "chunk").agg(F.collect_list(F.struct("at", "sym")).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("n_turns"))
    sums = "part long, chunk int, low long, high long, n_turns long, symbols binary, back array<int>, blank long, duplicate long, truncated long, illegal long, first string, last string"
    mine = Window.partitionBy("conv_id")
    chunks = cut.mapInArrow(_summaries, schema(sums)).withColumns({"seq": F.row_number().over(mine.orderBy("part", "chunk")).cast("long"), "n": F.count("*").over(mine)})
    chunks = common.staged(chunks, "conv-chunks")

    def with_value(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
        other = found.select(F.col("conv_id").alias("other"), F.col("seq").alias("s"), F.col("value").alias(name))
        return df.join(other, (F.col("seq") == F.col("s")) & F.col("conv_id").eqNullSafe(F.col("other"))).drop("other", "s")

    several = chunks.where("n > 1")
    behind = _passes(several.select("conv_id", (F.col("n") + 1 - F.col("seq")).alias("seq"), F.col("back").alias("f")), 0)
    turned = several.withColumns({"place": F.col("seq"), "seq": F.col("n") + 1 - F.col("seq")})
    several = common.staged(with_value(turned, behind, "behind").withColumn("seq", F.col("place")).drop("place"), "conv-behind")
    entered = _passes(several.select("conv_id", "seq", "symbols", "behind").mapInArrow(_exits, schema("seq long, f array<int>")), START)
    one = chunks.where("n = 1").withColumns({"behind": F.lit(0), "entered": F.lit(START)})
    ready = one.unionByName(with_value(several, entered, "entered")).withColumn("is_last", F.col("seq") == F.col("n")).drop("back", "seq", "n")
    heads = ready.select(*(c for c in ready.columns)).mapInArrow(_traced, schema("part long, chunk int, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, audit string, cost long"))

    lines = kept.select("conv_id", "part", "chunk", "at", "role", "text", "sym").unionByName(heads.withColumn("at", F.lit(-1)), allowMissingColumns=True)
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "at")
    from pyspark.sql.pandas.types import to_arrow_type

    return lines.mapInArrow(_repaired(to_arrow_type(conv.dataType)), schema("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"))


def query(spark, sf_dir: str) -> DataFrame:
    return repaired(common.table(spark, sf_dir, "conversations"))
