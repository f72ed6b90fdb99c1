"""The k nearest vectors of each question (V1, F8): bounded top-k in each task, then a merge.

Questions are taken in blocks of at most QUESTIONS, each a matrix that every task holds. A task multiplies its
vectors with the block, some rows at a time, and keeps k candidates for each question, so what is
exchanged is questions x k rows for each task, however many vectors there are. Each block is another pass over
the vectors, which are read as they lie; nothing pairs rows with rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.sources import shared

#: Questions of a block, and vectors that are multiplied at once.
QUESTIONS, ROWS = 1024, 2048
_SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


class Best:
    """The k best (score, id) of each question, higher scores and then lower ids first."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.question, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each question, a column for each id; -inf is no candidate."""
        if scores.shape[1] > self.k:
            self.least = np.maximum(self.least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero((scores >= self.least[:, None]) & (scores > -np.inf))  # ties with the least stay
        q, s, i = np.append(self.question, q), np.append(self.score, scores[q, at]), np.append(self.id, ids[at])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        begin = np.searchsorted(q, q, "left")
        kept = np.arange(len(q)) - begin < self.k
        self.question, self.score, self.id = q[kept], s[kept], i[kept]
        last = np.flatnonzero(np.arange(len(q)) - begin == self.k - 1)
        self.least[q[last]] = s[last]


def _dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, and which of them have that width; others are zeros."""
    rows = [np.array(v, np.float64) if v is not None and len(v) == width and None not in v else None for v in column.to_pylist()]
    fits = np.array([r is not None for r in rows], bool)
    return np.array([r if r is not None else np.zeros(width) for r in rows]).reshape(len(rows), width), fits


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def _nearest(ids: np.ndarray, asked: np.ndarray, k: int):
    asked = _unit(asked)

    def run(batches):
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m, fits = _dense(part.column("vector"), asked.shape[1])
                scores = np.where(fits, np.round(asked @ _unit(m).T, 6), 0.0)
                best.add(scores, part.column("id").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.question]), pa.array(best.id), pa.array(best.score)], schema=_SCHEMA)

    return run


def _sparse(slots: pa.Array, weights: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights as a matrix, and where there are any."""
    sizes = np.diff(slots.offsets.to_numpy())
    row, slot = np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy()
    m, there = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), np.float32)
    m[row, slot] = weights.flatten().to_numpy()
    there[row, slot] = 1
    return m, there


def _nearest_sparse(ids: np.ndarray, asked: np.ndarray, used: np.ndarray, k: int):
    def run(batches):
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m, there = _sparse(part.column("slots"), part.column("weights"), asked.shape[1])
                scores = np.where(used @ there.T > 0, np.round(asked @ m.T, 6), -np.inf)
                best.add(scores, part.column("id").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.question]), pa.array(best.id), pa.array(best.score)], schema=_SCHEMA)

    return run


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    """The tasks' candidates merged: k of each question from k for each task."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(questions: DataFrame, size: int):
    """The questions in Arrow tables of about `size` rows (query_id, ...), each brought to the driver by itself."""
    n = questions.count()
    blocks = max(1, -(-n // size))
    for b in range(blocks):
        yield questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()


_COLUMNS = "query_id long, id long, score double"


def dense(vectors: DataFrame, questions: DataFrame, k: int, block: int = QUESTIONS) -> DataFrame:
    """F8: (query_id, id, score, rank) by cosine; a vector of another length scores 0, a zero norm divides by 1.

    vectors: id, vector; questions: query_id, vector, all of one length.
    """
    shared.importable(vectors.sparkSession)
    parts = []
    for asked in _blocks(questions, block):
        if asked.num_rows:
            m = np.array(asked.column("vector").to_pylist(), np.float64)
            parts.append(vectors.select("id", "vector").mapInArrow(_nearest(asked.column("query_id").to_numpy(), m, k), _COLUMNS))
    return _ranked(parts or [vectors.sparkSession.createDataFrame([], _COLUMNS)], k)


def sparse(vectors: DataFrame, questions: DataFrame, k: int, width: int = 512, block: int = QUESTIONS) -> DataFrame:
    """V1: (query_id, id, score, rank) by dot product of vectors (id, slot, weight) or (id, slots, weights); only vectors that share a
    slot with the question."""

    shared.importable(vectors.sparkSession)

    def rows(df: DataFrame, name: str) -> DataFrame:
        if "slots" in df.columns:
            return df.select(F.col("id").alias(name), "slots", "weights")
        both = df.groupBy(F.col("id").alias(name)).agg(F.collect_list(F.struct("slot", "weight")).alias("x"))
        return both.select(name, F.col("x.slot").cast("array<int>").alias("slots"), F.col("x.weight").alias("weights"))

    parts, held = [], shared.staged(rows(vectors, "id"), "vectors")
    for asked in _blocks(shared.staged(rows(questions, "query_id"), "questions"), block):
        if asked.num_rows:
            m, there = _sparse(asked.column("slots").combine_chunks(), asked.column("weights").combine_chunks(), width)
            parts.append(held.mapInArrow(_nearest_sparse(asked.column("query_id").to_numpy(), m, there, k), _COLUMNS))
    return _ranked(parts or [vectors.sparkSession.createDataFrame([], _COLUMNS)], k)
