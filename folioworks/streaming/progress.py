"""The progress of ingest runs as a state machine with timers.

Each worker's events become progress rows in order of event time, whatever order they come in: a row waits until
the watermark has passed it. A run begins with a worker's first event and ends GAP after its last; while it is
idle a timer makes a heartbeat every BEAT. All of that follows from event time, so a batch that is run again
makes the same rows, and the sink keeps each batch under its number.

A worker's rows are one group, since each state follows from the one before: they are sorted once, in packed columns of
20 bytes a row, and go out in frames of MOST rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from folioworks.sources import shared

#: Milliseconds.
GAP, BEAT = 4 * 3_600_000, 3_600_000
ROWS = "worker long, run long, seq long, type string, at long, event_id long, found long, processed long, errors long"
#: Rows that wait lie in the state as packed columns: times, ids and places in the list of kinds.
_STATE = "times binary, ids binary, codes binary, kinds array<string>, run long, last long, beats long, seq long, found long, processed long, errors long"
#: Rows of a frame that a step gives.
MOST = 500_000


@dataclass
class Run:
    """What is known of a worker; times in microseconds."""

    times: bytes = b""  # events that the watermark hasn't passed, in order: int64
    ids: bytes = b""  # int64
    codes: bytes = b""  # int32
    kinds: list = field(default_factory=list)  # the types that codes stand for, sorted
    run: int | None = None  # when the run began
    last: int = 0
    beats: int = 0
    seq: int = 0
    found: int = 0
    processed: int = 0
    errors: int = 0

    def waiting(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(self.times, np.int64), np.frombuffer(self.ids, np.int64), np.frombuffer(self.codes, np.int32)

    def _keep(self, times: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> None:
        self.times, self.ids, self.codes = times.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), codes.astype(np.int32).tobytes()

    def take(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Rows (times, ids, types) in any order; they are sorted once, however many parts they come in, and repeats go."""
        given = [np.unique(np.asarray(types, object), return_inverse=True) for _, _, types in parts]
        kinds = sorted({*self.kinds, *(k for said, _ in given for k in said)})
        place = {k: n for n, k in enumerate(kinds)}
        times, ids, codes = self.waiting()
        columns = [(times, ids, np.array([place[k] for k in self.kinds], np.int32)[codes])]
        columns += [(t, i, np.array([place[k] for k in said], np.int32)[of]) for (t, i, _), (said, of) in zip(parts, given)]
        times, ids, codes = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((codes, ids, times))
        times, ids, codes = times[order], ids[order], codes[order]
        new = np.ones(len(times), bool)
        new[1:] = (np.diff(times) != 0) | (np.diff(ids) != 0) | (np.diff(codes) != 0)
        self.kinds = kinds
        self._keep(times[new], ids[new], codes[new])

    def advance(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Rows of what lies before the watermark, and what timers make before it: heartbeats and ends of runs."""
        times, ids, codes = self.waiting()
        passed = int(np.searchsorted(times, watermark, "left"))
        for at in range(0, passed, MOST // 8):
            to = min(at + MOST // 8, passed)
            yield from self._rows(times[at:to], ids[at:to], codes[at:to], int(times[to]) if to < passed else watermark)
        if not passed:
            yield from self._rows(times[:0], ids[:0], codes[:0], watermark)
        self._keep(times[passed:], ids[passed:], codes[passed:])

    def _rows(self, times: np.ndarray, ids: np.ndarray, codes: np.ndarray, until: int) -> Iterator[pd.DataFrame]:
        """Rows of events in order, and of the idle time before each and up to `until`."""
        going, n = self.run is not None, len(times)
        # idle times: after the last event that was here before (if its run goes on), and after each of these
        since = np.concatenate([[self.last] if going else [], times]).astype(np.int64)
        if not len(since):
            return
        idle = np.append(since[1:], until) - since
        made = np.zeros(len(since), np.int64)
        made[0] = self.beats if going else 0
        beats = np.maximum((np.minimum(idle, 1000 * GAP) - 1) // (1000 * BEAT), made)
        over = idle > 1000 * GAP
        # what each idle time follows: an event (with a start before it, if it begins a run), or nothing new
        new = np.ones(len(since), bool)
        new[0] = not going
        begins = np.append(not going, over[:-1]) & new
        run = np.maximum.accumulate(np.where(begins, since, self.run if going else since[0]))
        kind = np.array(self.kinds, object)
        said = np.full(len(since), None, object)
        said[len(since) - n :] = kind[codes]
        event = np.zeros(len(since), np.int64)
        event[len(since) - n :] = ids
        shown = new.copy()
        if going:
            shown[0] = False

        def counted(mine: np.ndarray, before: int) -> np.ndarray:
            """Sums within each run."""
            total = np.cumsum(mine) + (before if going else 0)
            base = np.where(begins, total - mine, 0)
            return total - np.maximum.accumulate(base)

        found = counted((shown & ((said == "scan") | (said == "filter"))).astype(np.int64), self.found)
        processed = counted((shown & (said == "done_file")).astype(np.int64), self.processed)
        errors = counted((shown & (said == "error")).astype(np.int64), self.errors)
        sizes = begins.astype(np.int64) + shown + (beats - made) + over
        row = np.repeat(np.arange(len(since)), sizes)
        step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        step += np.where(begins[row], 0, 1) + np.where(shown[row], 0, 1)  # 0: start, 1: the event, then heartbeats, then the end
        beat = step - 1 + made[row]
        done = over[row] & (beat == beats[row] + 1)
        start, own = step == 0, step == 1
        pulse = ~start & ~own & ~done
        types = np.where(start, "start", np.where(own, said[row], np.where(done, "done", "heartbeat")))
        at = since[row] + np.where(pulse, 1000 * BEAT * beat, 0) + np.where(done, 1000 * GAP, 0)
        runs = run[row]
        numbers = np.arange(len(row))
        first = np.maximum.accumulate(np.where(start, numbers, 0)) if len(row) else numbers
        before = np.cumsum(start) == 0  # of the run that was going on
        seq = np.where(before, numbers + (self.seq if going else 0), numbers - first)
        none = ~start
        frame = pd.DataFrame({
            "run": runs, "seq": seq, "type": types, "at": at, "event_id": pd.arrays.IntegerArray(event[row], ~own),
            "found": found[row] * none, "processed": processed[row] * none, "errors": errors[row] * none,
        })
        for k in range(0, len(frame), MOST):
            yield frame.iloc[k : k + MOST]
        self.last, self.beats = int(since[-1]), int(beats[-1])
        if over[-1]:
            self.run, self.beats, self.seq, self.found, self.processed, self.errors = None, 0, 0, 0, 0, 0
        else:
            self.run, self.found, self.processed, self.errors = int(run[-1]), int(found[-1]), int(processed[-1]), int(errors[-1])
            self.seq = int(seq[-1]) + 1 if len(seq) else self.seq

    def timer(self) -> int | None:
        """When there is something to do next."""
        due = [int(t) for t in self.waiting()[0][:1]]
        if self.run is not None:
            due.append(min(self.last + 1000 * BEAT * (self.beats + 1), self.last + 1000 * GAP))
        return min(due, default=None)


def _step(key, batches, state):
    run = Run(*(list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else bytes(x) if isinstance(x, bytearray) else x for x in state.get)) if state.exists else Run()
    watermark = 1000 * state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        parts = []
        for pdf in batches:
            on_time = pdf[pdf["us"] >= watermark]
            parts.append((on_time["us"].to_numpy(np.int64), on_time["event_id"].to_numpy(np.int64), on_time["type"].to_numpy(object)))
        run.take(parts)
    for rows in run.advance(watermark):
        rows.insert(0, "worker", int(key[0]))
        yield rows.astype({c: "Int64" for c in rows.columns if c != "type"})
    due = run.timer()
    if due is None:
        if state.exists:
            state.remove()
    else:
        state.update(tuple(getattr(run, f.name) for f in fields(run)))
        state.setTimeoutTimestamp(max(due // 1000, watermark // 1000) + 1)


def tracked(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Progress rows (see ROWS; at and run in microseconds) of a stream (worker, event_id, at, type)."""
    shared.importable(events.sparkSession)
    timed = events.withWatermark("at", late).select("worker", "event_id", "type", "at", F.unix_micros("at").alias("us"))
    return timed.groupBy("worker").applyInPandasWithState(_step, ROWS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def kept(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there; each batch's rows lie under its number, so one that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gathered(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream over what is there."""
    spark = stream.sparkSession
    path = shared.place(spark, name)
    kept(stream, path, shared.place(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")
