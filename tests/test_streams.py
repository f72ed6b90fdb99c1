"""Streams of several files: order, late rows, timers and batches that are run again."""

import datetime as dt
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioworks.sources import shared
from folioworks.streaming import progress, windows

DAY = dt.datetime(2024, 3, 1)


def stream(spark, files):
    """A stream that reads one file for each batch: rows (worker, event_id, minutes, type)."""
    folder = shared.place(spark, "files").removeprefix("file://")
    os.makedirs(folder)
    for n, rows in enumerate(files):
        frame = pd.DataFrame([(w, e, DAY + dt.timedelta(minutes=m), k) for w, e, m, k in rows], columns=["worker", "event_id", "at", "type"])
        frame.to_parquet(f"{folder}/{n}.parquet", coerce_timestamps="us")
        os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", F.col("at").cast("timestamp"))



FILES = [
    [(1, 10, 0, "scan"), (1, 12, 5, "done_file"), (1, 11, 3, "processing")],
    [(1, 13, 4, "error"), (1, 14, 150, "done_file")],  # 13 comes late, but within the watermark
    [(1, 15, 9, "error"), (1, 12, 5, "done_file"), (1, 16, 900, "filter")],  # 15 is later than it
    [(1, 17, 2000, "processing")],
]


def minutes(rows):
    first = min(r["at"] for r in rows)
    return sorted(((r["run"] - first) // 60_000_000, r["seq"], r["type"], (r["at"] - first) // 60_000_000, r["event_id"], r["found"], r["processed"], r["errors"]) for r in rows)


def test_runs_come_in_order_with_heartbeats_and_ends(spark):
    rows = progress.gathered(progress.tracked(stream(spark, FILES)), "runs").collect()
    assert minutes(rows) == [
        (0, 0, "start", 0, None, 0, 0, 0),
        (0, 1, "scan", 0, 10, 1, 0, 0),
        (0, 2, "processing", 3, 11, 1, 0, 0),
        (0, 3, "error", 4, 13, 1, 0, 1),
        (0, 4, "done_file", 5, 12, 1, 1, 1),
        (0, 5, "heartbeat", 65, None, 1, 1, 1),
        (0, 6, "heartbeat", 125, None, 1, 1, 1),
        (0, 7, "done_file", 150, 14, 1, 2, 1),
        (0, 8, "heartbeat", 210, None, 1, 2, 1),
        (0, 9, "heartbeat", 270, None, 1, 2, 1),
        (0, 10, "heartbeat", 330, None, 1, 2, 1),
        (0, 11, "done", 390, None, 1, 2, 1),
        (900, 0, "start", 900, None, 0, 0, 0),
        (900, 1, "filter", 900, 16, 1, 0, 0),
        (900, 2, "heartbeat", 960, None, 1, 0, 0),
        (900, 3, "heartbeat", 1020, None, 1, 0, 0),
        (900, 4, "heartbeat", 1080, None, 1, 0, 0),
        (900, 5, "done", 1140, None, 1, 0, 0),
    ]


def test_a_batch_that_is_run_again_replaces_itself(spark):
    path, checkpoint = shared.place(spark, "runs"), shared.place(spark, "checkpoint")
    files = stream(spark, FILES)
    progress.kept(progress.tracked(files), path, checkpoint)
    before = minutes(spark.read.parquet(f"{path}/batch=*").collect())
    commits = f"{checkpoint.removeprefix('file://')}/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    os.remove(f"{commits}/{last}")  # as if the driver had been lost before it noted the batch
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    progress.kept(progress.tracked(files), path, checkpoint)
    assert minutes(spark.read.parquet(f"{path}/batch=*").collect()) == before


def test_late_rows_of_windows(spark):
    files = [[(1, 1, 0, "a"), (1, 2, 100, "a")], [(1, 3, 95, "a")], [(1, 6, 91, "a"), (1, 4, 30, "a")], [(1, 5, 400, "a")]]
    # Spark drops rows by the watermark of the batch before, 90 in the third: 91 is inside, of 30 the window of 0 to 60 has gone
    rows = progress.gathered(windows.sliding(stream(spark, files), ["type"], "60 minutes", "60 minutes"), "windows").collect()
    assert sorted((r["window"].start.hour - min(x["window"].start for x in rows).hour, r["events"]) for r in rows) == [(0, 1), (1, 3)]


def test_sessions_and_repeats(spark):
    files = [[(1, 1, 0, "a"), (1, 2, 20, "a"), (2, 3, 10, "a")], [(1, 2, 20, "a"), (1, 4, 45, "a")], [(1, 9, 600, "a"), (2, 10, 600, "a")]]
    rows = progress.gathered(windows.sessions(stream(spark, files), ["worker"], "30 minutes"), "sessions").collect()
    assert sorted((r["worker"], r["events"]) for r in rows) == [(1, 4), (2, 1)]
    rows = progress.gathered(windows.once(stream(spark, files), ["event_id"]), "once").collect()
    assert sorted(r["event_id"] for r in rows) == [1, 2, 3, 4, 9, 10]


def test_interval_join_drops_what_comes_too_late(spark):
    first = [[(1, 1, 0, "c"), (2, 2, 5, "c")], [(1, 3, 300, "c")], [(1, 6, 301, "c")], [(1, 4, 20, "c"), (1, 5, 295, "c")]]
    then = [[(1, 11, 30, "p")], [(1, 12, 61, "p"), (2, 13, 4, "p"), (2, 16, 320, "p")], [(2, 18, 321, "p")], [(1, 14, 310, "p"), (1, 15, 25, "p")]]
    pairs = progress.gathered(windows.followed(stream(spark, first), stream(spark, then), "worker", "60 MINUTES"), "join").collect()
    # 4 and 15 come when rows before 290 are dropped; 5 is inside
    assert sorted((r["first_id"], r["then_id"]) for r in pairs) == [(1, 11), (3, 14), (5, 14), (6, 14)]


@pytest.mark.parametrize("watermark", [0, 10, 10**12])
def test_states_without_events_make_nothing(watermark):
    run = progress.Run()
    assert list(run.advance(watermark)) == [] and run.timer() is None


class State:
    """What a step sees of its state."""

    exists, hasTimedOut, get = False, False, None

    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, new):
        self.exists, self.get = True, new

    def remove(self):
        self.exists = False

    def setTimeoutTimestamp(self, at):
        self.due = at


def test_a_worker_of_many_events_is_sorted_once():
    n, part = 300_000, 100
    order = [k * 7919 % n for k in range(n)]  # any order; an event a second
    kinds = ("scan", "done_file", "error")
    state, began = State(0), time.time()
    frames = (pd.DataFrame({"us": [k * 1_000_000 for k in mine], "event_id": mine, "type": [kinds[k % 3] for k in mine]}) for mine in (order[i : i + part] for i in range(0, n, part)))
    assert sum(map(len, progress._step((5,), frames, state))) == 0
    state.watermark, state.hasTimedOut = 1000 * (n - 10), True
    rows = pd.concat(progress._step((5,), iter(()), state))
    assert time.time() - began < 60
    assert len(rows) == n - 10 + 1 and list(rows["seq"]) == list(range(n - 9)) and set(rows["worker"]) == {5}
    assert list(rows["event_id"][1:]) == list(range(n - 10)) and tuple(rows.iloc[-1][["found", "processed", "errors"]]) == (99_997, 99_997, 99_996)
    state.watermark = 1000 * (n + 100_000)
    rows = pd.concat(progress._step((5,), iter(()), state))
    assert [*rows["type"]][-5:] == ["error", "heartbeat", "heartbeat", "heartbeat", "done"] and rows["errors"].iloc[-1] == 100_000 and not state.exists


def test_steps_in_parts_equal_one_by_one(monkeypatch):
    """Runs by a loop over rows, against frames of few rows and watermarks anywhere."""
    hour = 3_600_000_000
    for seed in range(60):
        monkeypatch.setattr(progress, "MOST", random.Random(seed).choice((8, 80, 500_000)))
        r, run, got, all_, mark = random.Random(seed), progress.Run(), [], set(), 0
        for _ in range(4):
            rows = [(mark + r.choice((0, 1, hour, hour + 1, 4 * hour, 4 * hour + 1)) * r.randint(0, 3), r.randint(0, 9), r.choice(("scan", "error", "done_file", "other"))) for _ in range(r.randint(0, 9))]
            all_ |= set(rows)
            run.take([tuple(np.array(c, object if k == 2 else np.int64) for k, c in enumerate(zip(*rows[i : i + 3]))) for i in range(0, len(rows), 3)])
            mark += r.choice((0, hour // 2, 5 * hour, 40 * hour))
            got += [(*x[:3], x[3], None if x[4] is pd.NA else x[4], *x[5:]) for f in run.advance(mark) for x in f.itertuples(index=False)]
        want, events = [], sorted(x for x in all_ if x[0] < mark)
        begin, counts = None, None
        for n, (at, event, kind) in enumerate(events):
            if begin is None:
                begin, seq, counts = at, 0, [0, 0, 0]
                want.append((begin, seq, "start", at, None, 0, 0, 0))
            counts = [counts[0] + (kind == "scan"), counts[1] + (kind == "done_file"), counts[2] + (kind == "error")]
            after = events[n + 1][0] if n + 1 < len(events) else mark
            beats = [at + k * hour for k in (1, 2, 3) if at + k * hour < after]
            made = [(kind, at, event), *(("heartbeat", b, None) for b in beats), *([("done", at + 4 * hour, None)] if at + 4 * hour < after else [])]
            for k, t, e in made:
                seq += 1
                want.append((begin, seq, k, t, e, *counts))
            begin = None if made[-1][0] == "done" else begin
        assert [tuple(x) for x in got] == want, seed
