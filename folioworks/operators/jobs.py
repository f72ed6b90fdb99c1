"""Calls to something outside Spark for each row, with retries, dead letters and resumption (K2, K7).

Rows are dealt by a hash of their key into waves, and within a wave into tasks, each of which runs a few calls
at a time. A wave's results are appended at once to a table of versions, so a job that ends early keeps its
whole waves, and the next run does only what the table hasn't got.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioworks.sources import shared
from folioworks.sources.versions import Table

RESULT = "attempts int, waited double, status string, result string, error string"


class RetryAfter(Exception):
    """The other side is busy; it may have said for how long."""

    def __init__(self, seconds: float | None = None):
        super().__init__(f"busy, retry after {seconds}" if seconds else "busy")
        self.seconds = seconds


class Permanent(Exception):
    """Trying again is of no use."""


@dataclass(frozen=True)
class Policy:
    """tries: calls of a row at most. Seconds before the next try double from `failed`, or from `limited` where the
    other side was busy and named no time."""

    tries: int = 5
    failed: float = 1.0
    limited: float = 5.0
    sleep: Callable[[float], None] = time.sleep

    def pause(self, error: Exception, attempt: int) -> float:
        if isinstance(error, RetryAfter):
            return error.seconds or self.limited * 2**attempt
        return self.failed * 2**attempt


def attempted(call: Callable[[str, int], str], request: str, policy: Policy) -> tuple[int, float, str, str | None, str | None]:
    """A row's RESULT; call gets the request and the number of the attempt, from 0."""
    waited = 0.0
    for attempt in range(policy.tries):
        try:
            return attempt + 1, waited, "ok", call(request, attempt), None
        except Permanent as error:
            return attempt + 1, waited, "dead", None, f"{type(error).__name__}: {error}"
        except Exception as error:  # noqa: BLE001 a call is any user's code
            if attempt + 1 == policy.tries:
                return attempt + 1, waited, "dead", None, f"{type(error).__name__}: {error}"
            pause = policy.pause(error, attempt)
            waited += pause
            policy.sleep(pause)
    raise ValueError("no tries")


def results(items: DataFrame, path: str) -> Table:
    """The table of an operation's results: the items' key and RESULT."""
    return Table(items.sparkSession, path, StructType([items.schema["key"], *StructType.fromDDL(RESULT).fields]))


def mapped(items: DataFrame, call: Callable[[str, int], str], path: str, policy: Policy = Policy(), *, workers: int = 4, wave: int = 100_000, task: int = 2_000, again: bool = False, fence: int = 0) -> DataFrame:
    """Results (key, RESULT) of the items (key, request), of earlier runs too; key is unique.

    wave: rows after which results are kept; task: rows of a task; workers: calls of a task at a time. With
    `again`, rows that ended dead before are called once more, and their last result counts.
    """
    shared.importable(items.sparkSession)
    table = results(items, path)
    before = _last(table.read())
    pending = items.select("key", "request").join(before.where("status <> 'dead'" if again else "true").select("key"), "key", "left_anti")
    pending = shared.staged(pending, "pending")
    waves = max(1, -(-pending.count() // wave))

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                out = list(pool.map(lambda request: attempted(call, request, policy), pdf["request"]))
                frame = pd.DataFrame(out, columns=["attempts", "waited", "status", "result", "error"])
                frame.insert(0, "key", pdf["key"].to_numpy())
                yield frame

    for n in range(waves):
        mine = pending.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == n) if waves > 1 else pending
        rows = mine.repartition(max(1, -(-min(wave, 10**9) // task)), "key").mapInPandas(run, table.schema)
        table.append(rows, fence)
    return _last(table.read())


def _last(rows: DataFrame) -> DataFrame:
    """A key's last result: one that is ok if there is any, since no run calls it again."""
    best = F.max_by(F.struct("attempts", "waited", "status", "result", "error"), F.struct(F.col("status") == "ok", "attempts"))
    return rows.groupBy("key").agg(best.alias("r")).select("key", "r.*")


def dead(rows: DataFrame) -> DataFrame:
    """The dead letters."""
    return rows.where("status = 'dead'").select("key", "attempts", "error")
