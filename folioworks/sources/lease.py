"""Single flight (K1): one job at a time, by a lease in the shared folder.

A lease is an entry that is made once (sources.log). It ends when it is given back or its time is over, so a
dead holder blocks nobody for longer, and it bears a number that is higher than all before it: tables refuse
what comes under a lower one (sources.versions).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from folioworks.sources import log


class Lost(RuntimeError):
    """The lease has another holder."""


@dataclass
class Lease:
    spark: SparkSession
    folder: str
    holder: str
    fence: int
    number: int
    seconds: float
    clock: Callable[[], float]

    def renew(self) -> None:
        """Holds it for its time from now on; raises Lost if another took it meanwhile."""
        entry = {"holder": self.holder, "fence": self.fence, "until": self.clock() + self.seconds}
        if not log.put(self.spark, self.folder, self.number + 1, entry):
            raise Lost(self.folder)
        self.number += 1

    def release(self) -> None:
        """Gives it back; of no effect if another took it meanwhile."""
        log.put(self.spark, self.folder, self.number + 1, {"holder": None, "fence": self.fence, "until": 0})


def acquire(spark: SparkSession, folder: str, holder: str, seconds: float = 600.0, clock: Callable[[], float] = time.time) -> Lease | None:
    """The lease, or None while somebody holds it."""
    number, last = log.last(spark, folder)
    if last is not None and last["until"] > clock():
        return None
    fence = (last["fence"] if last else 0) + 1
    if not log.put(spark, folder, number + 1, {"holder": holder, "fence": fence, "until": clock() + seconds}):
        return None
    return Lease(spark, folder, holder, fence, number + 1, seconds, clock)
