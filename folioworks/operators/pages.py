"""Pages of an ordered result (O2, O11, O13), deep ones too.

`offset` sorts what comes before the page in one task. Here the rows are dealt into ranges of the order once,
ranges are counted, and only the range or ranges that hold the page are sorted.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.sources import shared

MOST_PER_PAGE = 200


def bounds(number: int, per_page: int, most: int = MOST_PER_PAGE) -> tuple[int, int]:
    """O2: (offset, size) of a page; numbers begin at 1, sizes are at most `most`."""
    size = min(max(1, per_page), most)
    return (max(1, number) - 1) * size, size


def ranged(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df staged in folders range=0, 1, ... in the order's sequence; order has to be total."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return shared.staged_by(dealt.withColumn("range", F.spark_partition_id()), "ranges", "range", df.schema)


def counts(ranged_: DataFrame) -> list[tuple[int, int]]:
    """(range, rows): a row for each range comes to the driver."""
    return sorted((r["range"], r["count"]) for r in ranged_.groupBy("range").count().collect())


def picked(sizes: list[tuple[int, int]], offset: int, size: int) -> tuple[list[int], int]:
    """The ranges that hold a page, and how many of their rows come before it."""
    ends = [*itertools.accumulate(n for _, n in sizes)]
    first = bisect.bisect_right(ends, offset)
    last = bisect.bisect_left(ends, offset + size)
    return [r for r, _ in sizes[first : last + 1]], offset - (ends[first - 1] if first else 0)


def numbered(ranged_: DataFrame, order: list[Column], sizes: list[tuple[int, int]], offset: int, size: int) -> DataFrame:
    """The page's rows with `row`, their place from 0: reads and sorts the page's ranges alone."""
    which, before = picked(sizes, offset, size)
    rows = ranged_.where(F.col("range").isin(*which)) if which else ranged_.where(F.lit(False))
    return rows.drop("range").orderBy(*order).offset(before).limit(size)


#: Rows before a page up to which tasks keep what may be on it: `orderBy().limit()` holds no more in any task.
EARLY = 10_000


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 50, most: int = MOST_PER_PAGE, early: int = EARLY) -> DataFrame:
    """O2: a page of df in the order; early ones by the least rows of each task, deep ones by ranges."""
    offset, size = bounds(number, per_page, most)
    if offset < early:
        return df.orderBy(*order).offset(offset).limit(size)
    all_ = ranged(df, order)
    return numbered(all_, order, counts(all_), offset, size).orderBy(*order)
