"""Small files that are made once: versions of a table and leases, in any store that Spark reads.

A file is made under a name that isn't there yet, which a file system does for one caller alone, so of
two writers of one version, or two holders of one lease, exactly one succeeds.
"""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Makes entry `number`; False if there is one."""
    path, store = _at(spark, f"{folder}/{number:012d}.json")
    if store.exists(path):
        return False
    try:
        out = store.create(path, False)
    except Py4JJavaError:
        if store.exists(path):
            return False
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return True


def read(spark: SparkSession, folder: str, number: int) -> dict | None:
    """Entry `number`; None while its writer hasn't ended it."""
    path, store = _at(spark, f"{folder}/{number:012d}.json")
    stream = store.open(path)
    raw = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    return json.loads(raw) if raw else None


def last(spark: SparkSession, folder: str, patience: float = 10.0) -> tuple[int, dict | None]:
    """The latest entry's number, and the content that holds; -1 and None without any.

    An entry that its writer is still making is waited for. If that takes longer than `patience` seconds its writer has
    died, and what the entry before says holds; the number is taken all the same.
    """
    path, store = _at(spark, folder)
    if not store.exists(path):
        return -1, None
    numbers = sorted((int(f.getPath().getName()[:-5]) for f in store.listStatus(path) if f.getPath().getName().endswith(".json")), reverse=True)
    until = time.monotonic() + patience
    for n in numbers:
        while (content := read(spark, folder, n)) is None and time.monotonic() < until:
            time.sleep(0.05)
        if content is not None:
            return numbers[0], content
    return numbers[0] if numbers else -1, None


def there(spark: SparkSession, path: str) -> bool:
    hadoop, store = _at(spark, path)
    return store.exists(hadoop)


def removed(spark: SparkSession, path: str) -> bool:
    hadoop, store = _at(spark, path)
    return store.delete(hadoop, True)


__all__ = ["last", "put", "read", "removed", "there"]
