"""Tables of Parquet folders whose content changes at once: appended to or replaced as a whole.

A change writes its folder first and then a version that names all folders in force (sources.log). A version
is made once, so readers have the old or the new table, and of two writers one has to try again. A writer that
holds a lease gives its number: a table takes nothing under a number lower than the highest it has seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from folioworks.sources import log


class Fenced(RuntimeError):
    """A later holder of the lease has written, or is about to."""


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _last(self) -> tuple[int, dict]:
        number, content = log.last(self.spark, f"{self.path}/versions")
        return number, content or {"folders": [], "fence": 0}

    def read(self) -> DataFrame:
        """The table as it is now; the DataFrame keeps reading that version."""
        folders = self._last()[1]["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def barrier(self, fence: int) -> None:
        """From now on, nothing is taken under a lower number."""
        self._commit(lambda folders: folders, fence)

    def append(self, rows: DataFrame, fence: int = 0) -> None:
        folder = self._written(rows)
        self._commit(lambda folders: [*folders, folder], fence)

    def replace(self, rows: DataFrame, fence: int = 0) -> None:
        folder = self._written(rows)
        self._commit(lambda folders: [folder], fence)

    def _written(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(*(f.name for f in self.schema.fields)).write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, change, fence: int) -> None:
        while True:
            number, content = self._last()
            if fence < content["fence"]:
                raise Fenced(f"{fence} is lower than {content['fence']} in {self.path}")
            if log.put(self.spark, f"{self.path}/versions", number + 1, {"folders": change(content["folders"]), "fence": max(fence, content["fence"])}):
                return
