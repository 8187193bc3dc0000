"""Stored tables in parts by a hash of their key: changes by key read and write only the parts that they touch.

Parts are partition folders, replaced by Spark's dynamic overwrite: the new files of all touched parts are written aside
first and come into place when the job commits. One writer at a time; readers of the old files list them anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written
from . import catalog


@dataclass
class Keyed:
    """A table at `path` with a unique key, in `parts` parts."""

    spark: SparkSession
    path: str
    key: Sequence[str]
    parts: int
    schema: T.StructType

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def rows(self, parts: Sequence[int] | None = None) -> DataFrame:
        """The table, or some parts of it."""
        whole = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(self.path)
        return (whole if parts is None else whole.where(F.col("part").isin(list(parts)))).select(*self.schema.names)

    def find(self, **key: object) -> DataFrame:
        """The row of a key, from its part alone."""
        typed = self.spark.createDataFrame([tuple(key[k] for k in self.key)], T.StructType([self.schema[k] for k in self.key]))
        number = typed.select(self.part()).first()[0]
        found = self.rows([number])
        for k in self.key:
            found = found.where(F.col(k).eqNullSafe(F.lit(key[k])))
        return found

    def _touched(self, changes: DataFrame) -> list[int]:
        return [r[0] for r in changes.select(self.part()).distinct().collect()]  # as many numbers as parts at most

    def _put(self, rows: DataFrame, touched: Sequence[int]) -> list[int]:
        """Replace the touched parts by the rows, which are theirs; an emptied part keeps a file without rows."""
        now = written(rows.withColumn("part", self.part()), "parts")
        full = {r[0] for r in now.select("part").distinct().collect()}
        _dealt(now).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        for number in touched:
            if number not in full:
                self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/part={number}")
        return sorted(touched)

    def upsert(self, changes: DataFrame, order: Sequence[Column] = ()) -> list[int]:
        """Put changed rows in place of those with the same key, and new ones beside them; of several changes to a key the
        last in `order` counts. Returns the parts that were written."""
        touched = self._touched(changes)
        last = (catalog.latest(changes, self.key, order) if order else changes).select(*self.schema.names)
        return self._put(catalog.upsert(self.rows(touched), last, self.key), touched) if touched else []

    def patch(self, changes: DataFrame, nulls: Sequence[str] = ()) -> list[int]:
        """Put the values of changes, one row a key, in place where these are not null; in `nulls` also where they are."""
        if len(self.key) != 1:
            raise ValueError("a patch goes by a single key column")
        touched = self._touched(changes)
        return self._put(catalog.patch(self.rows(touched), changes, self.key[0], nulls), touched) if touched else []

    def delete(self, gone: DataFrame) -> list[int]:
        """Take out the rows of some keys."""
        touched = self._touched(gone)
        return self._put(self.rows(touched).join(gone.select(*self.key).distinct(), list(self.key), "left_anti").select(*self.schema.names), touched) if touched else []


def _dealt(rows: DataFrame) -> DataFrame:
    """A part's rows together, so that it has one file."""
    return rows.repartition("part")


def store_keyed(rows: DataFrame, path: str, key: Sequence[str], parts: int = 64) -> Keyed:
    """Store a table by its key."""
    table = Keyed(rows.sparkSession, path, key, parts, rows.schema)
    _dealt(rows.withColumn("part", table.part())).write.partitionBy("part").parquet(path)
    return table
