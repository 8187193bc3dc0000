"""Stored tables in sorted parts: any page, however deep, reads the part or two that hold it; a keyword reads the parts
that hold all of its trigrams. Parts are folders (`part=k`), so the scan itself leaves the others out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog

#: Rows of a part, about.
PART = 100_000


def _with_part(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])


@dataclass
class Pages:
    """A table at `path`, in parts sorted by `order` among and within themselves, with the number of rows before each part."""

    spark: SparkSession
    path: str
    order: Sequence[Column]
    schema: T.StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("part int, n long, before long, total long").parquet(f"{self.path}/counts")

    def page(self, number: int = 1, size: int = 20, largest: int = 200) -> DataFrame:
        """The rows of a page in order, each with `total`; sizes are held to 1..largest. Beyond the end there are none.

        The counts of parts say which hold the page: at most `size` of them, mostly one, are read.
        """
        size = min(max(1, size), largest)
        first = (max(1, number) - 1) * size
        hit = self.counts.where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()
        table = self.rows
        columns = [c for c in table.columns if c != "part"]
        before = F.lit(0).cast("long")
        for r in hit:
            before = F.when(F.col("part") == r.part, r.before).otherwise(before)
        place = before + F.row_number().over(W.partitionBy("part").orderBy(*self.order)) - 1
        found = table.where(F.col("part").isin([r.part for r in hit])).withColumn("__place", place).where(F.col("__place").between(first, first + size - 1))
        return found.orderBy("__place").select(*columns, F.lit(hit[0].total if hit else 0).cast("long").alias("total"))


def store_pages(rows: DataFrame, path: str, order: Sequence[Column], part_rows: int = PART) -> Pages:
    """Sort a table into parts of about `part_rows` rows and store it. `order` should end with a unique column: equal rows
    have no place of their own. An empty table has no parts."""
    parts = max(1, -(-rows.count() // part_rows))
    made = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    made.write.partitionBy("part").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(_with_part(rows)).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    n = stored.groupBy("part").agg(F.count("*").alias("n"))
    by_part = W.orderBy("part")  # a row a part
    n.select("part", "n", F.coalesce(F.sum("n").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total")).coalesce(1).write.parquet(f"{path}/counts")
    return Pages(rows.sparkSession, path, order, _with_part(rows))


# ---------------------------------------------------------------- keywords


def grams(text: Column) -> Column:
    """The different three-character pieces of a text, letters alike in either case; none of a shorter or null one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.substr(low, k, F.lit(3))))


def asked_grams(q: str) -> list[str]:
    """The trigrams that a row must have to hold q, in which % and _ are wildcards."""
    return sorted({piece[k : k + 3] for piece in re.split("[%_]", q.replace("\\%", "%").replace("\\_", "_").lower()) for k in range(len(piece) - 2)})


@dataclass
class Keywords:
    """A table in parts, and for each trigram of some of its columns the parts that have it."""

    spark: SparkSession
    path: str
    columns: Sequence[str]
    schema: T.StructType

    def parts(self, q: str) -> list[int] | None:
        """The parts that can hold q; None for all, as q has no three characters in a row."""
        wanted = asked_grams(q)
        if not wanted:
            return None
        found = self.spark.read.schema("gram string, part int").parquet(f"{self.path}/grams").where(F.col("gram").isin(wanted))
        return [r.part for r in found.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).collect()]

    def search(self, q: str) -> DataFrame:
        """The rows that hold q in one of the columns, as `catalog.contains` has it: parts by their trigrams, rows by looking."""
        table = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        parts = self.parts(q)
        near = table if parts is None else table.where(F.col("part").isin(parts))
        return near.where(catalog.contains(q, *self.columns)).drop("part")


def store_keywords(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column], part_rows: int = PART) -> Keywords:
    """Store a table in parts, sorted by `order`, with an index of the trigrams of `columns`.

    The index has a row for each trigram and part, counted before it is shuffled; it is sorted by trigram, so that a search
    reads little of it.
    """
    stored = store_pages(rows, path, order, part_rows).rows
    pieces = F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns]))))
    index = stored.select("part", pieces.alias("gram")).where(F.length("gram") == 3).distinct()
    index.select("gram", "part").repartitionByRange(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "gram").sortWithinPartitions("gram", "part").write.parquet(f"{path}/grams")
    return Keywords(rows.sparkSession, path, columns, _with_part(rows))
