"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and characters or bytes, that an Arrow batch made by a Python worker holds, unless one input row gives more.
MOST_ROWS, MOST_SIZE = 2_000, 4 << 20

_roots: set[str] = set()


def _drop(spark: SparkSession, path: str) -> None:
    """Delete what this application wrote; a session that is gone, or a missing folder, is passed over."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path below `spark.checkpoint.dir`; a local one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "folioframe-shared")
    root = f"{base.rstrip('/')}/folioframe-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_drop, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """The rows, written once to the shared folder and read from there: plans don't grow, and lost executors cost a re-read."""
    spark = rows.sparkSession
    path = shared_folder(spark, tag)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def bounded_batches(rows: DataFrame, most: int = 1000, size: int = 8 << 20) -> SparkSession:
    """The session, with Arrow batches of at most `most` rows, and no more rows once they have `size` bytes: texts and
    packed rows are long, and workers hold a batch whole, as Spark does beside its heap."""
    spark = rows.sparkSession
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", most), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))
    return spark


def record_batches(found: Iterator[tuple[int, list[dict]]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from what each input row gives: about how long that is, and its rows.

    What a worker holds is then independent of how many rows reach it at a time, and of the size of the table.
    """
    arrow, held, size = to_arrow_schema(schema), [], 0
    for n, rows in found:
        held += rows
        size += n
        if len(held) >= MOST_ROWS or size >= MOST_SIZE:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, arrow)


def _values(column: pa.Array) -> list:
    """A column's Python values; the items of its lists are taken all at once."""
    if not pa.types.is_list(column.type) or column.null_count:
        return column.to_pylist()
    items, ends = _values(column.flatten()), column.value_lengths().to_numpy().cumsum().tolist()
    return [items[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def each_row(batches: Iterator[pa.RecordBatch], at_once: int = 64) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, made a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, at_once):
            yield from zip(*(_values(c.slice(k, at_once)) for c in batch.columns), strict=True)
