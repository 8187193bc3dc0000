"""Durable intermediate tables in the folder the cluster shares.

Lineage is cut by writing Parquet under `spark.checkpoint.dir`; an executor that is lost later
costs a re-read, not a recomputation. The folder is read from the session; a local one is used
only where the session names none and runs on one machine (unit tests).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bounded_batches as bounded_batches

_roots: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "folioframe-shared")
    root = f"{base.rstrip('/')}/folioframe-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
        atexit.register(drop_path, spark, root)
    return root


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; a stopped session or missing path is ignored."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "durable_path", None)
        if path:
            drop_path(df.sparkSession, path)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each lengthened by underscores until no column of `df` has it, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def hot_join(many: DataFrame, ones: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The inner join on `key` of rows with a table of one row a key, whose column `n` says how many rows have the key.

    The n's sum up to `total` at most. A key with more than a 5,000th of it is hot; there are 5,000 of these at most,
    which are broadcast, so that their rows stay where they are; the others are joined by shuffling. Below 10,000
    rows there is nothing to split. `many` is read twice.
    """
    if total <= 10_000:
        return many.join(ones, key)
    hot = F.col(n) > max(1_000, total // 5_000)
    head, rest = F.broadcast(ones.where(hot)), ones.where(~hot)
    cold = many.join(F.broadcast(ones.where(hot).select(key)), key, "left_anti").join(rest, key)
    return many.join(head, key).unionByName(cold)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Return what a finished task no longer holds to the system: a Python worker lives on and serves other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
