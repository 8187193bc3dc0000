"""Files: listing, gates, import with duplicates on record, and decoding to nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CONTENT, NODE
from ..operators.tree import COVERED
from ..shared import bounded_batches, each_row, record_batches
from . import ooxml
from .folder import DEEPEST, folder, store_of

# Formats that are taken, those with a reader here, and the gates.
FORMATS = ("docx", "pptx", "xlsx", "pdf", "doc", "ppt", "xls")
READABLE = ("docx", "pptx", "xlsx")
LARGEST = 500 * 1024 * 1024
SPARE = 2 * 1024**3


def listing(spark: SparkSession, path: str, pattern: str = "*", deepest: int = DEEPEST) -> DataFrame:
    """(path, name, ext, size, modified) of all files below a folder, without reading them; lock files and links are out.

    Listed by the executors, a task for each folder of the upper levels; empty files are seen too. Filters on names and
    sizes reach the listing.
    """
    return folder(spark).read.format("folder").option("path", path).option("pattern", pattern).option("deepest", str(deepest)).load()


def snapshots(listed: DataFrame) -> DataFrame:
    """(doc_id, page, path) of the pictures of pages among listed files: p1.png, p2.png and so on in the document's folder."""
    page = F.regexp_extract("name", r"^p(\d+)\.png$", 1)
    return listed.where(page != "").select(F.element_at(F.split("path", "/"), -2).alias("doc_id"), page.cast("int").alias("page"), "path")


def gated(files: DataFrame) -> DataFrame:
    """Files with `code`: null if they may be read, else why not: format E03, empty or too large E05, no reader E03."""
    code = F.when(~F.col("ext").isin(*FORMATS), "E03").when((F.col("size") == 0) | (F.col("size") > LARGEST), "E05").when(~F.col("ext").isin(*READABLE), "E03")
    return files.withColumn("code", code)


def room_needed(files: DataFrame) -> int:
    """Bytes that importing the files takes: three times their size, and some to spare."""
    return int(files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * 3 + SPARE


def contents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with their bytes and SHA-256, for those that pass the gates; others are never opened.

    The listed names are dealt to all tasks, which read a file at a time. One that can't be read has null bytes.
    """
    listed = listing(spark, path, pattern).where(F.col("ext").isin(*READABLE) & (F.col("size") > 0) & (F.col("size") <= LARGEST))
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    store, at, _ = store_of(batch.column(0)[k].as_py())
                    with store.open_input_stream(at) as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "content"])

    rows = listed.select("path", "name", "ext", "size").repartition(width, "path").mapInArrow(run, "path string, name string, ext string, size long, content binary")
    return rows.select("path", "name", "ext", "size", F.sha2("content", 256).alias("hash"), "content")


PARSED = (
    T.StructType().add("doc_id", "string").add("name", "string").add("status", "string").add("code", "string").add("reason", "string").add("parse_level", "string").add("pages", "integer")
    .add("stated_chars", "long").add("nodes", T.ArrayType(T.StructType([f for f in NODE.fields if f.name != "doc_id"])))
    .add("warnings", T.ArrayType(T.StructType().add("code", "string").add("text", "string")))
    .add("assets", T.ArrayType(T.StructType().add("path", "string").add("sha256", "string").add("data", "binary")))
)


def parsed(files: DataFrame, *, id_col: str = "hash", strict: bool = False) -> DataFrame:
    """A row of PARSED for each file (name, ext, content): its nodes, or the code and reason why there are none.

    One file's failure is that file's row; the others aren't touched.
    """

    def read(doc: str | None, name: str | None, ext: str | None, data: bytes | None) -> dict:
        row = {"doc_id": doc, "name": name, "status": "failed", "nodes": [], "warnings": [], "assets": [], "pages": 0}
        try:
            tree, level = ooxml.decode(data or b"", ext, strict)
            row |= {"status": "parsed", "parse_level": level, "pages": tree.pages, "stated_chars": tree.stated_chars, "nodes": tree.nodes}
            row |= {"warnings": [{"code": c, "text": t} for c, t in tree.warnings], "assets": [{"path": p, "sha256": k, "data": d} for k, (p, d) in tree.assets.items()]}
        except ooxml.Rejected as e:
            row |= {"code": e.code, "reason": str(e)}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(((4 * len(data or b""), [read(doc, name, ext, data)]) for doc, name, ext, data in each_row(batches)), PARSED)

    bounded_batches(files)
    return files.select(F.col(id_col).alias("doc_id"), "name", "ext", "content").mapInArrow(run, PARSED)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Rows of model.NODE of parsed files."""
    return rows.select("doc_id", F.explode("nodes").alias("n")).select("doc_id", *[F.col(f"n.{f.name}") for f in NODE.fields if f.name != "doc_id"])


def measured(rows: DataFrame) -> DataFrame:
    """Parsed files with coverage and final status: doubtful where little text was found or a warning counts."""
    from ..operators.tree import coverage, numerator

    found = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + numerator(n["content"]))
    out = rows.withColumn("text_coverage", F.when(F.col("status") == "parsed", coverage(found, F.col("stated_chars"))))
    counted = F.exists("warnings", lambda w: w["code"].isin("E04", "E05")) | (F.coalesce("text_coverage", F.lit(1.0)) < COVERED) | (F.coalesce("parse_level", F.lit("L0")) != "L0")
    return out.withColumn("status", F.when(F.col("status") == "failed", "failed").when(counted, "warning").otherwise("ok"))
