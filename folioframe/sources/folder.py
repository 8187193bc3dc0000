"""Folders of files as a data source: listings by the executors, streams of new files, and writing of many files.

Stores are those that pyarrow's file systems open. A listing has a partition for each folder down to `levels` levels,
so the driver sees names of folders there and no file's; filters on name, ext, size and modified are taken by the
source (`folder` switches that on). A stream's offsets are times: a batch has the files modified since the last one.

Writing takes rows (name, body) or (name, source): each task writes, or copies block by block, to a folder of its own
and moves its files into place when all of them are complete. A file half written is never in place: what a killed task
leaves aside goes at the job's end, whether it commits or aborts, and a repeated task comes to the same files.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

LISTED = "path string, name string, ext string, size long, modified timestamp"
WRITTEN = "row string, file_name string, bytes long, sha256 string, error string"
#: Fixed value: levels below the top that are looked at.
DEEPEST = 8
STAGING = "_staging"
BLOCK = 1 << 20


def store_of(uri: str):  # noqa: ANN201
    """(file system, path there, what stands before paths)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))
    return store, path.rstrip("/") or "/", uri[: uri.index("://") + 3] + uri[uri.index("://") + 3 :].split("/", 1)[0] if "://" in uri else "file://"


def entries(store, folder: str) -> list:  # noqa: ANN001
    """What is in a folder; links are passed over, and so is a folder that can't be read."""
    import os

    from pyarrow import fs

    try:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return []
    return [f for f in found if not (isinstance(store, fs.LocalFileSystem) and os.path.islink(f.path))]


_TESTS: dict[type, Callable[[object, object], bool]] = {
    ds.EqualTo: lambda a, b: a == b, ds.In: lambda a, b: a in b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}
_COLUMNS = ("name", "ext", "size", "modified")


def test_of(f: ds.Filter) -> Callable[[dict], bool] | None:
    """A filter as a test of a row; None where the source can't take it."""
    if isinstance(f, ds.Not):
        inner = test_of(f.child)
        return None if inner is None else lambda row: not inner(row)
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in _COLUMNS:
        return None
    if isinstance(f, ds.IsNotNull):
        return lambda row: True  # none of these is null
    how = _TESTS.get(type(f))
    if how is None or column == "modified" and type(f) in (ds.In,):
        return None
    value = f.value
    if isinstance(value, datetime) and value.tzinfo is None:
        value = value.replace(tzinfo=UTC)
    return lambda row: how(row[column], value)


class Folder(ds.InputPartition):
    """A folder, and whether what is below it belongs to the same task; a stream's has its times besides."""

    def __init__(self, path: str, depth: int, below: bool, after: int = 0, until: int | None = None) -> None:
        self.path, self.depth, self.below, self.after, self.until = path, depth, below, after, until


class _Listing:
    """What the two readers have in common."""

    def __init__(self, options: dict[str, str]) -> None:
        self.top, self.pattern = options["path"], options.get("pattern", "*")
        self.deepest, self.levels = int(options.get("deepest", DEEPEST)), int(options.get("levels", 2))
        self.tests: list[Callable[[dict], bool]] = []

    def folders(self, after: int = 0, until: int | None = None) -> Sequence[Folder]:
        from pyarrow import fs

        store, top, _ = store_of(self.top)
        out, level = [], [(top, 0)]
        while level:
            deeper = []
            for path, depth in level:
                last = depth >= self.levels
                out.append(Folder(path, depth, last, after, until))
                if not last and depth + 1 < self.deepest:
                    deeper += [(f.path, depth + 1) for f in entries(store, path) if f.type == fs.FileType.Directory and f.base_name != STAGING]
            level = deeper
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        store, _, before = store_of(self.top)
        todo = [(partition.path, partition.depth)]
        while todo:
            path, depth = todo.pop()
            for f in entries(store, path):
                if f.type == fs.FileType.Directory:
                    if partition.below and depth + 1 < self.deepest and f.base_name != STAGING:
                        todo.append((f.path, depth + 1))
                    continue
                if f.type != fs.FileType.File or f.base_name.startswith("~$") or not fnmatch(f.base_name, self.pattern):
                    continue
                ns = f.mtime_ns or 0
                if ns <= partition.after or partition.until is not None and ns > partition.until:
                    continue
                row = {"path": before + f.path, "name": f.base_name, "ext": f.base_name.rpartition(".")[2].lower() if "." in f.base_name else "", "size": f.size or 0, "modified": datetime.fromtimestamp(ns // 1000 / 1e6, UTC)}
                if all(test(row) for test in self.tests):
                    yield tuple(row.values())


class FolderReader(_Listing, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        self.taken = []
        for f in filters:
            if test_of(f) is None:
                yield f
            else:
                self.taken.append(f)

    def partitions(self) -> Sequence[Folder]:
        return self.folders()

    def read(self, partition: Folder) -> Iterator[tuple]:
        self.tests = [t for t in map(test_of, getattr(self, "taken", ())) if t]
        return super().read(partition)


class FolderStream(_Listing, ds.DataSourceStreamReader):
    """New files by time of modification. Files younger than `settle` seconds wait for the next batch, as more may still
    be written with the same time; files moved in with an older time are not seen."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.settle = float(options.get("settle", "1"))

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> Sequence[Folder]:
        return self.folders(start["ns"], end["ns"])

    def read(self, partition: Folder) -> Iterator[tuple]:
        return _Listing.read(self, partition)

    def commit(self, end: dict) -> None:
        pass


class Part(ds.WriterCommitMessage):
    def __init__(self, outcomes: str | None) -> None:
        self.outcomes = outcomes


class FileWriter(ds.DataSourceWriter):
    """Rows (row, name, source, body): files below a folder. `named` by content: the folder of a file is then the start of
    the SHA-256 of its source's path and its content's hash."""

    def __init__(self, options: dict[str, str]) -> None:
        self.top, self.job, self.by_content = options["path"], options["job"], options.get("named") == "content"

    def _copied(self, store, row, at: str) -> tuple[int, str]:  # noqa: ANN001
        """Write the row's file aside; its size and hash."""
        hashed, n = hashlib.sha256(), 0
        with store.open_output_stream(at) as out:
            if row["source"] is not None:
                from_, path, _ = store_of(row["source"])
                with from_.open_input_stream(path) as data:
                    while block := data.read(BLOCK):
                        hashed.update(block)
                        out.write(block)
                        n += len(block)
            elif row["body"]:
                data = bytes(row["body"])
                hashed.update(data)
                out.write(data)
                n = len(data)
        return n, hashed.hexdigest()

    def write(self, iterator: Iterator) -> Part:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base, _ = store_of(self.top)
        mine = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        done: list[tuple] = []
        for k, row in enumerate(iterator):
            name = row["name"]
            try:
                if not name or ".." in name.split("/"):
                    raise ValueError(f"not a file name: {name!r}")
                n, digest = self._copied(store, row, f"{mine}/{k}")
                if self.by_content:
                    name = f"{hashlib.sha256(f'{row["source"]}|{digest}'.encode()).hexdigest()[:32]}/{name}"
                done.append((row["row"], name, n, digest, None, k))
            except Exception as e:
                done.append((row["row"], name, 0, None, f"{type(e).__name__}: {e}", None))
        made, out = set(), []
        for row_, name, n, digest, error, k in done:
            if k is not None:
                try:
                    there = store.get_file_info(f"{base}/{name}")
                    if there.type != fs.FileType.NotFound and self.by_content and there.size == n:
                        store.delete_file(f"{mine}/{k}")  # the same content, by an earlier run of this task
                    else:
                        parent = f"{base}/{name}".rpartition("/")[0]
                        if parent not in made:
                            store.create_dir(parent, recursive=True)
                            made.add(parent)
                        store.move(f"{mine}/{k}", f"{base}/{name}")
                except Exception as e:
                    n, digest, error = 0, None, f"{type(e).__name__}: {e}"
            out.append((row_, name, n, digest, error))
        if not out:
            return Part(None)
        columns = [c.split()[0] for c in WRITTEN.split(", ")]
        table = pa.table({c: pa.array([r[i] for r in out], pa.int64() if c == "bytes" else pa.string()) for i, c in enumerate(columns)})
        pq.write_table(table, f"{mine}/outcomes.parquet", filesystem=store)
        return Part(f"{mine}/outcomes.parquet")

    def commit(self, messages: list[Part | None]) -> None:
        """Keep the outcomes of the tasks that count; everything else that was written aside goes."""
        store, base, _ = store_of(self.top)
        kept = f"{base}/{STAGING}/{self.job}.outcomes"
        store.create_dir(kept, recursive=True)
        for k, part in enumerate(messages):
            if part is not None and part.outcomes:
                store.move(part.outcomes, f"{kept}/{k}.parquet")
        store.delete_dir(f"{base}/{STAGING}/{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, base, _ = store_of(self.top)
        if store.get_file_info(f"{base}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{STAGING}/{self.job}")


class FolderSource(ds.DataSource):
    """`spark.read.format("folder")`, `readStream` and `write`; option path, and those of the classes above."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> FolderStream:  # noqa: ANN001
        return FolderStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FileWriter:  # noqa: ANN001
        return FileWriter(dict(self.options))


def folder(spark: SparkSession) -> SparkSession:
    """The session with the source known and its filters pushed down."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_files(rows: DataFrame, path: str, *, row: str, name: str, source: str | None = None, body: str | None = None, named: str = "given") -> DataFrame:
    """(row, file_name, bytes, sha256, error) of writing a file for each row; what fails is an outcome and the others go on.

    `row` is text that names a row in the outcomes. Rows are dealt anew over all tasks, as they may come from few.
    """
    spark = folder(rows.sparkSession)
    job = uuid.uuid4().hex
    none = F.lit(None)
    plain = rows.select(F.col(row).cast("string").alias("row"), F.col(name).alias("name"), (F.col(source) if source else none.cast("string")).alias("source"), (F.col(body).cast("binary") if body else none.cast("binary")).alias("body"))
    plain.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "row").write.format("folder").mode("append").option("path", path).option("job", job).option("named", named).save()
    return spark.read.schema(WRITTEN).parquet(f"{path.rstrip('/')}/{STAGING}/{job}.outcomes")


def listed_stream(spark: SparkSession, path: str, pattern: str = "*", settle: float = 1.0) -> DataFrame:
    """LISTED of a folder's files as a stream: all there are, then new ones."""
    return folder(spark).readStream.format("folder").option("path", path).option("pattern", pattern).option("settle", str(settle)).load()


def aside(path: str) -> list[str]:
    """What writers have left aside below a folder: outcomes, and jobs that were neither committed nor aborted."""
    store, base, _ = store_of(path)
    return [f.base_name for f in entries(store, f"{base}/{STAGING}")]
