"""Token-count rollups maintained by deltas.

A change of a document is a signed row: an insert adds its tokens and one document, a delete takes them away, a
revised count takes the old tokens away and adds the new. A batch of changes is summed by (source, lang, tokenizer)
and committed under its id; a batch that is there already is left as it is, so a retry or a replay adds nothing.
Totals are the base of the last compaction and the batches since; no state is read to write a batch.

Files: sums are written to folders of their own below `data`; what counts is named by small files: an empty one,
`commits/<batch>.<folder>`, and for a compaction `bases/<number>`, which holds its folder's name; that folder also lists
the batches it covers. Whatever is cut off before such a file appears counts for nothing, and after it only leaves litter.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which an empty mark of a compaction is one of a writer that died.
STALE = 3600
KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions that need no model: their counts as columns.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "space-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "split-1": lambda text: F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]")),
}


def count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text by a version of TOKENIZERS; null counts 0."""
    return F.coalesce(TOKENIZERS[tokenizer](text), F.lit(0)).cast("long")


#: How the byte-pair versions cut text before merging: a fixed value of their public vocabularies.
BYTE_PAIR_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def bpe_count(ranks: Path, pattern: str = BYTE_PAIR_PATTERN) -> Callable[[Column], Column]:
    """A column function that counts byte-pair tokens by a ranks file, which is read once here. Null counts 0."""
    import base64

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return lambda text: F.coalesce(tokens(text), F.lit(0)).cast("long")


def _signed(rows: DataFrame, docs: int, tokens: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(docs).cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def inserts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Signed rows for documents that came: (source, lang, tokenizer, `tokens`)."""
    return _signed(rows, 1, F.coalesce(F.col(tokens), F.lit(0)))


def deletes(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Signed rows for documents that went, with the count they had."""
    return _signed(rows, -1, -F.coalesce(F.col(tokens), F.lit(0)))


def revisions(rows: DataFrame, old: str = "tokens", new: str = "new_tokens") -> DataFrame:
    """Signed rows for documents whose count changed."""
    return _signed(rows, 0, F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


class RollupStore:
    """A folder of committed batches and of compactions of them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self, kind: str, name: str = "*") -> dict[str, str]:
        """The folder that each name stands for; where two writers made marks of one name, the earlier one counts."""
        found = self._fs.globStatus(self._path(f"{self.path}/{kind}/{name}.*")) or []
        marks = sorted((s.getModificationTime(), s.getPath().getName()) for s in found)
        out: dict[str, str] = {}
        for _, mark in marks:
            out.setdefault(*mark.rsplit(".", 1))
        return out

    def _mark(self, kind: str, name: str, folder: str) -> bool:
        """Make a mark; whether it is the one that counts."""
        self._fs.create(self._path(f"{self.path}/{kind}/{name}.{folder}"), False).close()
        return self._marks(kind, name)[name] == folder

    def _drop(self, path: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{path}"), True)

    def _base(self) -> tuple[int, str | None]:
        """Number and folder of the last compaction."""
        found = self._fs.globStatus(self._path(f"{self.path}/bases/*")) or []
        numbers = sorted((int(s.getPath().getName()) for s in found if s.getLen()), reverse=True)
        return (numbers[0], self._said(f"bases/{numbers[0]:012d}")) if numbers else (0, None)

    def _said(self, path: str) -> str:
        """What a small file holds."""
        stream = self._fs.open(self._path(f"{self.path}/{path}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _follow(self, number: int, folder: str) -> bool:
        """Make `folder` the base of this number; False if there is one. A number has one file, which stores create for
        one writer only; a second look makes sure of it."""
        from py4j.protocol import Py4JJavaError

        path = f"bases/{number:012d}"
        for left in self._fs.globStatus(self._path(f"{self.path}/{path}")) or []:
            if not left.getLen() and time.time() * 1000 - left.getModificationTime() > STALE * 1000:
                self._drop(path)
        try:
            out = self._fs.create(self._path(f"{self.path}/{path}"), False)
        except Py4JJavaError:
            return False
        out.write(folder.encode())
        out.close()
        return self._said(path) == folder

    def _covered(self) -> DataFrame:
        folder = self._base()[1]
        return self.spark.read.schema("batch string").parquet(f"{self.path}/data/{folder}/covered") if folder else self.spark.createDataFrame([], "batch string")

    def _open(self) -> dict[str, str]:
        """The committed batches that no compaction covers, and their folders."""
        marks = self._marks("commits")
        names = self.spark.createDataFrame([(b,) for b in marks], "batch string")
        return {r.batch: marks[r.batch] for r in names.join(self._covered(), "batch", "left_anti").collect()}

    def committed(self, batch: str) -> bool:
        return bool(self._marks("commits", batch)) or not self._covered().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Sum the signed rows and commit them under `batch` (letters, digits, - and _); False if it was there.

        A failed attempt leaves nothing that counts. Of two writers of one batch, one batch counts: the mark that was
        made first. An empty batch is committed like any other.
        """
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        rows = changes[0]
        for more in changes[1:]:
            rows = rows.unionByName(more)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        folder = uuid.uuid4().hex
        sums.where("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{self.path}/data/{folder}/sums")
        done = self._mark("commits", batch, folder)
        if not done:
            self._drop(f"data/{folder}")
        return done

    def batches(self) -> list[str]:
        """All committed batches, compacted ones too."""
        return sorted({*self._marks("commits"), *(r.batch for r in self._covered().collect())})

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; keys with nothing left are absent."""
        base = self._base()[1]
        paths = [f"{self.path}/data/{f}/sums" for f in (*filter(None, [base]), *self._open().values())]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: str = "base") -> bool:
        """Sum all batches into one base (`into` is not used any more), which remembers their ids: replays still add nothing. Whether it was done.

        The new base and its list are written first and count from the moment of one mark, its number; only then what it
        replaces is deleted. Of compactions at once, all of which follow the same base, one gets the number; the others
        leave everything as it is. A crash before the mark changes nothing, one after it leaves files that count no more; one
        that left a mark empty is passed over after STALE seconds.
        """
        number, old = self._base()
        merged = self._open()
        if not merged:
            return False
        folder = uuid.uuid4().hex
        self.totals().write.parquet(f"{self.path}/data/{folder}/sums")
        covered = self._covered().union(self.spark.createDataFrame([(b,) for b in merged], "batch string"))
        covered.write.parquet(f"{self.path}/data/{folder}/covered")
        if not self._follow(number + 1, folder):
            self._drop(f"data/{folder}")
            return False
        for batch, data in merged.items():
            self._drop(f"commits/{batch}.{data}")
            self._drop(f"data/{data}")
        if old:
            self._drop(f"data/{old}")  # its number stays: no compaction that began before may take it again
        return True


def token_rows(docs: DataFrame, tokenizers: tuple[str, ...], text: Column, extra: tuple[str, ...] = (), name: str = "tokens") -> DataFrame:
    """One row for each document and tokenizer version: source, lang, tokenizer, `name` and the columns `extra`.

    Null texts count 0; null sources and languages are keys of their own; repeated rows count each time.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), count(text, t).alias(name)) for t in tokenizers]))
    return docs.select(*extra, F.col("source"), F.col("lang"), pairs.alias("p")).select(*extra, "source", "lang", "p.tokenizer", f"p.{name}")
