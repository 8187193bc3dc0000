"""Writers. Tables go out as Parquet or JSON lines; the single files that people open are put together from texts that
all tasks have made, by one task, in order, and moved into place when complete."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .shared import written
from .sources.folder import store_of, write_files

# The columns of the exports, and their schema's version.
VERSION = "1.0"
CHUNK_CSV = ("doc_name", "chunk_id", "parent_id", "seq", "kind", "type", "heading_path", "pages", "token_count", "char_count", "text")
CHUNK_JSON = ("chunk_id", "parent_id", "doc_id", "seq", "kind", "type", "text", "token_count", "char_count", "heading_path", "pages", "node_ids", "hash")
DOC_JSON = ("doc_id", "doc_name", "source_format", "parse_level", "text_coverage")
META = ("doc_id", "chunk_id", "heading_path", "generated_by")
LOG = ("ts", "level", "src", "task_id", "doc_id", "code", "page", "msg", "detail")
EXPORTED_BY = f"folioframe {__version__}"


@dataclass(frozen=True)
class Section:
    """How some rows' texts stand in a file: what comes before them, between them and after them, or instead of none."""

    before: str = ""
    opening: str = ""
    between: str = ""
    closing: str = ""
    none: str = ""


def json_section(before: str, depth: int) -> Section:
    inner = "  " * (depth + 1)
    return Section(before, f"[\n{inner}", f",\n{inner}", f"\n{'  ' * depth}]", "[]")


def texts(rows: DataFrame, shown: Callable[[dict], str], section: int, *order: Column) -> DataFrame:
    """(section, one, two, text): each row's text, made by the tasks that have the rows, and its place: by two columns, or as they come."""
    keys = [*order, *[F.lit(None)] * (2 - len(order))] if order else [F.lit(None), F.monotonically_increasing_id()]
    placed = rows.select(F.lit(section).alias("section"), keys[0].cast("string").alias("one"), keys[1].cast("long").alias("two"), F.struct(*rows.columns).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shown(r) for r in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["section", "one", "two", "text"])

    return placed.mapInArrow(run, "section int, one string, two long, text string")


def write_single(rows: DataFrame, path: str, sections: Sequence[Section], tail: str = "", *, bom: bool = False) -> str:
    """Write the texts of `texts` as one UTF-8 file, in order: a task sorts them, on disk if they are many, and streams them
    to a file aside, which gets its name when it is complete. Nothing passes the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target, _ = store_of(path)
        folder, _, name = target.rpartition("/")
        aside = f"{folder}/_{name}.{uuid.uuid4().hex}.part"
        store.create_dir(folder, recursive=True)
        at, open_ = 0, False
        try:
            with store.open_output_stream(aside) as out:
                held = bytearray(b"\xef\xbb\xbf" if bom else b"")

                def say(text: str, least: int = 1 << 20) -> None:
                    held.extend(text.encode())
                    if len(held) >= least:
                        out.write(bytes(held))
                        held.clear()

                say(sections[0].before)
                for batch in batches:
                    for section, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        while at < section:
                            say(sections[at].closing if open_ else sections[at].none)
                            at, open_ = at + 1, False
                            say(sections[at].before)
                        say((sections[at].between if open_ else sections[at].opening) + text)
                        open_ = True
                while at < len(sections):
                    say(sections[at].closing if open_ else sections[at].none)
                    at, open_ = at + 1, False
                    say(sections[at].before if at < len(sections) else tail)
                say("", 0)
            store.move(aside, target)
        except BaseException:
            with contextlib.suppress(OSError):
                store.delete_file(aside)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    rows.repartition(1).sortWithinPartitions("section", "one", "two").select("section", "text").mapInArrow(run, "path string").collect()
    return path


def _indented(value: object, depth: int) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n" + "  " * depth)


def _json_list(rows: Iterable[object], depth: int) -> Iterator[str]:
    first = True
    for row in rows:
        yield ("[\n" if first else ",\n") + "  " * (depth + 1) + _indented(row, depth + 1)
        first = False
    yield "[]" if first else "\n" + "  " * depth + "]"


def _csv(rows: Iterable[Sequence[object]], columns: Sequence[str]) -> Iterator[str]:
    buffer = io.StringIO(newline="")
    writer = csv.writer(buffer)
    for row in (columns, *()):
        writer.writerow(row)
    for row in rows:
        writer.writerow(row)
        if buffer.tell() > 1 << 16:
            yield buffer.getvalue()
            buffer.seek(0)
            buffer.truncate()
    yield buffer.getvalue()


def _named(df: DataFrame, old: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in old.items() if v not in df.columns})


_AS_IS = {"parent_id", "seq", "token_count", "char_count", "text_coverage"}


def _json_row(r: dict, keys: Sequence[str]) -> dict:
    """A record of a JSON export, empty values in their place."""
    return {k: r.get(k) if k in _AS_IS else r.get(k) or ([] if k in ("pages", "node_ids") else "") for k in keys}


_JSON_HEAD = f'{{\n  "schema_version": "{VERSION}",\n  "exported_by": "{EXPORTED_BY}",\n  "docs": '
_JSON_CHUNKS, _JSON_TAIL = ',\n  "chunks": ', "\n}\n"


def json_parts(docs: Iterable[dict], chunks: Iterable[dict]) -> Iterator[str]:
    """The text of a JSON export, a part at a time: documents, then chunks."""
    yield _JSON_HEAD
    yield from _json_list((_json_row(r, DOC_JSON) for r in docs), 1)
    yield _JSON_CHUNKS
    yield from _json_list((_json_row(r, CHUNK_JSON) for r in chunks), 1)
    yield _JSON_TAIL


def _csv_values(r: dict) -> list[object]:
    """A chunk's cells; pages joined by commas."""
    return [",".join(map(str, r.get("pages") or ())) if k == "pages" else "" if r.get(k) is None else r[k] for k in CHUNK_CSV]


def csv_parts(chunks: Iterable[dict]) -> Iterator[str]:
    """The text of a CSV export of chunks that name their document."""
    return _csv(map(_csv_values, chunks), CHUNK_CSV)


def chunks_json(docs: DataFrame, chunks: DataFrame, path: str) -> str:
    """One JSON file with documents and chunks, in order of document and sequence."""
    d = _named(docs, {"id": "doc_id", "name": "doc_name", "fmt": "source_format"})
    c = _named(chunks, {"id": "chunk_id"})
    d = d.select(*[k for k in DOC_JSON if k in d.columns])
    c = c.select(*[k for k in CHUNK_JSON if k in c.columns])
    rows = texts(d, lambda r: _indented(_json_row(r, DOC_JSON), 2), 0, F.col("doc_id")).union(texts(c, lambda r: _indented(_json_row(r, CHUNK_JSON), 2), 1, F.col("doc_id"), F.col("seq")))
    return write_single(rows, path, [json_section(_JSON_HEAD, 1), json_section(_JSON_CHUNKS, 1)], _JSON_TAIL)


def _csv_line(values: Sequence[object]) -> str:
    return "".join(_csv([], values))


def chunks_csv(docs: DataFrame, chunks: DataFrame, path: str) -> str:
    """One CSV file of chunks with their document's name: UTF-8 with a mark, CRLF, values as they are."""
    d = _named(docs, {"id": "doc_id", "name": "doc_name"}).select(F.col("doc_id").alias("__doc"), "doc_name")
    c = _named(chunks, {"id": "chunk_id"})
    rows = c.join(d, c["doc_id"] == F.col("__doc"), "left").select("doc_id", *CHUNK_CSV)
    return write_single(texts(rows, lambda r: _csv_line(_csv_values(r)), 0, F.col("doc_id"), F.col("seq")), path, [Section(_csv_line(CHUNK_CSV))], bom=True)


def dataset_file(records: DataFrame, path: str) -> str:
    """Alpaca or ShareGPT records as one JSON file, or CSV with flat columns if the path ends so."""
    if not path.lower().endswith(".csv"):
        return write_single(texts(records, lambda r: _indented(r, 1), 0), path, [json_section("", 0)], "\n")
    meta = [F.col(f"metadata.{m}").alias(m) for m in META]
    if "conversations" in records.columns:
        flat = records.select(F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), *meta)
    else:
        flat = records.select("instruction", "input", "output", *meta)
    return write_single(texts(flat, lambda r: _csv_line(list(r.values())), 0), path, [Section(_csv_line(flat.columns))], bom=True)


def pairs_file(pairs: DataFrame, path: str, mode: str) -> str:
    """Question-answer pairs as one file, with how they were made and how many there are. They are computed once: written
    to the shared folder, then counted and put together."""
    held = written(texts(pairs, lambda r: _indented(r, 2), 0), "pairs")
    head = f'{{\n  "schema_version": "{VERSION}",\n  "exported_by": "{EXPORTED_BY}",\n  "mode": {json.dumps(mode)},\n  "count": {held.count()},\n  "pairs": '
    return write_single(held, path, [json_section(head, 1)], "\n}\n")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of such a file, or of a bare array of them."""
    item = "struct<doc_id:string,chunk_id:string,heading_path:string,question:string,answer:string,context:string,generated_by:string>"
    text = spark.read.text(path, wholetext=True)
    wrapped, bare = F.from_json("value", f"struct<pairs:array<{item}>>")["pairs"], F.from_json("value", f"array<{item}>")
    return text.select(F.explode(F.filter(F.coalesce(wrapped, bare), lambda x: x.isNotNull())).alias("p")).select("p.*")


def json_lines(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """Records as JSON lines, a file for each partition, written by the executors; nulls are left out."""
    df.write.mode(mode).json(path)


def append_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events to a log table, with the time now where they have none."""
    stamped = F.coalesce(F.col(ts), F.current_timestamp()) if ts in events.columns else F.current_timestamp()
    events.withColumn(ts, stamped).write.mode("append").parquet(path)


def log_lines(events: DataFrame, path: str) -> None:
    """Events as flat JSON lines with all nine fields, empty ones as null."""
    row = F.to_json(F.struct(*[(F.col(k) if k in events.columns else F.lit(None).cast("string")).alias(k) for k in LOG]), {"ignoreNullFields": "false"})
    events.select(row.alias("value")).write.mode("append").text(path)


def documents_to_files(rendered: DataFrame, folder: str, *, name: str = "file_name", body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """(columns `keep`, file_name, bytes, error): a file for each row, text or bytes, written now; one failing row fails alone.

    Names may have folders, but no steps upwards. Tasks write aside and move complete files into place; outcomes are
    those of the tasks that were committed. The columns `keep` are of types that JSON has.
    """
    kept = rendered.select(*keep).schema
    row = F.to_json(F.struct(*keep)) if keep else F.lit("{}")
    out = write_files(rendered.select(row.alias("row"), F.col(name).alias("name"), F.col(body).alias("body")), folder, row="row", name="name", body="body")
    return out.select(F.from_json("row", kept).alias("kept"), "file_name", "bytes", "error").select(*[F.col("kept")[c].alias(c) for c in keep], "file_name", "bytes", "error")


def export_all(formats: dict[str, Callable[[], str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Run each format's export; what one fails at doesn't stop the others. An error only if none succeeded."""
    done: dict[str, str] = {}
    failed: dict[str, str] = {}
    for name, export in formats.items():
        try:
            done[name] = export()
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"
    if failed and not done:
        raise RuntimeError(f"nothing was exported: {failed}")
    return done, failed


def output_folder(payload: str | None, settings: str | None, default: str) -> str:
    """Where exports go: what the call says, else the settings, else the default."""
    return payload or settings or default


def export_name(stems: Sequence[str], stamp: str) -> str:
    """One document's stem, or a time stamp for several."""
    return stems[0] if len(stems) == 1 else stamp


def local(path: str | Path) -> str:
    return Path(path).absolute().as_uri()
