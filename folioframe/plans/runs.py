"""Runs over many documents: import, stored trees, assets, chunks anew, question-answer files, exports.

Each takes tables and gives a table of outcomes; what fails for one document or file is a row with a code and a reason.
Only a run that brings nothing at all is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sinks
from ..functions.text import image_ref, safe_filename
from ..model import NODE
from ..shared import written
from ..sources import files
from ..sources.folder import write_files
from . import catalog, chunking, dataset, render
from .packing import Options

# What is exported for each document alone and what can be merged, modes of question-answer pairs.
ALONE, MERGEABLE = ("md", "html"), ("json", "csv", "alpaca", "sharegpt")
ENDINGS = {"md": ".md", "html": ".print.html", "json": ".chunks.json", "csv": ".chunks.csv", "alpaca": ".alpaca.json", "sharegpt": ".sharegpt.json", "qa": ".qa.json"}
MODES = ("blank", "rule", "model")


class Refused(Exception):
    """A run that was not begun, or brought nothing; with its code."""

    def __init__(self, code: str, reason: str) -> None:
        super().__init__(f"{code}: {reason}")
        self.code = code


# ---------------------------------------------------------------- import


def room(spark: SparkSession, folder: str) -> int:
    """Bytes that are free where the folder is or will be."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getStatus().getRemaining()


def check_room(spark: SparkSession, folder: str, need: int) -> None:
    free = room(spark, folder)
    if need > free:
        raise Refused("E07", f"{need} bytes are needed, {free} are free")


def import_files(spark: SparkSession, folder: str, workspace: str, known: DataFrame | None = None, *, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(imported, skipped) of the files below a folder.

    imported: doc_id, name, src_path, stored_path, fmt, size, hash, duplicate_of, status. Each file's bytes are copied to
    `workspace`/doc_id, block by block, by tasks that move complete copies into place; duplicate_of is the id of an earlier document of the same content, of `known` (doc_id, hash) or
    of this import, and only a remark. skipped: path, name, code, reason, is_kmod (a module package, which another way
    takes). The whole import is refused (E07) where the workspace has too little room; a copy that fails is skipped.
    """
    listed = written(files.gated(files.listing(spark, folder, pattern)), "listing")
    check_room(spark, workspace, files.room_needed(listed.where("code IS NULL")))
    outcomes = write_files(listed.where("code IS NULL"), workspace, row="path", name="name", source="path", named="content")
    found = outcomes.select(F.col("row").alias("from"), F.col("file_name").alias("stored"), F.col("bytes").alias("size"), F.col("sha256").alias("hash"), "error")
    copied = listed.where("code IS NULL").drop("size").join(found, F.col("path") == F.col("from"))
    good = copied.where("error IS NULL").withColumn("doc_id", F.substring_index("stored", "/", 1))
    order = good.select("doc_id", "hash", F.lit(1).alias("turn"), "path")
    if known is not None:
        order = order.union(known.select("doc_id", "hash", F.lit(0), F.lit("")))
    earlier = catalog.earlier_duplicate(order, content="hash", order=["turn", "path", "doc_id"], id_col="doc_id").where("turn = 1").select("doc_id", "duplicate_of")
    imported = good.join(earlier, "doc_id").select("doc_id", "name", F.col("path").alias("src_path"), F.concat_ws("/", F.lit(workspace.rstrip("/")), "stored").alias("stored_path"), F.col("ext").alias("fmt"), "size", "hash", "duplicate_of", F.lit("imported").alias("status"))
    refused = listed.where("code IS NOT NULL").select("path", "name", "code", F.concat(F.lit("not taken: "), F.coalesce(F.col("ext"), F.lit("")), F.lit(", "), F.col("size"), F.lit(" bytes")).alias("reason"))
    failed = copied.where("error IS NOT NULL").select("path", "name", F.lit("E01").alias("code"), F.col("error").alias("reason"))
    return imported, refused.union(failed).withColumn("is_kmod", F.lower("name").endswith(".kmod"))


def resolved(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Documents with the path to read: the stored copy if it is listed, else the source, else code E01."""
    here = listed.select(F.col("path").alias("at")).distinct()
    stored, source = here.withColumnRenamed("at", "a"), here.withColumnRenamed("at", "b")
    found = docs.join(stored, docs["stored_path"] == stored["a"], "left").join(source, docs["src_path"] == source["b"], "left")
    path = F.coalesce("a", "b")
    return found.select(*[docs[c] for c in docs.columns], path.alias("read_path"), F.when(path.isNull(), "E01").alias("code"))


# ---------------------------------------------------------------- stored trees and assets

TREE = T.StructType().add("version", "string").add("doc_id", "string").add("name", "string").add("parse_level", "string").add("pages", "integer").add("nodes", T.ArrayType(T.StructType([f for f in NODE.fields if f.name != "doc_id"])))


def store_trees(parsed: DataFrame, workspace: str) -> DataFrame:
    """Outcomes (doc_id, file_name, bytes, error) of writing each parsed file's tree as compact JSON, without nulls."""
    body = F.to_json(F.struct(F.lit(sinks.VERSION).alias("version"), *[F.col(f.name) for f in TREE.fields[1:]]))
    rows = parsed.where("status <> 'failed'").select("doc_id", F.concat("doc_id", F.lit("/ir.json")).alias("file"), body.alias("body"))
    return sinks.documents_to_files(rows, workspace, name="file", body="body", keep=["doc_id"])


def read_trees(spark: SparkSession, workspace: str, code: str = "E05") -> DataFrame:
    """Stored trees (doc_id, name, parse_level, pages, nodes, size, code): a file that can't be read has `code` and no nodes.

    `code` is E05 where chunks are made anew, E01 where trees are exported.
    """
    text = spark.read.text(f"{workspace.rstrip('/')}/*/ir.json", wholetext=True).withColumn("path", F.input_file_name())
    rows = text.select("path", F.length("value").alias("size"), F.from_json("value", TREE, {"mode": "PERMISSIVE"}).alias("t"))
    good = F.col("t.doc_id").isNotNull() & F.col("t.nodes").isNotNull()
    return rows.select(F.when(good, F.col("t.doc_id")).otherwise(F.element_at(F.split("path", "/"), -2)).alias("doc_id"), "t.name", "t.parse_level", "t.pages", F.when(good, F.col("t.nodes")).alias("nodes"), "size", F.when(~good, code).alias("code"))


def rechunk(spark: SparkSession, workspace: str, asked: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(chunks, failed): chunks of stored trees under other settings, and (doc_id, code) of documents without a readable one.

    `asked`: doc_id. `catalog.replace_documents` puts the chunks in place of the old ones.
    """
    trees = written(read_trees(spark, workspace).join(asked.select("doc_id").distinct(), "doc_id", "left_semi"), "trees")
    missing = asked.select("doc_id").distinct().join(trees.where("code IS NULL"), "doc_id", "left_anti").withColumn("code", F.lit("E05"))
    return chunking.chunk_nodes(files.nodes_of(trees.where("code IS NULL")), options), missing


def copy_assets(parsed: DataFrame, folder: str) -> DataFrame:
    """(doc_id, file_name, bytes, error): the pictures that trees refer to, written below `folder`/doc_id; a missing one is a row with a reason."""
    ref = F.explode(F.array_distinct(F.filter(F.transform("nodes", lambda n: image_ref(n["content"]["image_ref"])), lambda x: x != "")))
    refs = parsed.select("doc_id", ref.alias("ref"))
    assets = parsed.select(F.col("doc_id").alias("of"), F.explode("assets").alias("a")).select("of", F.col("a.path").alias("at"), "a.data")
    found = refs.join(assets, (refs["doc_id"] == assets["of"]) & (refs["ref"] == assets["at"]), "left").withColumn("file", F.concat_ws("/", "doc_id", "ref"))
    copied = sinks.documents_to_files(found.where("data IS NOT NULL"), folder, name="file", body="data", keep=["doc_id"])
    missing = found.where("data IS NULL").select("doc_id", F.col("file").alias("file_name"), F.lit(0).cast("long").alias("bytes"), F.lit("missing").alias("error"))
    return copied.union(missing)


# ---------------------------------------------------------------- exports


def asked_ids(spark: SparkSession, ids: DataFrame | Sequence[object]) -> DataFrame:
    """Ids as a table, each once; a sequence is trimmed, and an error if it names nothing."""
    if isinstance(ids, DataFrame):
        return ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    return spark.createDataFrame([(i,) for i in dataset.document_ids(ids)], "doc_id string")


def _plain(value: object) -> object:
    """A cell of a pandas row as Python has it: lists, plain numbers, None for what is missing."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if not isinstance(value, list) and pd.isna(value) else value


def _chunk_bodies(docs: DataFrame, chunks: DataFrame, formats: Sequence[str], mode: str, per_chunk: int) -> DataFrame:
    """(doc_id, format, body) of the formats made of chunks: a document's own meet in one task, which they bound."""
    d = sinks._named(docs, {"name": "doc_name", "fmt": "source_format"})
    plain = [f for f in formats if f in ("json", "csv")]
    records = [f for f in formats if f in ("alpaca", "sharegpt", "qa")]
    out: list[DataFrame] = []
    schema = "doc_id string, format string, body string"
    if plain:

        def run(mine: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            if not len(mine):
                return pd.DataFrame({"doc_id": [], "format": [], "body": []}, dtype=object)
            doc = mine.astype(object).where(mine.notna(), None).to_dict("records")[0]
            rows = parts.sort_values("seq", kind="stable").to_dict("records") if len(parts) else []
            doc = {k: _plain(v) for k, v in doc.items()}
            rows = [{k: _plain(v) for k, v in r.items()} | {"doc_name": doc.get("doc_name")} for r in rows]
            made = {"json": lambda: "".join(sinks.json_parts([doc], rows)), "csv": lambda: "\ufeff" + "".join(sinks.csv_parts(rows))}
            return pd.DataFrame([(doc["doc_id"], f, made[f]()) for f in plain], columns=["doc_id", "format", "body"])

        c = sinks._named(chunks, {"id": "chunk_id"}).select(*sinks.CHUNK_JSON)
        out.append(d.groupBy("doc_id").cogroup(c.groupBy("doc_id")).applyInPandas(run, schema))
    if records:
        pairs = dataset.build_pairs(chunks, docs, mode=mode, per_chunk=per_chunk)
        made = {"alpaca": dataset.alpaca, "sharegpt": dataset.sharegpt, "qa": lambda p: p.withColumn("metadata", F.struct("doc_id", "chunk_id"))}
        for f in records:
            rows = made[f](pairs)
            whole = F.to_json(F.struct(*[c for c in rows.columns if f != "qa" or c != "metadata"]), {"ignoreNullFields": "false"})
            lists = rows.groupBy(F.col("metadata.doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("metadata.chunk_id").alias("c"), whole.alias("j")))).alias("r"))
            body = F.concat(F.lit("[\n  "), F.array_join(F.transform("r", lambda x: x["j"]), ",\n  "), F.lit("\n]\n"))
            if f == "qa":
                body = F.concat(F.lit(f'{{\n  "schema_version": "{sinks.VERSION}",\n  "exported_by": "{sinks.EXPORTED_BY}",\n  "mode": "{mode}",\n  "count": '), F.size("r").cast("string"), F.lit(',\n  "pairs": '), body, F.lit("}\n"))
            empty = F.lit("[]\n") if f != "qa" else F.lit(f'{{"schema_version": "{sinks.VERSION}", "mode": "{mode}", "count": 0, "pairs": []}}\n')
            names = docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(lists.select("doc_id", body.alias("body")), "doc_id", "left")
            out.append(names.select("doc_id", F.lit(f).alias("format"), F.coalesce("body", empty).alias("body")))
    return _union(out, docs.sparkSession, schema)


def _union(parts: Sequence[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.union(part)
    return out


def file_names(docs: DataFrame, formats: Column) -> DataFrame:
    """(doc_id, format, file_name) for each document and format: its name without ending, made safe, and unique in the folder."""
    endings = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    stem = safe_filename(F.coalesce(F.regexp_replace("name", r"\.[^.]*$", ""), F.col("doc_id")))
    rows = docs.select("doc_id", F.explode(formats).alias("format"), stem.alias("stem")).select("doc_id", "format", F.concat("stem", F.element_at(endings, F.col("format"))).alias("wanted"), F.lit("").alias("folder"))
    return catalog.unique_names(rows, folder="folder", name="wanted", order="doc_id", id_col="doc_id").select("doc_id", "format", "file_name")


def export(
    docs: DataFrame, chunks: DataFrame, trees: DataFrame | None, ids: DataFrame | Sequence[object], formats: Sequence[str], folder: str, *,
    merge: bool = False, stamp: str = "export", mode: str = "blank", per_chunk: int = 1,
) -> DataFrame:
    """Outcomes (doc_id, format, file_name, bytes, code, reason) of exporting documents in formats.

    docs: doc_id, name and what else is known of them; trees: doc_id, nodes. Markdown and print pages are made of trees,
    a file for each document, always; the other formats of chunks, a file each or, with `merge`, one for all (doc_id
    null). A document that isn't there fails with E03, one without a tree with E05, both alone. A document without
    chunks gives empty files. A run without a single file raises the first code.
    """
    spark = docs.sparkSession
    unknown = sorted(set(formats) - {*ALONE, *MERGEABLE})
    if unknown or not formats:
        raise Refused("E03", f"no such format: {', '.join(unknown) or 'none named'}")
    asked = asked_ids(spark, ids)
    single = [f for f in dict.fromkeys(formats) if f in ALONE or not merge]
    mine = docs.join(asked, "doc_id", "left_semi")
    own = chunks.join(asked, "doc_id", "left_semi")
    outcomes: list[DataFrame] = []
    schema = "doc_id string, format string, file_name string, bytes long, code string, reason string"
    if single:
        bodies = [_chunk_bodies(mine, own, [f for f in single if f in MERGEABLE], mode, per_chunk)]
        if trees is not None:
            nodes = files.nodes_of(trees.where("nodes IS NOT NULL").join(asked, "doc_id", "left_semi"))
            bodies += [render.render_documents(nodes, how).select("doc_id", F.lit(f).alias("format"), "body") for f, how in (("md", render.markdown), ("html", render.print_html)) if f in single]
        made = _union(bodies, spark, "doc_id string, format string, body string")
        named = file_names(mine, F.array(*map(F.lit, single))).join(made, ["doc_id", "format"], "left")
        files_ = sinks.documents_to_files(named.where("body IS NOT NULL"), folder, keep=["doc_id", "format"])
        none = lambda kind: F.lit(None).cast(kind)
        outcomes.append(files_.select("doc_id", "format", "file_name", "bytes", F.when(F.col("error").isNotNull(), "E06"), "error"))
        outcomes.append(named.where("body IS NULL").select("doc_id", "format", none("string"), none("long"), F.lit("E05"), F.lit("no tree to export")))
        gone = asked.join(docs, "doc_id", "left_anti").select("doc_id", F.explode(F.array(*map(F.lit, single))))
        outcomes.append(gone.select("*", none("string"), none("long"), F.lit("E03"), F.lit("no such document")))
    done = written(_union(outcomes, spark, schema), "outcomes")
    if merge:
        done = done.union(_merged(mine, own, [f for f in dict.fromkeys(formats) if f in MERGEABLE], f"{folder.rstrip('/')}/{stamp}", mode, per_chunk, schema))
    if done.where("code IS NULL").isEmpty():
        first = done.orderBy("doc_id", "format").first()
        raise Refused(first.code if first else "E05", first.reason if first else "nothing to export")
    return done


def _merged(docs: DataFrame, chunks: DataFrame, formats: Sequence[str], stem: str, mode: str, per_chunk: int, schema: str) -> DataFrame:
    """Outcomes of the merged files, each streamed in order to one place; one that fails doesn't stop the others."""
    spark = docs.sparkSession
    pairs = dataset.build_pairs(chunks, docs, mode=mode, per_chunk=per_chunk)
    how = {
        "json": lambda path: sinks.chunks_json(docs, chunks, path), "csv": lambda path: sinks.chunks_csv(docs, chunks, path),
        "alpaca": lambda path: sinks.dataset_file(dataset.alpaca(pairs), path), "sharegpt": lambda path: sinks.dataset_file(dataset.sharegpt(pairs), path),
    }
    rows = []
    for f in formats:
        path = stem + ENDINGS[f]
        try:
            how[f](path)
            rows.append((None, f, path, None, None, None))
        except Exception as e:
            rows.append((None, f, None, None, "E06", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- question-answer pairs and datasets


def resolved_mode(payload: dict[str, object] | None, settings: str = "blank") -> str:
    """How pairs are made: what the call says, else what its dataset settings say, else the settings; unknown ones are blank."""
    payload = payload or {}
    own = payload.get("dataset")
    said = payload.get("mode") or (own.get("mode") if isinstance(own, dict) else None) or settings
    return said.lower() if isinstance(said, str) and said.lower() in MODES else "blank"


def require_model(ready: bool) -> None:
    """Refuse a whole run that needs a model where there is none, before anything is planned."""
    if not ready:
        raise Refused("MODEL_NOT_INSTALLED", "no model is installed")


def make_pairs(docs: DataFrame, chunks: DataFrame, ids: DataFrame | Sequence[object], folder: str, *, mode: str = "blank", kind: str | None = None, per_chunk: int = 1, merge: bool = False, stamp: str = "pairs") -> DataFrame:
    """Outcomes (doc_id, file_name, bytes, code, reason) of writing question-answer pairs: a file a document, or one with `merge`.

    `kind` picks parents or children; without it each document's parents are taken if it has any.
    """
    spark = docs.sparkSession
    asked = asked_ids(spark, ids)
    own = catalog.select_rows(chunks.join(asked, "doc_id", "left_semi"), {"kind": kind})
    mine = docs.join(asked, "doc_id", "left_semi")
    gone = asked.join(docs, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit("E03"), F.lit("no such document"))
    schema = "doc_id string, file_name string, bytes long, code string, reason string"
    if merge:
        path = f"{folder.rstrip('/')}/{stamp}{ENDINGS['qa']}"
        sinks.pairs_file(dataset.build_pairs(own, mine, mode=mode, per_chunk=per_chunk), path, mode)
        return _union([spark.createDataFrame([(None, path, None, None, None)], schema), gone], spark, schema)
    bodies = _chunk_bodies(mine, own, ["qa"], mode, per_chunk)
    named = file_names(mine, F.array(F.lit("qa"))).join(bodies, ["doc_id", "format"])
    files_ = sinks.documents_to_files(named, folder, keep=["doc_id"])
    done = written(_union([files_.select("doc_id", "file_name", "bytes", F.when(F.col("error").isNotNull(), "E06"), "error"), gone], spark, schema), "outcomes")
    if done.where("code IS NULL").isEmpty():
        raise Refused(done.first().code if not done.isEmpty() else "E05", "no pairs were written")
    return done


def build_dataset(spark: SparkSession, source: DataFrame | str, path: str, *, style: str = "alpaca", docs: DataFrame | None = None, mode: str = "blank", per_chunk: int = 1) -> str:
    """One dataset file of chunks, or of a file of pairs that was edited."""
    pairs = sinks.read_pairs(spark, source) if isinstance(source, str) else dataset.build_pairs(source, docs, mode=mode, per_chunk=per_chunk)
    return sinks.dataset_file({"alpaca": dataset.alpaca, "sharegpt": dataset.sharegpt}[style](pairs), path)
