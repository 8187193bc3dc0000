"""Schemas of documents as trees of typed nodes, and of chunks."""

from __future__ import annotations

from pyspark.sql import types as T

# The node types, and those that hold others together.
NODE_TYPES = ("section", "paragraph", "table", "figure", "formula", "slide", "sheet", "sheet_region", "header", "footer", "footnote", "list")
CONTAINERS = ("section", "slide", "sheet")

CELL = T.StructType().add("r", "integer").add("c", "integer").add("rowspan", "integer").add("colspan", "integer").add("text", "string").add("is_header", "boolean")
CONTENT = (
    T.StructType().add("text", "string").add("title", "string").add("notes", "string").add("caption", "string").add("ocr_text", "string").add("name", "string")
    .add("range", "string").add("image_ref", "string").add("ordered", "boolean").add("ocr", "boolean").add("cells", T.ArrayType(CELL))
)
NODE = (
    T.StructType().add("doc_id", "string").add("ord", "integer").add("id", "string").add("type", "string").add("parent", "string").add("children", T.ArrayType(T.StringType()))
    .add("level", "integer").add("content", CONTENT).add("pages", T.ArrayType(T.IntegerType())).add("confidence", "double")
)
META = T.StructType().add("local_id", "string").add("parent_local_id", "string").add("part", "integer").add("parts", "integer").add("overlap_chars", "integer").add("merged_cells", "boolean").add("children", "integer").add("blocks", "integer").add("virtual_root", "boolean").add("footnotes", "boolean")
CHUNK = (
    T.StructType().add("id", "string").add("doc_id", "string").add("seq", "integer").add("parent_id", "string").add("kind", "string").add("type", "string").add("text", "string").add("token_count", "long")
    .add("heading_path", "string").add("pages", T.ArrayType(T.IntegerType())).add("node_ids", T.ArrayType(T.StringType())).add("meta", META)
)
