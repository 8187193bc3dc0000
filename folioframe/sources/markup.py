"""Markdown and HTML tables as blocks: a source for text tables. Python's parsers, spread over tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..model import CELL, CONTENT, NODE
from ..shared import bounded_batches, each_row, record_batches

_RULE = re.compile(r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$")
_ITEM = re.compile(r"^([-*+]|\d+[.)])\s+")
_TABLE = re.compile(r"^<table[\s>]", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAX_SPAN = 1000
BLOCK = T.StructType().add("kind", "string").add("level", "integer").add("lang", "string").add("text", "string").add("items", T.ArrayType(T.StringType())).add("ordered", "boolean").add("src", "string").add("cells", T.ArrayType(CELL)).add("head_rows", "integer")


def cells_of(line: str) -> list[str]:
    """Cells of a pipe table's row; an escaped bar belongs to its cell."""
    inner = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


class _Tables(HTMLParser):
    """Tables of a page: rows with their cells; a nested table's rows are its own, scripts and styles give no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.open: list[dict] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append({"rows": [], "cell": None, "row": None, "head": False})
            self.done.append(self.open[-1])
        elif tag in ("script", "style"):
            self.silent += 1
        elif self.open:
            t = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                self._end_row(t)
                t["head"] = tag == "thead"
            elif tag == "tr":
                self._end_row(t)
                t["row"] = []
            elif tag in ("td", "th"):
                self._end_cell(t)
                t["row"] = [] if t["row"] is None else t["row"]
                span = lambda k: min(MAX_SPAN, int(m[0])) if (m := re.match(r"\d+", dict(attrs).get(k) or "")) and int(m[0]) > 1 else 1
                t["cell"] = {"text": "", "is_header": tag == "th", "rowspan": span("rowspan"), "colspan": span("colspan")}
            elif tag == "br":
                self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open:
            t = self.open[-1]
            if tag in ("td", "th"):
                self._end_cell(t)
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                self._end_row(t)
                t["head"] = False if tag == "thead" else t["head"]
            elif tag == "table":
                self._end_row(t)
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for t in self.open:
                if t["cell"] is not None:
                    t["cell"]["text"] += data

    @staticmethod
    def _end_cell(t: dict) -> None:
        if t["cell"] is not None:
            t["row"].append(t["cell"])
        t["cell"] = None

    def _end_row(self, t: dict) -> None:
        self._end_cell(t)
        if t["row"]:
            t["rows"].append((t["head"], t["row"]))
        t["row"] = None

    def close(self) -> None:
        super().close()
        for t in self.open:
            self._end_row(t)


#: Characters below which pages that are equal are parsed once, and how many such a worker keeps.
SHORT, KEPT = 1024, 4096


def html_tables(html: str) -> list[dict]:
    """Tables in order of their start: placed cells, and how many rows stand in the head (these come first)."""
    return _short_tables(html) if len(html) <= SHORT else _tables(html)


def _tables(html: str) -> list[dict]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    out = []
    for t in parser.done:
        rows = [r for head, r in t["rows"] if head] + [r for head, r in t["rows"] if not head]
        taken: set[tuple[int, int]] = set()
        cells = []
        for r, row in enumerate(rows):
            c = 0
            for x in row:
                while (r, c) in taken:
                    c += 1
                cells.append({"r": r, "c": c, **x})
                if x["rowspan"] > 1:
                    taken |= {(r + i, c + j) for i in range(1, min(x["rowspan"], len(rows) - r)) for j in range(x["colspan"])}
                c += x["colspan"]
        if cells:
            out.append({"cells": cells, "head_rows": sum(head for head, _ in t["rows"])})
    return out


_short_tables = lru_cache(maxsize=KEPT)(_tables)


def markdown_blocks(text: str) -> Iterator[dict]:
    """Blocks of a Markdown text, first rule that fits: fence, HTML table, heading, rule, quote, pipe table, image, list, paragraph."""
    lines, at = re.split(r"\r?\n", text), 0

    def table_starts(k: int) -> bool:
        return "|" in lines[k] and k + 1 < len(lines) and "-" in lines[k + 1] and bool(_RULE.match(lines[k + 1]))

    def take(k: int, test) -> int:
        while k < len(lines) and test(lines[k]):
            k += 1
        return k

    while at < len(lines):
        line = lines[at].strip()
        if not line:
            at += 1
        elif m := re.match(r"^```(\w*)\s*$", line):
            end = take(at + 1, lambda x: not x.strip().startswith("```"))
            yield {"kind": "code", "lang": m[1], "text": "\n".join(lines[at + 1 : end])}
            at = end + 1
        elif _TABLE.match(line):
            end = min(take(at, lambda x: not re.search(r"</table>", x, re.I)) + 1, len(lines))
            raw = "\n".join(lines[at:end])
            found = html_tables(raw)
            yield {"kind": "table", **found[0]} if found else {"kind": "paragraph", "text": raw}
            at = end
        elif m := re.match(r"^(#{1,6})\s+(.*)$", line):
            yield {"kind": "heading", "level": len(m[1]), "text": m[2]}
            at += 1
        elif re.match(r"^(-{3,}|\*{3,}|_{3,})$", line):
            yield {"kind": "rule"}
            at += 1
        elif line.startswith(">"):
            end = take(at, lambda x: x.strip().startswith(">"))
            yield {"kind": "quote", "text": "\n".join(re.sub(r"^>\s?", "", x.strip()) for x in lines[at:end])}
            at = end
        elif table_starts(at):
            end = take(at + 2, lambda x: "|" in x and x.strip() != "")
            rows = [cells_of(lines[at]), *map(cells_of, lines[at + 2 : end])]
            yield {"kind": "table", "head_rows": 1, "cells": [{"r": r, "c": c, "rowspan": 1, "colspan": 1, "text": x, "is_header": r == 0} for r, row in enumerate(rows) for c, x in enumerate(row)]}
            at = end
        elif m := re.match(r"^!\[([^\]]*)\]\(([^)]+)\)$", line):
            yield {"kind": "image", "text": m[1], "src": m[2]}
            at += 1
        elif _ITEM.match(line):
            end = take(at, lambda x: bool(_ITEM.match(x.strip())))
            yield {"kind": "list", "ordered": line[0].isdigit(), "items": [_ITEM.sub("", x.strip()) for x in lines[at:end]]}
            at = end
        else:
            end = at + 1
            while end < len(lines) and (t := lines[end].strip()) and not (t[0] in "#>" or t.startswith("```") or _TABLE.match(t) or _ITEM.match(t) or table_starts(end)):
                end += 1
            yield {"kind": "paragraph", "text": "\n".join(x.strip() for x in lines[at:end])}
            at = end


def _each(rows: DataFrame, id_col: str, text_col: str, give, schema: T.StructType) -> DataFrame:
    out_schema = T.StructType().add("id", rows.schema[id_col].dataType).add("n", "integer")
    for f in schema:
        out_schema = out_schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(((len(t), [{"id": i, "n": n, **b} for n, b in enumerate(give(t))]) for i, t in each_row(batches) if t is not None), out_schema)

    bounded_batches(rows)
    return rows.select(rows[id_col].alias("id"), rows[text_col].alias("text")).mapInArrow(run, out_schema).withColumnRenamed("id", id_col)


def blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, block fields) of Markdown texts; null texts give none."""
    return _each(docs, id_col, text_col, markdown_blocks, BLOCK)


TABLE = T.StructType().add("cells", T.ArrayType(CELL)).add("head_rows", "integer")


def tables(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, n, cells, head_rows) of the tables of HTML pages; null pages give none."""
    return _each(pages, id_col, html_col, html_tables, TABLE)


def nodes_from_markdown(text: str) -> list[dict]:
    """A Markdown text's blocks as nodes below its headings, as rows of model.NODE without the document's id."""
    out: list[dict] = []
    stack: list[dict] = []

    def add(kind: str, parent: dict | None, level: int | None = None, **content: object) -> dict:
        node = {"ord": len(out), "id": f"n{len(out) + 1}", "type": kind, "parent": parent["id"] if parent else None, "children": [], "level": level, "content": {f: content.get(f) for f in CONTENT.names}, "pages": [], "confidence": 1.0}
        if parent:
            parent["children"].append(node["id"])
        out.append(node)
        return node

    for b in markdown_blocks(text):
        up = stack[-1] if stack else None
        if b["kind"] == "heading":
            while stack and stack[-1]["level"] >= b["level"]:
                stack.pop()
            stack.append(add("section", stack[-1] if stack else None, b["level"], text=b["text"]))
        elif b["kind"] == "table":
            add("table", up, cells=b["cells"])
        elif b["kind"] == "image":
            add("figure", up, image_ref=b["src"], caption=b["text"] or None)
        elif b["kind"] == "list":
            node = add("list", up, ordered=b["ordered"])
            for item in b["items"]:
                add("paragraph", node, text=item)
        elif b["kind"] != "rule":
            add("paragraph", up, text=b["text"])
    return out


def markdown_nodes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of model.NODE of Markdown texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(((len(t), [{"doc_id": i, **n} for n in nodes_from_markdown(t)]) for i, t in each_row(batches) if t is not None), NODE)

    bounded_batches(docs)
    return docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, NODE)
