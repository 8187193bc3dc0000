"""Documents as Markdown and as printable HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NODE
from ..shared import bounded_batches, each_row, record_batches
from .chunking import document_rows
from .packing import Table

BODY = T.StructType().add("doc_id", "string").add("body", "string")
_TAG = re.compile(r"<(?=[A-Za-z/!?])")


def safe(text: object) -> str:
    return _TAG.sub("&lt;", text if isinstance(text, str) else "").strip()


def cell(text: str) -> str:
    return _TAG.sub("&lt;", text).replace("|", r"\|").replace("\r\n", "\n").replace("\n", "<br>").strip()


def image_path(ref: object) -> str:
    parts = [p for p in (ref if isinstance(ref, str) else "").replace("\\", "/").split("/") if p not in ("", ".", "..")]
    parts = parts[1:] if parts[:1] == ["assets"] else parts
    return "assets/" + "/".join(parts) if parts else ""


def markdown_table(table: Table) -> str:
    rows = [[cell(c) for c in r] for r in table.grid]
    lines = [rows[0], ["---"] * len(rows[0]), *rows[1:]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def html_table(cells: list[dict]) -> str:
    """A table with its spans; leading rows of heads only are its head."""
    rows: dict[int, list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["r"], c["c"])):
        rows.setdefault(c["r"], []).append(c)

    def line(row: list[dict]) -> str:
        out = ""
        for c in row:
            tag = "th" if c.get("is_header") else "td"
            spans = "".join(f' {k}="{int(c[k])}"' for k in ("rowspan", "colspan") if (c.get(k) or 1) > 1)
            out += f"<{tag}{spans}>" + html.escape(c.get("text") or "").replace("\n", "<br>") + f"</{tag}>"
        return f"<tr>{out}</tr>"

    order = sorted(rows)
    head = 0
    while head < len(order) and all(c.get("is_header") for c in rows[order[head]]):
        head += 1
    parts = ["<table>"]
    for tag, some in (("thead", order[:head]), ("tbody", order[head:])):
        if some:
            parts += [f"<{tag}>", *[line(rows[r]) for r in some], f"</{tag}>"]
    return "\n".join([*parts, "</table>"])


def any_table(cells: list[dict] | None) -> str:
    table = Table.of(cells)
    return "" if table is None else html_table(cells) if table.merged else markdown_table(table)


class Walk:
    """Visits a document's nodes from its roots, then what no root reaches; each node once."""

    def __init__(self, nodes: list[dict]) -> None:
        self.nodes = nodes
        self.by_id = {n["id"]: n for n in nodes}
        self.seen: set[str] = set()

    def children(self, node: dict) -> list[dict]:
        return [self.by_id[c] for c in node["children"] or [] if c in self.by_id]

    def hide(self, node: dict) -> None:
        """Count a node and all below it as seen."""
        work = [node]
        while work:
            n = work.pop()
            if n["id"] not in self.seen or n is node:
                self.seen.add(n["id"])
                work += [c for c in self.children(n) if c["id"] not in self.seen]

    def run(self, enter: Callable[[dict, int], tuple[bool, Callable[[], None] | None, int]]) -> None:
        """enter(node, depth) tells whether to go below, what to do after, and the depth there."""
        for start in [*(n for n in self.nodes if n["parent"] is None), *self.nodes]:
            work: list[tuple[dict | Callable[[], None], int]] = [(start, 0)]
            while work:
                item, depth = work.pop()
                if callable(item):
                    item()
                    continue
                if item["id"] in self.seen:
                    continue
                self.seen.add(item["id"])
                below, after, deeper = enter(item, depth)
                if after:
                    work.append((after, depth))
                if below:
                    work += [(c, deeper) for c in reversed(self.children(item))]


def list_items(walk: Walk, node: dict, show: Callable[[dict], str]) -> list[tuple[int, str, str]]:
    """(depth, marker, text) for the items of a list and of the lists in it; numbers skip items without text."""
    out: list[tuple[int, str, str]] = []
    open_lists = [(iter(walk.children(node)), count(1), bool(node["content"].get("ordered")))]
    depth = {id(open_lists[0][0]): 0}
    while open_lists:
        items, number, ordered = open_lists[-1]
        child = next((c for c in items if c["id"] not in walk.seen), None)
        if child is None:
            open_lists.pop()
            continue
        walk.seen.add(child["id"])
        inner, text = [child], ""
        if child["type"] != "list":
            text = show(child)
            inner = [c for c in walk.children(child) if c["type"] == "list" and c["id"] not in walk.seen] if text else []
        if text:
            out.append((depth[id(items)], f"{next(number)}." if ordered else "-", text))
        for one in reversed(inner):
            walk.seen.add(one["id"])
            open_lists.append((iter(walk.children(one)), count(1), bool(one["content"].get("ordered"))))
            depth[id(open_lists[-1][0])] = depth[id(items)] + 1
    return out


def item_text(child: dict) -> str:
    content = child["content"]
    return any_table(content.get("cells")) if child["type"] == "table" and content.get("cells") else safe(content.get("text"))


def markdown(nodes: list[dict], *, drop_header_footer: bool = True, footnote_to_end: bool = True) -> str:
    """A document as Markdown: every node's text once, in reading order."""
    out: list[str] = []
    foot: list[str] = []
    walk = Walk(nodes)

    def enter(node: dict, depth: int) -> tuple[bool, Callable[[], None] | None, int]:
        kind, content = node["type"], node["content"]
        text, get = safe(content.get("text")), content.get
        after = None
        if kind == "section":
            if text:
                out.append("#" * max(1, min(6, int(node["level"] or depth + 1))) + " " + text)
            return True, None, depth + 1
        if kind in ("table", "sheet_region"):
            if kind == "sheet_region" and safe(get("range")):
                out.append(f"**区域 {safe(get('range'))}**")
            out.append(any_table(get("cells")))
        elif kind == "figure":
            path, caption = image_path(get("image_ref")), safe(get("caption"))
            if path:
                out.append(f"![{cell(caption) or '图片'}]({path})")
            if caption:
                out.append(f"*{caption}*")
            elif not path:
                out.append(safe(get("ocr_text")))
        elif kind == "formula":
            raw = (get("text") or "").strip()
            out.append(f"$$\n{raw}\n$$" if raw else "")
        elif kind == "slide":
            out.append(f"## {safe(get('title') or get('text')) or '（无标题幻灯片）'}")
            notes = safe(get("notes"))
            if notes:
                after = lambda: out.append("> **备注**\n>\n" + "\n".join(f"> {x}" for x in notes.splitlines()))
            return True, after, depth + 1
        elif kind == "sheet":
            out.append(f"## 工作表：{safe(get('name') or get('text')) or '（未命名）'}")
            return True, None, depth + 1
        elif kind in ("header", "footer"):
            if drop_header_footer:
                walk.hide(node)
                return False, None, depth
            out.append(f"*{text}*" if text else "")
        elif kind == "footnote":
            if text:
                (foot if footnote_to_end else out).append(text.replace("\n", " ") if footnote_to_end else f"> {text}")
            return False, None, depth
        elif kind == "list":
            lines = []
            for indent, marker, item in list_items(walk, node, item_text):
                lines.append("  " * indent + f"{marker} " + item.replace("\n", "\n" + "  " * indent + "   "))
            out.append("\n".join(lines))
            return False, None, depth
        else:
            out.append(text)
        return True, after, depth

    walk.run(enter)
    if foot:
        out += ["## 脚注", "\n".join(f"{i}. {t}" for i, t in enumerate(foot, 1))]
    body = "\n\n".join(b.strip("\n") for b in out if b.strip())
    return body + "\n" if body else ""


#: Point sizes that print is held to.
SMALLEST, LARGEST = 8, 24


def print_html(nodes: list[dict], title: str = "", *, font_size: float = 12, header_footer: bool = True) -> str:
    """A document as one HTML page for print, without any reference to a network: every node has its id as anchor."""
    size = min(LARGEST, max(SMALLEST, font_size))
    out: list[str] = []
    foot: list[str] = []
    walk = Walk(nodes)
    show = lambda t: html.escape(t.strip() if isinstance(t, str) else "").replace("\n", "<br>")

    def enter(node: dict, depth: int) -> tuple[bool, Callable[[], None] | None, int]:
        kind, content = node["type"], node["content"]
        text, anchor = show(content.get("text")), f' id="{html.escape(node["id"])}"'
        after = None
        if kind == "section":
            level = max(1, min(6, int(node["level"] or depth + 1)))
            out.append(f"<h{level}{anchor}>{text}</h{level}>" if text else "")
            return True, None, depth + 1
        if kind in ("slide", "sheet"):
            name = show(content.get("title") or content.get("name") or content.get("text"))
            out.append(f"<h2{anchor}>{name or ('（无标题幻灯片）' if kind == 'slide' else '（未命名）')}</h2>")
            notes = show(content.get("notes"))
            after = (lambda: out.append(f'<aside class="notes">{notes}</aside>')) if notes else None
            return True, after, depth + 1
        if kind in ("table", "sheet_region"):
            if show(content.get("range")):
                out.append(f"<p{anchor}><b>区域 {show(content['range'])}</b></p>")
            out.append(html_table(content["cells"]) if content.get("cells") else "")
        elif kind == "figure":
            path, caption = image_path(content.get("image_ref")), show(content.get("caption"))
            body = (f'<img src="{html.escape(path)}" alt="{caption}">' if path else show(content.get("ocr_text"))) + (f"<figcaption>{caption}</figcaption>" if caption else "")
            out.append(f"<figure{anchor}>{body}</figure>" if body else "")
        elif kind in ("header", "footer"):
            walk.hide(node)
            return False, None, depth
        elif kind == "footnote":
            if text:
                foot.append(text)
            return False, None, depth
        elif kind == "list":
            items = list_items(walk, node, lambda c: html_table(c["content"]["cells"]) if c["content"].get("cells") else show(c["content"].get("text")))
            out.append(f'<div class="list"{anchor}>' + "".join(f'<p style="margin-left:{indent * 2}em">{marker} {item}</p>' for indent, marker, item in items) + "</div>" if items else "")
            return False, None, depth
        else:
            out.append(f"<p{anchor}>{text}</p>" if text else "")
        return True, after, depth

    walk.run(enter)
    if foot:
        out.append("<h2>脚注</h2><ol>" + "".join(f"<li>{t}</li>" for t in foot) + "</ol>")
    margin = "20mm 18mm" if header_footer else "12mm"
    style = f"@page{{size:A4;margin:{margin}}}body{{font-size:{size:g}pt}}table{{border-collapse:collapse}}td,th{{border:1px solid #888;padding:2pt 4pt}}thead{{display:table-header-group}}"
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head>\n<body>\n' + "\n".join(b for b in out if b) + "\n</body></html>\n"


def render_texts(docs: DataFrame, *, id_col: str, blocks: Column, how: Callable[[list[dict]], str] = markdown) -> DataFrame:
    """(doc_id, body) of plain texts, a paragraph for each of `blocks`. A map: nothing is shuffled. No blocks: no row."""

    def body(doc: str, texts: list[str]) -> tuple[int, list[dict]]:
        text = how([{"id": f"n{k}", "type": "paragraph", "parent": None, "children": [], "level": None, "content": {"text": t}, "pages": []} for k, t in enumerate(texts, 1)])
        return len(text), [{"doc_id": doc, "body": text}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches((body(doc, texts) for doc, texts in each_row(batches) if texts), BODY)

    bounded_batches(docs)
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), blocks.alias("blocks")).mapInArrow(run, BODY)


def render_documents(nodes: DataFrame, how: Callable[[list[dict]], str] = markdown) -> DataFrame:
    """(doc_id, body) from rows of model.NODE."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "body": [how(document_rows(pdf))]})

    return nodes.select(*NODE.names).groupBy("doc_id").applyInPandas(run, "doc_id string, body string")


def render_parsed(rows: DataFrame, how: Callable[[list[dict]], str] = markdown) -> DataFrame:
    """(doc_id, body) of parsed files, whose rows hold all their nodes in order. A map: nothing is shuffled. No nodes: no row."""

    def body(doc: str | None, nodes: list[dict]) -> tuple[int, list[dict]]:
        text = how([n | {"content": n["content"] or {}, "children": n["children"] or [], "pages": n["pages"] or []} for n in nodes])
        return len(text), [{"doc_id": doc, "body": text}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches((body(doc, nodes) for doc, nodes in each_row(batches) if nodes), BODY)

    bounded_batches(rows)
    return rows.select("doc_id", "nodes").mapInArrow(run, BODY)
