"""Plain text documents, slides and sheets as office files, made from columns: what readers of such files can be fed with."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from xml.sax.saxutils import escape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import bounded_batches, each_row, record_batches
from .ooxml import alike, letters

# The namespaces of the formats.
_BASE = "http://schemas.openxmlformats.org"
_W, _P, _S = f"{_BASE}/wordprocessingml/2006/main", f"{_BASE}/presentationml/2006/main", f"{_BASE}/spreadsheetml/2006/main"
_A, _R, _RELS = f"{_BASE}/drawingml/2006/main", f"{_BASE}/officeDocument/2006/relationships", f"{_BASE}/package/2006/relationships"
#: Characters that XML has no place for.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")

FILE = T.StructType().add("hash", "string").add("name", "string").add("ext", "string").add("size", "long").add("content", "binary")


def _xml(text: object) -> str:
    if not isinstance(text, str):
        return ""
    return text if text.isalnum() else escape(_BAD.sub("", text))


def _entry(name: str, body: bytes) -> tuple[bytes, bytes, bytes]:
    """What stands before a part, the part, and its entry in the directory up to the place where it begins."""
    path = name.encode()
    fields = struct.pack("<5H3L2H", 20, 0, 0, 0, 33, crc32(body), len(body), len(body), len(path), 0)
    return b"PK\3\4" + fields + path, body, b"PK\1\2\x14\3" + fields + struct.pack("<3HL", 0, 0, 0, 0o600 << 16)


_kept_entry = lru_cache(maxsize=256)(_entry)


def _package(parts: dict[str, str]) -> bytes:
    """The parts as a zip file, byte by byte as `zipfile` stores them; many or large ones are left to it."""
    bodies = {name: text.encode() for name, text in parts.items()}
    if len(bodies) > 1000 or sum(map(len, bodies.values())) > 1 << 30 or not all(map(str.isascii, bodies)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in bodies.items():
                z.writestr(zipfile.ZipInfo(name), body)  # no date: equal content gives equal bytes
        return out.getvalue()
    front, directory, at = [], [], 0
    for name, body in bodies.items():
        before, body, entry = (_kept_entry if alike(name, body) else _entry)(name, body)
        front += before, body
        directory += entry, struct.pack("<L", at), name.encode()
        at += len(before) + len(body)
    listed = b"".join(directory)
    return b"".join([*front, listed, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(bodies), len(bodies), len(listed), at, 0)])


def _relations(kind: str, targets: Sequence[str]) -> str:
    return f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="rId{k}" Type="{_R}/{kind}" Target="{t}"/>' for k, t in enumerate(targets, 1)) + "</Relationships>"


def text_document(title: str, lines: Sequence[str]) -> bytes:
    """A heading and a paragraph for each line that isn't blank."""
    def paragraph(text: str, style: str = "") -> str:
        return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f'<w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'

    body = paragraph(title, "Heading1") + "".join(paragraph(x) for x in lines if x and x.strip())
    return _package({
        "word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_W}"><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>',
    })


def slides(titles: Sequence[str], bodies: Sequence[str]) -> bytes:
    """A slide with a title and a text for each."""
    def shape(text: str, y: int, kind: str) -> str:
        place = '<p:ph type="title"/>' if kind else ""
        return f'<p:sp><p:nvSpPr><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{_xml(text)}</a:t></a:r></a:p></p:txBody></p:sp>'

    names = f'xmlns:p="{_P}" xmlns:a="{_A}" xmlns:r="{_R}"'
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(titles) + 1))
    parts = {"ppt/presentation.xml": f"<p:presentation {names}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _relations("slide", [f"slides/slide{k}.xml" for k in range(1, len(titles) + 1)])}
    for k, (title, body) in enumerate(zip(titles, bodies, strict=True), 1):
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {names}><p:cSld><p:spTree>{shape(title, 0, 'title')}{shape(body, 50, '')}</p:spTree></p:cSld></p:sld>"
    return _package(parts)


def workbook(name: str, rows: Sequence[Sequence[str]]) -> bytes:
    """One sheet of texts, from its upper left corner; empty texts are no cells."""
    columns = [letters(c) for c in range(1, max(map(len, rows), default=0) + 1)]
    body = "".join([
        f'<row r="{r}">' + "".join([f'<c r="{c}{r}" t="inlineStr"><is><t xml:space="preserve">{_xml(x)}</t></is></c>' for c, x in zip(columns, row, strict=False) if x]) + "</row>"
        for r, row in enumerate(rows, 1)
    ])
    return _package({
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets><sheet name="{_xml(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _relations("worksheet", ["worksheets/sheet1.xml"]),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_S}"><sheetData>{body}</sheetData></worksheet>',
    })


def made(rows: DataFrame, ext: str, make: Callable[..., bytes], *, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Files (hash, name, ext, size, content) as `sources.files.contents` reads them: `make` of the columns of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((row[0], make(*row[1:])) for row in each_row(batches))
        yield from record_batches(((len(data), [{"hash": i, "name": f"{i}.{ext}" if i is not None else None, "ext": ext, "size": len(data), "content": data}]) for i, data in files), FILE)

    bounded_batches(rows)
    return rows.select(F.col(id_col).cast("string").alias("id"), *columns).mapInArrow(run, FILE)
