"""What Python workers hold does not grow with the table; imports are read back without a shuffle."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe import catalogue, shared
from folioframe.plans import chunking, render
from folioframe.sources import files, markup, office_writer, ooxml

ONE = T.StructType().add("text", "string")


def largest_batch(monkeypatch, call, columns: list[str], rows: list[tuple], schema: str, spark) -> int:
    """Rows of the largest Arrow batch that the map of `call` gives for one batch of `rows`."""
    taken = {}
    df = spark.createDataFrame(rows[:1], schema)
    kind = type(df)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, s: taken.update(f=f, s=self) or spark.createDataFrame([], s))
    call(df)
    monkeypatch.undo()
    some = pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows])
    return max(b.num_rows for b in taken["f"](iter([some])))


def test_batches_by_rows_and_size():
    sizes = [b.num_rows for b in shared.record_batches(((1, [{"text": "x"}]) for _ in range(5000)), ONE)]
    assert sizes == [2000, 2000, 1000]
    assert max(b.num_rows for b in shared.record_batches(((1 << 20, [{"text": "x"}]) for _ in range(40)), ONE)) == 4


def test_markdown_blocks_give_bounded_batches(spark, monkeypatch):
    rows = [(k, "a\n\n" * 20) for k in range(1000)]
    assert largest_batch(monkeypatch, markup.blocks, ["id", "text"], rows, "doc_id long, text string", spark) <= shared.MOST_ROWS + 20


def test_chunks_give_bounded_batches(spark, monkeypatch):
    rows = [(str(k), ["word " * 20] * 8) for k in range(3000)]
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert largest_batch(monkeypatch, lambda _: chunking.chunk_texts(df), ["doc_id", "blocks"], rows, "doc_id string, blocks array<string>", spark) <= shared.MOST_ROWS + 20


def test_files_are_made_and_read_in_bounded_batches(spark, monkeypatch):
    made = lambda df: office_writer.made(df, "docx", office_writer.text_document, id_col="id", columns=["title", "lines"])
    rows = [(str(k), "t", ["x"]) for k in range(2500)]
    assert largest_batch(monkeypatch, made, ["id", "title", "lines"], rows, "id string, title string, lines array<string>", spark) <= shared.MOST_ROWS
    data = office_writer.text_document("t", ["x"])
    read = [(str(k), "n", "docx", data) for k in range(2500)]
    df = spark.createDataFrame([("a", "n", "docx", data)], "hash string, name string, ext string, content binary")
    assert largest_batch(monkeypatch, lambda _: files.parsed(df), ["doc_id", "name", "ext", "content"], read, "doc_id string, name string, ext string, content binary", spark) <= shared.MOST_ROWS


def test_import_to_markdown_needs_no_shuffle(spark, tmp_path):
    docs = [(1, "a\nb | c", "s"), (2, "", "s"), (3, None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["import_to_markdown"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    parsed = files.parsed(catalogue._text_files(spark, str(tmp_path)))
    want = render.render_documents(files.nodes_of(parsed)).orderBy("doc_id").collect()
    assert found.orderBy(F.col("doc_id")).collect() == want and len(want) == 2


def test_equal_short_pages_are_parsed_once(monkeypatch):
    parsed, kind = [], markup._Tables
    monkeypatch.setattr(markup, "_Tables", lambda: parsed.append(1) or kind())
    page = "<table><tr><td>only here<td>2</table>"
    assert markup.html_tables(page) == markup.html_tables(page) and len(parsed) == 1
    long = page + " " * markup.SHORT
    assert markup.html_tables(long) == markup.html_tables(long) == markup.html_tables(page) and len(parsed) == 3


def test_parts_that_are_alike_are_parsed_once(monkeypatch):
    data = [office_writer.workbook("Alike", [["a", "b"], ["1", x]]) for x in "xy"]
    first = ooxml.decode(data[0], "xlsx")[0].nodes
    calls, parse = [], ooxml.ET.fromstring
    monkeypatch.setattr(ooxml.ET, "fromstring", lambda x: calls.append(1) or parse(x))
    second = ooxml.decode(data[1], "xlsx")[0].nodes
    assert len(calls) == 1  # the sheet
    assert [c["text"] for c in first[1]["content"]["cells"]] == ["a", "b", "1", "x"] and [c["text"] for c in second[1]["content"]["cells"]] == ["a", "b", "1", "y"]


def test_plain_packages_are_written_and_read_without_zipfile(monkeypatch):
    made = []
    for kind, mode in (("plain", 0), ("packed", zipfile.ZIP_DEFLATED)):
        parts = {"xl/workbook.xml": "<a/>", f"{kind}.xml": "<b>x &amp; y</b>" * 9, "empty.xml": ""}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(zipfile.ZipInfo(name), body, mode)
        assert mode or office_writer._package(parts) == out.getvalue()  # byte by byte
        made.append((parts, out.getvalue()))
    many = office_writer._package({f"p{k}.xml": str(k) for k in range(70_000)})
    assert zipfile.ZipFile(io.BytesIO(many)).read("p69999.xml") == b"69999" == ooxml.Package(many).zip.read("p69999.xml")
    monkeypatch.setattr(zipfile, "ZipFile", None)
    for parts, data in made:
        package = ooxml.Package(data)
        assert {n: package.zip.read(n).decode() for n in package.names} == parts
    assert ooxml.decode(office_writer.workbook("S", [["a", ""], ["", "<&>"]]), "xlsx")[0].nodes[1]["content"]["cells"][1]["text"] == "<&>"


def test_other_packages_are_left_to_zipfile():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/ä.xml", "<a/>" * 50)
        z.writestr("b.xml", "<b/>" * 50)
    data = out.getvalue()
    for seen in (data, b"front" + data, data[:-2] + b"\x03\x00end"):
        package = ooxml.Package(seen)
        assert package.names == {"word/ä.xml", "b.xml"} and package.zip.read("b.xml") == b"<b/>" * 50
    plain = office_writer._package({"a.xml": "<a>text</a>", "b.xml": "<b/>"})
    for spoiled in (plain.replace(b"text", b"tuxt"), plain.replace(b"PK\x03\x04", b"PK\x03\x05", 1), plain.replace(b"a.xml", b"c.xml", 1)):
        with pytest.raises(zipfile.BadZipFile):
            ooxml.Package(spoiled).zip.read("a.xml")
    with pytest.raises(ooxml.Rejected):
        ooxml.Package(plain[:-1])


def test_rows_of_lists_as_python_values():
    rows = [{"a": [["x", None], [], ["y"]], "b": [1]}, {"a": [], "b": None}, {"a": [None, ["z"]], "b": []}]
    batch = pa.RecordBatch.from_pylist(rows * 50, pa.schema({"a": pa.list_(pa.list_(pa.string())), "b": pa.list_(pa.int64())}))
    assert list(shared.each_row(iter([batch.slice(1), batch.slice(2, 7)]))) == [(r["a"], r["b"]) for r in (rows * 50)[1:] + (rows * 50)[2:9]]


def test_sheets_with_merged_cells_formulas_and_numbers():
    sheet = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="2"><c r="B2" t="inlineStr"><is><t>Top</t></is></c><c r="D2" t="inlineStr"><is><r><t>Ri</t></r><r><t>ch</t></r></is></c></row>'
        '<row><c r="B3"><v>1.5</v></c><c t="b"><v>1</v></c><c><f>A1</f></c></row><row r="3"><c r="F3" t="inlineStr"><is><t> </t></is></c></row><row r="9"><c t="str"><v>far</v></c></row></sheetData><mergeCells><mergeCell ref="B2:C2"/></mergeCells></worksheet>'
    )
    whole = zipfile.ZipFile(io.BytesIO(office_writer.workbook("S", [])))
    parts = {n: whole.read(n).decode() for n in whole.namelist()} | {"xl/worksheets/sheet1.xml": sheet}
    tree, level = ooxml.decode(office_writer._package(parts), "xlsx")
    regions = {n["content"]["range"]: [(c["r"], c["c"], c["colspan"], c["text"], c["is_header"]) for c in n["content"]["cells"]] for n in tree.nodes[1:]}
    assert level == "L0" and tree.stated_chars == 3 + 4 + 3 + 4 + 3
    assert regions == {"B2:D3": [(0, 0, 2, "Top", True), (0, 2, 1, "Rich", True), (1, 0, 1, "1.5", False), (1, 1, 1, "TRUE", False), (1, 2, 1, "=A1", False)], "A9:A9": [(0, 0, 1, "far", False)]}
