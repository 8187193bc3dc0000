"""Office files built here, a part at a time, and read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.sources import files, markup, ooxml

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
T = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(*targets):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{T}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets, 1)) + "</Relationships>"


def para(text, style="", extra="", before=""):
    props = f'<w:pPr><w:pStyle w:val="{style}"/>{extra}</w:pPr>' if style or extra else ""
    return f"<w:p>{props}{before}<w:r><w:t>{text}</w:t></w:r></w:p>"


NUM = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{}"/></w:numPr>'


def docx(body=None):
    body = body or (
        para("Chapter", "Heading1") + para("Section", "Heading2") + para("Hello 世界") + para("one", "", NUM.format(1)) + para("two", "", NUM.format(1)) + para("dot", "", NUM.format(2))
        + para("Next", "Heading1", "", '<w:r><w:br w:type="page"/></w:r>')
        + '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:tc></w:tr>'
        + '<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>L</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
        + "<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        + '<w:p><w:r><a:blip r:embed="rId2"/></w:r></w:p>' + para("Picture one", "Caption") + '<w:sectPr><w:headerReference r:id="rId1"/></w:sectPr>'
    )
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("Heading1", "heading 1"), ("Heading2", "heading 2"), ("Caption", "caption")))
    numbers = '<w:abstractNum w:abstractNumId="0"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    return package(**{
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>", "word/numbering.xml": f"<w:numbering {W}>{numbers}</w:numbering>",
        "word/header1.xml": f"<w:hdr {W}>{para('Head line')}</w:hdr>", "word/media/a.png": b"png", "word/_rels/document.xml.rels": rels(("header", "header1.xml"), ("image", "media/a.png")),
    })


def pptx():
    shape = lambda text, y, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="50"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tblPr firstRow="1"/><a:tr><a:tc gridSpan="2"><a:txBody><a:p><a:r><a:t>H</a:t></a:r></a:p></a:txBody></a:tc><a:tc hMerge="1"/></a:tr><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    slide = f"<p:sld {P}><p:cSld><p:spTree>{shape('Below', 90)}{shape('Above', 10)}{shape('The title', 0, 'title')}{table}</p:spTree></p:cSld></p:sld>"
    notes = f"<p:notes {P}><p:cSld><p:spTree>{shape('Speak up', 0, 'body')}{shape('7', 0, 'sldNum')}</p:spTree></p:cSld></p:notes>"
    return package(**{
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rels(("notesSlide", "../notesSlides/notesSlide1.xml")), "ppt/notesSlides/notesSlide1.xml": notes,
    })


def xlsx():
    cells = {
        1: '<c r="A1" t="inlineStr"><is><t>Budget</t></is></c>', 2: '<c r="A2" t="inlineStr"><is><t>Name</t></is></c><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>When</t></is></c>',
        3: '<c r="A3" t="inlineStr"><is><t>Rent</t></is></c><c r="B3"><v>12.5</v></c><c r="C3" s="1"><v>45000</v></c><c r="F3" t="b"><v>1</v></c>', 4: '<c r="A4" t="inlineStr"><is><t>Sum</t></is></c><c r="B4"><f>SUM(B3)</f></c>',
        7: '<c r="B7"><v>3</v></c>',
    }
    sheet = f'<worksheet {S}><sheetData>{"".join(f"<row r={chr(34)}{r}{chr(34)}>{c}</row>" for r, c in cells.items())}</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>'
    return package(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Plan" sheetId="1" r:id="rId1"/><sheet name="None" sheetId="2" r:id="rId2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml")),
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>Amo</t></r><r><t>unt</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
        "xl/styles.xml": f'<styleSheet {S}><fonts><font/></fonts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })


def test_docx():
    tree, level = ooxml.decode(docx(), "docx")
    kinds = [(n["type"], n["content"].get("text"), n["parent"], n["pages"]) for n in tree.nodes]
    assert level == "L0" and kinds[:3] == [("section", "Chapter", None, [1]), ("section", "Section", "n1", [1]), ("paragraph", "Hello 世界", "n2", [1])]
    lists = [n for n in tree.nodes if n["type"] == "list"]
    assert [n["content"]["ordered"] for n in lists] == [True, False] and [len(n["children"]) for n in lists] == [2, 1]
    table = next(n for n in tree.nodes if n["type"] == "table")
    assert table["pages"] == [2] and [(c["r"], c["c"], c["rowspan"], c["colspan"], c["text"], c["is_header"]) for c in table["content"]["cells"]] == [(0, 0, 1, 2, "Top", True), (1, 0, 2, 1, "L", False), (1, 1, 1, 1, "b", False), (2, 1, 1, 1, "d", False)]
    figure = next(n for n in tree.nodes if n["type"] == "figure")
    assert figure["content"]["caption"] == "Picture one" and figure["content"]["image_ref"] == "assets/img001.png"
    assert [n["content"]["text"] for n in tree.nodes if n["type"] == "header"] == ["Head line"]
    assert tree.stated_chars == sum(len("".join(t.split())) for t in ("Chapter", "Section", "Hello 世界", "one", "two", "dot", "Next", "Top", "L", "b", "d", "Picture one", "Head line"))


def test_pptx():
    tree, _ = ooxml.decode(pptx(), "pptx")
    slide = tree.nodes[0]
    assert slide["content"] == {"title": "The title", "notes": "Speak up"} and [n["content"].get("text") for n in tree.nodes[1:] if n["type"] == "paragraph"] == ["Above", "Below"]
    assert [n["type"] for n in tree.nodes] == ["slide", "paragraph", "table", "paragraph"] and [c["colspan"] for c in tree.nodes[2]["content"]["cells"]] == [2, 1, 1]


def test_xlsx():
    tree, _ = ooxml.decode(xlsx(), "xlsx")
    assert [(n["type"], n["content"].get("range") or n["content"].get("name")) for n in tree.nodes] == [("sheet", "Plan"), ("sheet_region", "A1:C4"), ("sheet_region", "F1:F4"), ("sheet_region", "B7:B7")] or [n["content"].get("range") for n in tree.nodes[1:]] == ["A1:C4", "F1:F4", "B7:B7"]
    cells = {(c["r"], c["c"]): c for c in tree.nodes[1]["content"]["cells"]}
    assert cells[0, 0]["colspan"] == 3 and [cells[1, k]["text"] for k in range(3)] == ["Name", "Amount", "When"] and all(cells[1, k]["is_header"] for k in range(3))
    assert cells[2, 1]["text"] == "12.5" and cells[2, 2]["text"].startswith("2023-03-15") and cells[3, 1]["text"] == "=SUM(B3)"
    assert [w[0] for w in tree.warnings] == ["E05"]


@pytest.mark.parametrize(("data", "kind", "code"), [(b"zip? no", "docx", "E01"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(600), "docx", "E02"), (b"x", "pdf", "E03"), (package(**{"a.txt": "x"}), "docx", "E01"), (docx("<w:p/>"), "docx", "E05"), (package(**{"word/document.xml": "<!DOCTYPE x><x/>"}), "docx", "E01")])
def test_rejects(data, kind, code):
    with pytest.raises(ooxml.Rejected) as e:
        ooxml.decode(data, kind)
    assert e.value.code == code


def test_numbers():
    assert [ooxml.shown(v) for v in (None, True, 3.0, 0.1 + 0.2, 1234567.5, " x ")] == ["", "TRUE", "3", "0.3", "1.23457e+06", "x"]
    assert ooxml.letters(28) == "AB" and ooxml.number("$AB$7") == (7, 28)


def test_folder(spark, tmp_path):
    for name, data in {"a.docx": docx(), "b.pptx": pptx(), "sub/c.xlsx": xlsx(), "d.docx": docx(), "bad.docx": b"PK\x03\x04broken", "e.txt": b"text", "empty.docx": b"", "~$a.docx": b"lock"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    codes = {r.name: r.code for r in files.gated(files.listing(spark, str(tmp_path))).collect()}
    assert codes == {"a.docx": None, "b.pptx": None, "c.xlsx": None, "d.docx": None, "bad.docx": None, "e.txt": "E03", "empty.docx": "E05"}
    rows = files.measured(files.parsed(files.contents(spark, str(tmp_path)), id_col="name"))
    got = {r.name: r for r in rows.collect()}
    assert {k: (r.status, r.code) for k, r in got.items()} == {"a.docx": ("ok", None), "d.docx": ("ok", None), "b.pptx": ("ok", None), "c.xlsx": ("warning", None), "bad.docx": ("failed", "E01")}
    assert got["a.docx"].text_coverage == 1.0 and got["b.pptx"].text_coverage == 1.0
    from folioframe.plans import chunking, render

    nodes = files.nodes_of(rows)
    chunks = chunking.chunk_nodes(nodes).where("kind = 'child'")
    assert chunks.where("type = 'sheet_region'").count() == 3 and chunks.where(F.col("text").contains("Hello")).count() == 2
    assert render.render_documents(nodes).where(F.col("body").contains("# Chapter")).count() == 2
    assert files.room_needed(files.listing(spark, str(tmp_path))) > 2 * 1024**3


def test_markdown_and_html_tables(spark):
    kinds = [b["kind"] for b in markup.markdown_blocks("# T\n\npara\nmore\n\n|a|b|\n|-|-|\n|1|2|\n- x\n1. y\n> q\n```\ncode\n```\n![p](i.png)\n***\n<table><tr><td>z</table>")]
    assert kinds == ["heading", "paragraph", "table", "list", "quote", "code", "image", "rule", "table"]
    found = markup.html_tables("<table><thead><tr><th>A<th>B</thead><tr><td rowspan=2>1<td>2<br>x<script>no</script><tr><td>3<table><tr><td>in</table></table>")
    assert found[0]["head_rows"] == 1 and [(c["r"], c["c"], c["text"]) for c in found[0]["cells"]] == [(0, 0, "A"), (0, 1, "B"), (1, 0, "1"), (1, 1, "2\nx"), (2, 1, "3in")] and len(found) == 2
    nodes = markup.nodes_from_markdown("# A\n## B\ntext\n# C\n- i")
    assert [(n["type"], n["parent"]) for n in nodes] == [("section", None), ("section", "n1"), ("paragraph", "n2"), ("section", None), ("list", "n4"), ("paragraph", "n5")]
    df = spark.createDataFrame([(1, "# A\n\nx"), (2, None)], "doc_id long, text string")
    assert markup.markdown_nodes(df).count() == 2 and markup.blocks(df).count() == 2
