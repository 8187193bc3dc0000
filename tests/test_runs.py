"""From a folder of files to exports and back, one document failing alone."""

import json

import pytest
from pyspark.sql import functions as F

from folioframe import sinks
from folioframe.functions import text as tx
from folioframe.functions import tokens as tk
from folioframe.plans import catalog, chunking, runs
from folioframe.plans.packing import Options
from folioframe.sources import files, office_writer

PNG = b"\x89PNG\r\n\x1a\npicture"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("in")
    lines = [f"Line {k} of a text. It has words." for k in range(40)]
    (top / "sub").mkdir()
    (top / "a.docx").write_bytes(office_writer.text_document("Title", lines))
    (top / "sub" / "a.docx").write_bytes(office_writer.text_document("Title", lines))
    (top / "b.pptx").write_bytes(office_writer.slides(["One", "Two"], ["first", "second"]))
    (top / "c.xlsx").write_bytes(office_writer.workbook("S", [["H", "I"], ["1", "2"]]))
    (top / "bad.docx").write_bytes(b"PK\x03\x04broken")
    (top / "m.kmod").write_bytes(b"module")
    (top / "empty.docx").write_bytes(b"")
    return top


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    return tmp_path_factory.mktemp("work")


@pytest.fixture(scope="module")
def imported(spark, folder, workspace):
    good, skipped = runs.import_files(spark, str(folder), workspace.as_uri())
    return good.persist(), skipped


def test_import(spark, folder, workspace, imported):
    good, skipped = imported
    rows = {r.src_path.split("/in", 1)[-1].partition("/")[2]: r for r in good.collect()}
    assert set(rows) == {"a.docx", "sub/a.docx", "b.pptx", "c.xlsx", "bad.docx"} and len({r.doc_id for r in rows.values()}) == 5
    assert rows["sub/a.docx"].duplicate_of == rows["a.docx"].doc_id and rows["a.docx"].duplicate_of is None
    assert all((workspace / r.doc_id / r.name).read_bytes() == (folder / k).read_bytes() for k, r in rows.items())
    assert {(r.name, r.code, r.is_kmod) for r in skipped.collect()} == {("m.kmod", "E03", True), ("empty.docx", "E05", False)}
    known = good.where("name = 'b.pptx'").select(F.lit("old").alias("doc_id"), "hash")
    again = runs.import_files(spark, str(folder), workspace.as_uri(), known)[0]
    assert {r.duplicate_of for r in again.where("name = 'b.pptx'").collect()} == {"old"}
    with pytest.raises(runs.Refused, match="E07"):
        runs.check_room(spark, str(folder), 1 << 60)
    here = files.listing(spark, str(folder))
    found = {r.name: (r.read_path, r.code) for r in runs.resolved(good.withColumn("src_path", F.lit("gone")).withColumn("stored_path", F.when(F.col("name") == "b.pptx", F.lit("gone too")).otherwise(F.col("src_path"))), here).collect()}
    assert found["b.pptx"] == (None, "E01")


@pytest.fixture(scope="module")
def parsed(spark, workspace, imported):
    rows = files.contents(spark, str(workspace)).withColumn("doc", F.element_at(F.split("path", "/"), -2))
    return files.measured(files.parsed(rows, id_col="doc")).persist()


def test_trees_chunks_and_exports(spark, workspace, imported, parsed, tmp_path):
    stored = runs.store_trees(parsed, workspace.as_uri())
    assert stored.where("error IS NULL").count() == 4
    trees = runs.read_trees(spark, workspace.as_uri()).persist()
    assert trees.where("code IS NOT NULL").count() == 0
    sorted_nodes = lambda df: sorted(map(str, files.nodes_of(df).select("doc_id", "ord", "type", "parent", "content.text", "pages").collect()))
    assert sorted_nodes(trees) == sorted_nodes(parsed.where("status <> 'failed'"))
    summary = catalog.ir_summary(trees, largest=2000).select("doc_id", "node_count", "size").collect()
    assert all((r.node_count is None) == (r.size > 2000) for r in summary) and {r.node_count is None for r in summary} == {True, False}

    ids = [r.doc_id for r in imported[0].collect()]
    chunks = chunking.chunk_nodes(files.nodes_of(trees)).persist()
    small, missing = runs.rechunk(spark, workspace.as_uri(), spark.createDataFrame([(i,) for i in [*ids, "gone"]], "doc_id string"), Options(target=32, hard=64))
    direct = chunking.chunk_nodes(files.nodes_of(parsed), Options(target=32, hard=64))
    assert sorted(map(tuple, small.select("id", "hash").collect())) == sorted(map(tuple, direct.select("id", "hash").collect())) and small.count() > chunks.count()
    assert {r.code for r in missing.collect()} == {"E05"} and missing.count() == 2
    (workspace / ids[0] / "ir.json").write_text("{broken")
    assert [r.code for r in runs.read_trees(spark, workspace.as_uri(), "E01").where("nodes IS NULL").collect()] == ["E01"]

    docs = imported[0].join(parsed.select("doc_id", F.col("status").alias("s"), "parse_level", "text_coverage"), "doc_id").select("doc_id", "name", "fmt", "parse_level", "text_coverage")
    out = runs.export(docs, chunks, trees, [*ids, "gone"], ["md", "html", "json", "csv", "alpaca", "sharegpt"], tmp_path.as_uri())
    rows = out.collect()
    codes = {(r.doc_id, r.format): r.code for r in rows}
    bad = next(r.doc_id for r in docs.collect() if r.name == "bad.docx")
    assert len(rows) == 36 and {codes["gone", f] for f in ("md", "csv")} == {"E03"} and codes[bad, "md"] == codes[bad, "html"] == "E05" and codes[bad, "csv"] is None
    names = {r.file_name for r in rows if r.format == "md" and r.code is None}
    assert len(names) == 4 and "a.md" in names and sum(n.endswith("-a.md") for n in names) == 1 and (tmp_path / "a.md").read_text().startswith("# Title\n\nLine 0 of")
    data = json.loads((tmp_path / "b.chunks.json").read_text())
    assert data["docs"][0]["doc_name"] == "b.pptx" and [c["seq"] for c in data["chunks"]] == list(range(1, len(data["chunks"]) + 1))
    assert (tmp_path / "b.chunks.csv").read_bytes().startswith(b"\xef\xbb\xbfdoc_name,chunk_id") and "b.pptx,b" not in (tmp_path / "b.chunks.csv").read_text("utf-8-sig").splitlines()[0]
    assert json.loads((tmp_path / "b.alpaca.json").read_text())[0]["metadata"]["doc_id"] in ids and len(json.loads((tmp_path / "b.sharegpt.json").read_text())[0]["conversations"]) == 2
    assert json.loads((tmp_path / "bad.alpaca.json").read_text()) == []

    merged = runs.export(docs, chunks, trees, ids, ["md", "json", "csv", "alpaca"], (tmp_path / "m").as_uri(), merge=True, stamp="all").collect()
    assert {(r.format, r.doc_id is None) for r in merged if r.code is None} == {("md", False), ("json", True), ("csv", True), ("alpaca", True)}
    assert len(json.loads((tmp_path / "m/all.chunks.json").read_text())["chunks"]) == chunks.count()
    with pytest.raises(runs.Refused, match="E03"):
        runs.export(docs, chunks, trees, ["gone"], ["csv"], tmp_path.as_uri())
    with pytest.raises(runs.Refused, match="E03"):
        runs.export(docs, chunks, trees, ids, ["docx"], tmp_path.as_uri())

    done = runs.make_pairs(docs, chunks, [*ids, "gone"], (tmp_path / "qa").as_uri(), mode="rule", per_chunk=2).collect()
    assert sorted(r.code or "" for r in done) == ["", "", "", "", "", "E03"]
    qa = json.loads((tmp_path / "qa/a.qa.json").read_text())
    assert qa["count"] == len(qa["pairs"]) > 0 and set(qa["pairs"][0]) == set(sinks.META) | {"question", "answer", "context"}
    runs.make_pairs(docs, chunks, ids, (tmp_path / "qa").as_uri(), merge=True, stamp="every")
    assert json.loads(open(runs.build_dataset(spark, sinks.local(tmp_path / "qa/every.qa.json"), sinks.local(tmp_path / "d.json"), style="sharegpt").removeprefix("file://")).read())[0]["conversations"][0]["from"] == "human"


def test_assets(spark, tmp_path):
    row = files.PARSED
    node = lambda k, ref: {"ord": k, "id": f"n{k}", "type": "figure", "parent": None, "children": [], "level": None, "content": {"image_ref": ref}, "pages": [], "confidence": 1.0}
    doc = {"doc_id": "d", "name": "d.docx", "status": "parsed", "nodes": [node(1, "assets/img001.png"), node(2, "../img001.png"), node(3, "assets/no.png")], "warnings": [], "assets": [{"path": "assets/img001.png", "sha256": "x", "data": PNG}]}
    out = {r.file_name: r for r in runs.copy_assets(spark.createDataFrame([doc], row), tmp_path.as_uri()).collect()}
    assert (tmp_path / "d/assets/img001.png").read_bytes() == PNG and out["d/assets/no.png"].error == "missing" and out["d/assets/img001.png"].bytes == len(PNG) and len(out) == 2


def test_modes_and_guards(spark):
    assert [runs.resolved_mode(p, s) for p, s in (({"mode": "RULE"}, "blank"), ({"dataset": {"mode": "model"}}, "rule"), ({}, "rule"), (None, "blank"), ({"mode": "?"}, "rule"))] == ["rule", "model", "rule", "blank", "blank"]
    with pytest.raises(runs.Refused, match="MODEL_NOT_INSTALLED"):
        runs.require_model(False)
    tasks = spark.createDataFrame([("d", "done"), ("e", "queued")], "doc_id string, status string")
    assert not catalog.active(tasks, "d") and catalog.active(tasks, "e")
    assert [tuple(r) for r in catalog.page_with_total(spark.range(7), [F.col("id")], number=2, size=3).collect()] == [(3, 7), (4, 7), (5, 7)]
    docs = spark.createDataFrame([("Plan A", "ok"), ("plan b", "failed")], "name string, status string")
    assert [r.name for r in catalog.exportable(docs, "PLAN").collect()] == ["Plan A"]
    lists = spark.createDataFrame([(["a", "b"], ["b", "c"])], "m array<string>, p array<string>").select(*[c.alias(n) for c, n in zip(catalog.missing_members(F.col("m"), F.col("p")), "xy", strict=True)])
    assert tuple(lists.first()) == (["c"], ["a"])
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, n int")
    assert [r.v for r in catalog.upsert(changes.limit(0), changes, ["k"], [F.col("n")]).collect()] == ["y"]
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, v string, new_0 string")
    assert sorted(map(tuple, catalog.patch(base, spark.createDataFrame([(1, None, None)], "k int, v string, new_0 string"), "k", nulls=["v"]).collect())) == [(1, None, "b"), (2, "c", "d")]


def test_labels_for_people(spark):
    ms = spark.createDataFrame([(None,), (7.4,), (1500.0,), (61_000.0,)], "v double")
    assert [r[0] for r in ms.select(tx.milliseconds_label(F.col("v"))).collect()] == ["—", "7ms", "1.5s", "1m1s"]
    times = spark.createDataFrame([(0, 0), (0, 59), (0, 61), (0, 3700), (5, 0)], "a long, b long").select(tx.duration_label(F.timestamp_seconds("a"), F.timestamp_seconds("b")).alias("d"))
    assert [r.d for r in times.collect()] == ["<1s", "59s", "1m1s", "1h1m", "—"]
    shares = spark.createDataFrame([(None,), (0.5,), (70.0,), (250.0,), (-1.0,)], "v double")
    assert [r[0] for r in shares.select(tx.percent_label(F.col("v"))).collect()] == ["—", "50%", "70%", "250%", "-100%"]
    assert [r[0] for r in shares.select(tx.progress_value(F.col("v"))).collect()] == [0.0, 50.0, 70.0, 100.0, 0.0]
    assert spark.range(1).select(tx.shortened(F.lit("abcdef"), 3)).first()[0] == "abc…"


def test_tokenizer_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = spark.createDataFrame([("Hello world",), (None,), ("",)], "t string")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    want = len(tokenizers.Tokenizer.from_file(path).encode("Hello world", add_special_tokens=False).ids)
    assert [r[0] for r in texts.select(tk.count_tokens(F.col("t"), path)).collect()] == [want, 0, 0]
    estimate = [r[0] for r in texts.select(tk.estimate_tokens(F.col("t"))).collect()]
    assert [r[0] for r in texts.select(tk.count_tokens(F.col("t"), "/no/such/file")).collect()] == estimate == [r[0] for r in texts.select(tk.count_tokens(F.col("t"))).collect()]
