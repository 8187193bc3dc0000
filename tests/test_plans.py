import json

import pandas as pd
from pyspark.sql import functions as F

from folioframe import sinks
from folioframe.operators import grid, tree
from folioframe.plans import catalog, dataset, stats
from folioframe.streaming import events


def test_pairs(spark):
    chunks = spark.createDataFrame(
        [("d1", "d1:p-0001", "parent", "table", "| A | B |\n| --- | --- |\n| 1 | 2 |", "X>Y"), ("d1", "d1:c-0001", "child", "text", "t", "X"), ("d2", "d2:c-0001", "child", "text", " body ", ""), ("d2", "d2:c-0002", "child", "text", " ", "")],
        "doc_id string, id string, kind string, type string, text string, heading_path string",
    )
    docs = spark.createDataFrame([("d1", "One")], "doc_id string, name string")
    rule = {(r.doc_id, r.question) for r in dataset.build_pairs(chunks, docs, mode="rule", per_chunk=9).collect()}
    assert rule == {("d1", "《One》中「Y」的表格包含哪些内容？"), ("d1", "表中「A」这一列有哪些取值？"), ("d1", "表中「B」这一列有哪些取值？"), ("d1", "「Y」这一节讲了什么？"), ("d1", "请简要介绍《One》中「Y」的主要内容。"), ("d2", "《本文档》的这部分内容讲了什么？")}
    blank = dataset.build_pairs(chunks, mode="?", per_chunk=5).collect()
    assert len(blank) == 10 and all(r.answer == "" and r.generated_by == "blank" for r in blank) and len({r.question for r in blank}) == 4
    assert dataset.sharegpt(dataset.build_pairs(chunks)).where("doc_id = 'd2'" if False else "metadata.doc_id = 'd2'").first().conversations[0].value.endswith("参考内容：body")


def test_model_replies(spark):
    df = spark.createDataFrame([("c", 'Sure: [{"question":" Q? ","answer":"A"},{"question":""},{"question":"R"}] ok'), ("d", "none"), ("e", None)], "chunk_id string, reply string")
    assert [tuple(r) for r in dataset.model_pairs(df, reply="reply", n=5).orderBy("question").collect()] == [("c", "Q?", "A", "model"), ("c", "R", "", "model")]
    assert dataset.document_ids([" a", "b", "a", "", None]) == ["a", "b"]


def test_regions_and_serials(spark):
    cells = spark.createDataFrame([(1, r, c) for r, c in ((1, 1), (1, 2), (2, 1), (2, 4), (5, 2))], "s int, r int, c int")
    out = grid.regions(cells, key=["s"]).groupBy("row_island", "col_island").agg(F.collect_set(F.struct("r", "c")).alias("x")).collect()
    assert sorted(sorted(tuple(v) for v in r.x) for r in out) == [[(1, 1), (1, 2), (2, 1)], [(2, 4)], [(5, 2)]]
    assert [r.v for r in spark.createDataFrame([(0.5,), (45000.0,), (45000.25,)], "n double").select(grid.serial_value(F.col("n")).alias("v")).collect()] == ["12:00:00", "2023-03-15", "2023-03-15 06:00:00"]
    merges = spark.createDataFrame([(1, 1, 9, 1, 9)], "s int, r0 int, r1 int, c0 int, c1 int")
    bounds = spark.createDataFrame([(1, 1, 3, 1, 2)], "s int, top int, bottom int, left int, right int")
    assert tuple(grid.clip_spans(merges, bounds, ["s"]).first()) == (1, 1, 1, 3, 2)


def test_dense_grid(spark):
    cells = [(0, 0, 1, 2, "H", True), (1, 1, 1, 1, "x", False), (1, 1, 1, 1, "y", False)]
    df = spark.createDataFrame([(cells,)], "cells array<struct<r:int,c:int,rowspan:int,colspan:int,text:string,is_header:boolean>>")
    row = df.select(grid.dense(F.col("cells")).alias("g"), grid.has_merged(F.col("cells")).alias("m"), grid.header_rows(F.col("cells")).alias("h")).first()
    assert row.g == [["H", ""], ["", "y"]] and row.m and row.h == 1


def test_chains_end_circles(spark):
    df = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "c", "D"), ("e", "d", "E"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "gone", "Z")], "id string, parent string, label string")
    got = {r.id: r.labels for r in tree.chains(df, id_col="id", parent_col="parent", label_col="label").collect()}
    assert got["e"] == list("ABCDE") and got["z"] == ["Z"] and set(got["x"]) <= {"X", "Y"}


def test_chains_of_deep_trees(spark):
    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(70)] + [(100 + k, 100 + (k + 1) % 40, "c") for k in range(40)]
    got = {r.id: r for r in tree.chains(spark.createDataFrame(rows, "id long, parent long, label string"), id_col="id", parent_col="parent", label_col="label").collect()}
    assert all(got[k].ids == list(range(k + 1)) and got[k].labels == [f"n{j}" for j in range(k + 1)] for k in range(70))
    assert len(got) == 110 and all(len(set(got[k].ids)) == len(got[k].ids) for k in range(100, 140))


def test_catalog(spark):
    df = spark.createDataFrame([(k, f"n{k % 2}", k % 3) for k in range(10)], "id int, name string, n int")
    assert [r.id for r in catalog.page(df, [F.desc("id")], number=0, size=9999, largest=3).collect()] == [9, 8, 7]
    assert catalog.select_rows(df, q="N_", columns=["name"]).count() == 10 and catalog.select_rows(df, {"n": 1}, "n1", ["name"]).count() == 2
    assert {r.id for r in catalog.latest(df, ["n"], [F.col("id")]).collect()} == {7, 8, 9}
    assert catalog.replace_documents(df, df.where("id = 0").withColumn("name", F.lit("new")), "n").count() == 7
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, h string")
    assert {r.id: r.duplicate_of for r in catalog.earlier_duplicate(docs, content="h", order=["id"], id_col="id").collect()} == {1: None, 2: 1, 3: None, 4: None}
    assert catalog.terminal_state(spark.createDataFrame([("done",), ("running",), ("canceled",)], "s string"), status="s").count() == 2
    named = catalog.decorate_codes(spark.createDataFrame([("E01",), ("E99",)], "code string"), "code", {"E01": ("bad", "again")}, ("unknown", "report")).collect()
    assert [tuple(r) for r in named] == [("E01", "bad", "again"), ("E99", "unknown", "report")]


def test_stats_of_nothing(spark):
    none = spark.createDataFrame([], "token_count int, doc_id string, status string")
    assert [r["count"] for r in stats.token_histogram(none).collect()] == [0] * 5
    assert stats.cards(none, none).first().success_rate is None


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("d", "名.docx", "docx", "L0", 0.5)], "id string, name string, fmt string, parse_level string, text_coverage double")
    chunks = spark.createDataFrame([("d:c-1", None, "d", 1, "child", "text", '=a,"b"\nc', 3, 5, "H", [1, 2], ["n1"], "sha256:x")], "id string, parent_id string, doc_id string, seq int, kind string, type string, text string, token_count int, char_count int, heading_path string, pages array<int>, node_ids array<string>, hash string")
    at = lambda n: sinks.local(tmp_path / n)
    body = open(sinks.chunks_json(docs.withColumnRenamed("id", "doc_id"), chunks, at("c.json")).removeprefix("file://"), "rb").read()
    data = json.loads(body)
    assert body.startswith(b'{\n  "schema_version"') and body.endswith(b"}\n") and data["docs"][0]["doc_name"] == "名.docx" and list(data["chunks"][0]) == list(sinks.CHUNK_JSON)
    sinks.chunks_csv(docs, chunks, at("c.csv"))
    raw = (tmp_path / "c.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfdoc_name,chunk_id") and raw.endswith(b'"=a,""b""\nc"\r\n') and b'"1,2"' in raw
    pairs = spark.createDataFrame([("d", "c", "H", "Q", "A", "C", "blank")], ", ".join(f"{c} string" for c in dataset.PAIR))
    sinks.dataset_file(dataset.alpaca(pairs), at("a.json")), sinks.dataset_file(dataset.sharegpt(pairs), at("s.csv")), sinks.pairs_file(pairs, at("p.json"), "blank")
    assert json.loads((tmp_path / "a.json").read_text())[0]["metadata"]["chunk_id"] == "c" and (tmp_path / "s.csv").read_text("utf-8-sig").splitlines()[0] == "human,gpt,doc_id,chunk_id,heading_path,generated_by"
    (tmp_path / "bare.json").write_text(json.dumps(json.loads((tmp_path / "p.json").read_text())["pairs"]))
    assert sinks.read_pairs(spark, at("p.json")).collect() == pairs.collect() == sinks.read_pairs(spark, at("bare.json")).collect()
    done, failed = sinks.export_all({"good": lambda: "x", "bad": lambda: 1 / 0})
    assert list(done) == ["good"] and "ZeroDivision" in failed["bad"]
    files = spark.createDataFrame([("a.md", "text"), ("no/such/b.md", "x")], "file_name string, body string")
    out = {r.file_name: r for r in sinks.documents_to_files(files, at("md")).collect()}
    assert (tmp_path / "md/a.md").read_text() == "text" and out["a.md"].bytes == 4
    sinks.log_lines(spark.createDataFrame([("E01",)], "code string"), at("log"))
    assert set(json.loads(spark.read.text(at("log")).first()[0])) == set(sinks.LOG)


def test_streams(spark, tmp_path):
    rows = [("a", 1, "progress", 0.2), ("a", 2, "done", None), ("a", 3, "progress", 0.9), ("b", 4, "progress", 7.0)]
    schema = "task_id string, seq long, event string, progress double"
    spark.createDataFrame(rows[:3], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[3:], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got: dict[str, tuple] = {}

    def sink(batch, number):
        got.update({r.task_id: (r.status, r.events, r.progress) for r in batch.collect()})

    stream = events.task_states(events.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
    events.deliver(stream, sink, str(tmp_path / "checkpoint"), mode="update").awaitTermination()
    assert got == {"a": ("done", 2, 1.0), "b": ("running", 1, 1.0)}
    log = spark.createDataFrame(pd.DataFrame({"task": 1, "seq": range(20), "kind": ["progress"] * 18 + ["info", "done"]}))
    assert sorted(r.seq for r in events.retained(log, task="task", seq="seq", kind="kind", most=10).collect()) == [13, 14, 15, 16, 17, 18, 19]
    assert events.retained(log, task="task", seq="seq", kind="kind", most=20).count() == 20


def test_layout(spark):
    from folioframe.operators import layout

    df = spark.createDataFrame([(["exam-", "ple of", "text", "", "中文", "行"], [["A", " b\nc "], ["", None]])], "l array<string>, t array<array<string>>")
    row = df.select(layout.join_lines(F.col("l")).alias("j"), layout.plain_cells(F.col("t")).alias("c")).first()
    assert row.j == "example of text中文行" and [(c.r, c.c, c.text, c.is_header) for c in row.c] == [(0, 0, "A", True), (0, 1, "b c", True)]
    kinds = spark.createDataFrame([(50, False), (3, True), (3, None)], "n int, i boolean").select(layout.page_kind(F.col("n"), F.col("i")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["text", "scanned", "blank"]
    assert spark.range(1).select(stats.characters_label(F.lit(100)).alias("n")).first().n == 150


def test_node_queries(spark):
    nodes = spark.createDataFrame([("d", "n1", 0.5), ("d", "n2", 0.9)], "doc_id string, id string, confidence double")
    chunks = spark.createDataFrame([("c1", "d", 1, ["n1"]), ("c2", "d", 2, ["n1", "n2"]), ("c3", "e", 1, ["n1"])], "id string, doc_id string, seq int, node_ids array<string>")
    assert {r.id for r in tree.low_confidence_chunks(chunks, nodes).collect()} == {"c1", "c2"}
    assert {(r.doc_id, r.node): r.chunk_id for r in tree.first_chunk_of_node(chunks).collect()} == {("d", "n1"): "c1", ("d", "n2"): "c2", ("e", "n1"): "c3"}


def test_levels_of_any_depth(spark):
    heads = spark.createDataFrame([("d", 1, 1), ("d", 2, 11), ("d", 3, 12), ("d", 4, 11), ("d", 5, None), ("d", 6, 2), ("e", 7, 30)], "doc string, n int, level int")
    got = {r.n: r.parent for r in tree.heading_parents(heads, key="doc", order="n", level="level").collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: 1, 7: None}


def test_large_grids(spark):
    cells = [(r, c, 1, 1, f"{r}.{c}", r == 0) for r in range(3000) for c in range(8)]
    df = spark.createDataFrame([(cells,), ([(2, 3, 2, 2, "x", False), (2, 3, 1, 1, None, False)],), ([],), (None,)], "cells array<struct<r:int,c:int,rowspan:int,colspan:int,text:string,is_header:boolean>>")
    rows = df.select(grid.dense(F.col("cells")).alias("g"), grid.header_rows(F.col("cells")).alias("h")).collect()
    assert rows[0].g == [[f"{r}.{c}" for c in range(8)] for r in range(3000)] and rows[0].h == 1
    assert rows[1].g == [[""] * 5 for _ in range(4)] and rows[2].g is None and rows[3].g is None


def test_parts_in_order(spark):
    """Sums and duplicates over sorted parts equal those of one sorted list."""
    import random

    r = random.Random(4)
    rows = [(k, r.choice(["a", "a", "b", None]), r.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, h string, size int").repartition(6)
    got = {x.id: x.duplicate_of for x in catalog.earlier_duplicate(df, content="h", order=["id"], id_col="id").collect()}
    last: dict = {}
    for k, h, _ in rows:
        assert got[k] == (last.get(h) if h else None)
        last[h] = k
    kept = {x.id: x.running for x in catalog.within_budget(df, size="size", order=[F.desc("id")], budget=300).collect()}
    total, want = 0, {}
    for k, _, n in reversed(rows):
        total += n
        if not want or total <= 300:
            want[k] = total
    assert kept == want


def test_cell_values_snapshots_and_closing_events(spark):
    from folioframe.sources import files

    cells = spark.createDataFrame([("text", None, "t"), ("number", 3.0, None), ("number", 2.5, None), ("bool", 1.0, None), ("error", 7.0, None), ("date", 45000.0, None), ("other", None, None)], "k string, n double, t string")
    assert [x.v for x in cells.select(grid.cell_value(F.col("k"), F.col("n"), F.col("t")).alias("v")).collect()] == ["t", "3", "2.5", "TRUE", "#DIV/0!", "2023-03-15", ""]
    listed = spark.createDataFrame([("/w/d/pages/p3.png", "p3.png"), ("/w/d/x.png", "x.png")], "path string, name string")
    assert [(x.doc_id, x.page) for x in files.snapshots(listed).collect()] == [("pages", 3)]
    tasks = spark.createDataFrame([("a", "canceled"), ("b", "running"), ("c", "done")], "task_id string, status string")
    log = spark.createDataFrame([("a", "progress", 1), ("c", "done", 2)], "task_id string, event string, seq int")
    assert sorted((x.task_id, x.event) for x in events.backfilled(log, tasks).collect()) == [("a", "failed"), ("a", "progress"), ("c", "done")]
    asked = spark.createDataFrame([("a", "running", 0), ("b", "running", 95), ("c", "done", 0)], "id string, status string, s long").withColumn("cancel_requested", F.timestamp_seconds("s"))
    assert [(x.id, x.status) for x in events.overdue(asked, F.timestamp_seconds(F.lit(100))).collect()] == [("a", "canceled")]
