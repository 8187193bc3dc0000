"""Listings, streams and writing of files by tasks; import of a large and mixed folder; names that never clash."""

import hashlib
import os
import time

import pytest
from pyspark.sql import functions as F

from folioframe.plans import catalog, runs
from folioframe.sources import files, folder, office_writer


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """6,000 files in folders of three levels, most of them refused, one of 3 GB (of holes), one unreadable by name."""
    top = tmp_path_factory.mktemp("many")
    for k in range(6000):
        place = top / f"d{k % 7}" / f"e{k % 3}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f{k}.{('txt', 'TXT', 'mp4', 'docx')[k % 4] if k % 100 else 'docx'}").write_bytes(b"" if k % 1000 == 4 else b"data %d" % (k // 8))
    with open(top / "video.mp4", "wb") as f:
        f.truncate(3 << 30)
    with open(top / "d1" / "large.docx", "wb") as f:
        f.truncate(3 << 30)
    deep = top / "d0"
    for k in range(9):
        deep = deep / f"l{k}"
    deep.mkdir(parents=True)
    (deep / "too_deep.docx").write_bytes(b"x")
    os.symlink(top, top / "d2" / "circle")
    return top


def test_listing_has_no_cap_and_takes_filters(spark, many):
    listed = files.listing(spark, str(many))
    assert listed.count() == 6002 and listed.rdd.getNumPartitions() == 1 + 8 - 1 + 7 * 3 + 1  # the top, d0 to d6, their folders
    plan = listed.where("ext = 'docx' AND size > 100 AND name LIKE 'l%'")
    assert [r.name for r in plan.collect()] == ["large.docx"]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in text and "Filter" not in text.split("BatchScan")[0]  # the source has taken all of them
    assert files.listing(spark, str(many), "f1?.docx").count() == sum(k % 4 == 3 or k % 100 == 0 for k in range(10, 20))
    assert files.listing(spark, str(many / "nowhere")).count() == 0


def test_contents_never_opens_what_is_refused(spark, many):
    rows = files.contents(spark, str(many))
    assert rows.count() == sum((k % 4 == 3 or k % 100 == 0) and k % 1000 != 4 for k in range(6000))
    assert rows.agg(F.max(F.length("content")).alias("n")).first().n < 100  # no 3 GB file was read
    assert files.contents(spark, str(many), "v*").count() == 0 and files.contents(spark, str(many), "*.mp4").count() == 0


def test_import_of_many_files(spark, many, tmp_path):
    good, skipped = runs.import_files(spark, str(many), tmp_path.as_uri())
    good, skipped = good.persist(), skipped.persist()
    docx = [k for k in range(6000) if (k % 4 == 3 or k % 100 == 0) and k % 1000 != 4]
    assert good.count() == len(docx) and skipped.count() == 6002 - len(docx)
    assert {(r.code, r["count"]) for r in skipped.groupBy("code").count().collect()} == {("E03", sum(not (k % 4 == 3 or k % 100 == 0) for k in range(6000)) + 1), ("E05", 1)} or skipped.where("name = 'large.docx'").first().code == "E05"
    assert skipped.where("name = 'video.mp4'").first().code == "E03"
    assert sorted(os.listdir(tmp_path)) == sorted(["_staging", *(r.doc_id for r in good.collect())])
    one = good.where("name = 'f100.docx'").first()
    assert (tmp_path / one.doc_id / "f100.docx").read_bytes() == b"data 12" and one.hash == hashlib.sha256(b"data 12").hexdigest() and one["size"] == 7
    assert not any(p.is_dir() and not p.name.endswith(".outcomes") for p in (tmp_path / "_staging").iterdir())
    again, _ = runs.import_files(spark, str(many), tmp_path.as_uri())
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in good.collect()}  # a second run makes no second file
    assert len(os.listdir(tmp_path)) == len(docx) + 1


def test_a_killed_task_leaves_nothing_and_a_retry_no_second_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.docx").write_bytes(b"x" * (k + 1))
    out = tmp_path / "out"
    options = {"path": out.as_uri(), "job": "j", "named": "content"}
    rows = [{"row": str(k), "name": f"{k}.docx", "source": f"file://{tmp_path}/in/{k}.docx", "body": None} for k in range(3)]

    class Killed(BaseException):
        pass

    def dying():
        yield from rows[:2]
        raise Killed

    with pytest.raises(Killed):
        folder.FileWriter(options).write(dying())
    assert os.listdir(out) == ["_staging"]  # two copies were complete, none is in place
    first = folder.FileWriter(options).write(iter(rows))
    second = folder.FileWriter(options).write(iter(rows))  # the driver lost the first one's message
    folder.FileWriter(options).commit([second])
    assert first.outcomes != second.outcomes and folder.aside(out.as_uri()) == ["j.outcomes"]
    assert sorted(p.name for d in out.iterdir() if d.name != "_staging" for p in d.iterdir()) == ["0.docx", "1.docx", "2.docx"]
    assert spark.read.parquet(f"{out}/_staging/j.outcomes").count() == 3
    folder.FileWriter({**options, "job": "k"}).write(iter(rows))
    folder.FileWriter({**options, "job": "k"}).abort([])
    assert folder.aside(out.as_uri()) == ["j.outcomes"]


def test_one_file_failing_alone(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a/x.txt", "text"), ("2", "../out.txt", "no"), ("3", None, "no"), ("4", "b.txt", None)], "id string, name string, body string")
    out = {r.row: r for r in folder.write_files(rows, tmp_path.as_uri(), row="id", name="name", body="body").collect()}
    assert {k: r.error is None for k, r in out.items()} == {"1": True, "2": False, "3": False, "4": True}
    assert (tmp_path / "a" / "x.txt").read_text() == "text" and (tmp_path / "b.txt").read_bytes() == b"" and out["1"].bytes == 4
    gone = spark.createDataFrame([("1", "x", str(tmp_path / "no such file"))], "id string, name string, source string")
    assert "FileNotFound" in folder.write_files(gone, tmp_path.as_uri(), row="id", name="name", source="source").first().error


def test_stream_of_new_files(spark, tmp_path):
    place, top = tmp_path / "out", tmp_path / "in"
    top.mkdir()

    def run(want):
        stream = folder.listed_stream(spark, str(top), "*.docx", settle=0.2)
        query = stream.writeStream.format("parquet").option("path", str(place)).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()
        try:
            deadline, got = time.time() + 60, []
            while time.time() < deadline and got != want:
                time.sleep(0.5)
                got = sorted(r.name for r in spark.read.schema(folder.LISTED).parquet(str(place)).collect()) if place.exists() else []
            time.sleep(1)
        finally:
            query.stop()
        assert sorted(r.name for r in spark.read.schema(folder.LISTED).parquet(str(place)).collect()) == want

    (top / "sub").mkdir()
    (top / "a.docx").write_bytes(b"1")
    (top / "sub" / "b.docx").write_bytes(b"")
    (top / "c.txt").write_bytes(b"1")
    time.sleep(0.4)
    run(["a.docx", "b.docx"])
    (top / "d.docx").write_bytes(b"1")
    time.sleep(0.4)
    run(["a.docx", "b.docx", "d.docx"])  # after a restart each file once


def test_names_never_clash(spark):
    rows = [("f", f"12345678{k:04}", "x.md") for k in range(1000)] + [("f", "99999999", "12345678-x.md"), ("g", "1", "y"), ("g", "2", "Y"), ("g", "3", None)]
    out = catalog.unique_names(spark.createDataFrame(rows, "folder string, id string, name string"), folder="folder", name="name", order="id", id_col="id").collect()
    names = [(r.folder, r.file_name.lower()) for r in out if r.file_name is not None]
    assert len(out) == 1004 and len(set(names)) == 1003
    assert {r.file_name for r in out if r.folder == "g"} == {"y", "2-Y", None} and "x.md" in {r.file_name for r in out}
    assert {r.file_name for r in out if r.id == "123456780001"} == {"123456780001-x.md"}


def test_exports_of_equal_names(spark, tmp_path):
    docs = spark.createDataFrame([(f"12345678{k:03}", "x.docx") for k in range(40)], "doc_id string, name string")
    chunks = spark.createDataFrame([(f"12345678{k:03}", f"c{k}", 1, "parent", f"text {k}") for k in range(40)], "doc_id string, id string, seq int, kind string, text string")
    chunks = chunks.select("*", F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("type"), F.lit(1).alias("token_count"), F.lit(1).alias("char_count"), F.lit("").alias("heading_path"), F.array(F.lit(1)).alias("pages"), F.array(F.lit("n")).alias("node_ids"), F.lit("h").alias("hash"))
    out = runs.export(docs, chunks, None, [r.doc_id for r in docs.collect()], ["csv"], tmp_path.as_uri()).collect()
    assert len(out) == 40 and all(r.code is None for r in out) and len({r.file_name for r in out}) == 40
    written = {p.name: p.read_text("utf-8-sig") for p in tmp_path.iterdir() if p.suffix == ".csv"}
    assert len(written) == 40 and len(set(written.values())) == 40  # none was written over another
    assert office_writer.workbook("S", [["a"]])[:2] == b"PK"
