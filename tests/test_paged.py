"""Deep pages, keywords, exact medians and canonical JSON, on small tables against plain Python, with what is read."""

import json
import random
import statistics

from pyspark.sql import functions as F

from folioframe.functions import text as tx
from folioframe.plans import catalog, paged, stats


def scanned(df):
    """The partition filters of a plan's scans."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("],")[0] for part in text.split("PartitionFilters: [")[1:]]


def test_pages_at_any_depth(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, r.choice([None, 1, 2, 3]), "x") for k in range(1000)]
    table = spark.createDataFrame(rows, "id long, v int, total string")
    pages = paged.store_pages(table.drop("total"), str(tmp_path / "p"), [F.desc("v"), F.asc("id")], part_rows=90)
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    for number, size in ((1, 20), (3, 33), (50, 20), (51, 20), (5, 200), (7, 0), (0, 7)):
        page = pages.page(number, size)
        size_ = min(max(1, size), 200)
        first = (max(1, number) - 1) * size_
        assert [(x.id, x.v, x.total) for x in page.collect()] == [(i, v, 1000) for i, v, _ in want[first : first + size_]]
    deep = pages.page(49, 20)
    assert deep.count() == 20 and len({x.part for x in pages.counts.collect()}) == 12
    held = [x for x in pages.counts.collect() if x.before < 980 and x.before + x.n > 960]
    assert scanned(deep)[0].count(",") <= 1 + len(held) and f"{held[0].part}" in scanned(deep)[0]  # no other part is read
    empty = paged.store_pages(table.drop("total").limit(0), str(tmp_path / "e"), [F.asc("id")])
    assert empty.page(1).count() == 0 and empty.page(1).columns == ["id", "v", "total"]


def test_keywords_read_the_parts_that_can_hold_them(spark, tmp_path):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma%", "de_lta", "Äpfel", "x"]
    rows = [(k, None if r.random() < 0.1 else " ".join(r.choices(words, k=2)) + (" needle" if k == 777 else ""), r.choice(words)) for k in range(1000)]
    table = spark.createDataFrame(rows, "id long, a string, b string")
    keys = paged.store_keywords(table, str(tmp_path / "k"), ["a", "b"], [F.asc("id")], part_rows=50)
    for q in ("needle", "NEEDLE", "beta alpha", "al%ha", "a_pha", "äpfel", "x", "%", "__", "zzz", "ta ne", "eta%ga", "de_l"):
        got = sorted(x.id for x in keys.search(q).collect())
        assert got == sorted(x.id for x in table.where(catalog.contains(q, "a", "b")).collect()), q
    assert len(keys.parts("needle")) == 1 and keys.parts("zzz") == [] and keys.parts("x") is None and len(keys.parts("alpha")) == 20
    assert keys.search("needle").columns == ["id", "a", "b"]


def test_exact_medians(spark):
    r = random.Random(4)
    values = {"a": [r.gauss(0, 1e6) for _ in range(5001)], "b": [7.0] * 400 + [8.0] * 400, "c": [1.0], "d": [2.0, 3.0], None: [r.choice([-1e300, 0.0, 1e300]) for _ in range(77)], "e": [float(k // 50) for k in range(30_000)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("z", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: (x.n, x.median) for x in stats.exact_medians(table, "v", ["k"]).collect()}
    assert got == {k: (len(vs), statistics.median(vs)) for k, vs in values.items()}
    every = [v for vs in values.values() for v in vs]
    assert [tuple(x) for x in stats.exact_medians(table, "v").collect()] == [(len(every), statistics.median(every))]
    assert stats.exact_medians(table.limit(0), "v").count() == 0 and stats.exact_medians(table.limit(0), "v", ["k"]).count() == 0
    whole = {x.type: (x.samples, x.p50_ms) for x in stats.duration_stats(table, type_col="k", ms=F.col("v")).where("type IN ('b', 'd', 'e')").collect()}
    assert whole == {"b": (800, 8.0), "d": (2, 2.0), "e": (30_000, 300.0)}  # halves to even


def test_top_documents_sends_only_the_top(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("n"), "id").alias("name"))
    chunks = spark.range(5000).select((F.col("id") % 700).alias("doc_id"), F.lit(1).alias("token_count"))
    out = stats.top_documents(chunks, docs, k=3)
    assert [(x.doc_id, x.name, x.chunks) for x in out.orderBy("doc_id").collect()] == [(0, "n0", 8), (1, "n1", 8), (2, "n2", 8)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin" not in plan  # documents are neither sent nor shuffled


def test_canonical_json(spark):
    r = random.Random(5)

    def value(depth):
        kind = r.choice(["n", "s", "l", "d", "d"] if depth else ["n", "s"])
        return {"n": lambda: r.choice([None, True, 1, -2.5, 10**20]), "s": lambda: r.choice(["", "é", '"\\\n', "中"]), "l": lambda: [value(depth - 1) for _ in range(3)], "d": lambda: {r.choice("zyxé中a"): value(depth - 1) for _ in range(4)}}[kind]()

    def shuffled(v):
        if isinstance(v, dict):
            keys = list(v)
            r.shuffle(keys)
            return {k: shuffled(v[k]) for k in keys}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    values = [value(4) for _ in range(60)]
    rows = [(k, json.dumps(shuffled(v), indent=r.choice([None, 1]))) for k, v in enumerate(values)] + [(100, None), (101, "{no"), (102, ""), (103, '{"b":1,"a":2,"b":3}'), (104, "[" * 100_000)]
    got = {x.k: x.c for x in spark.createDataFrame(rows, "k long, t string").select("k", tx.canonical_json(F.col("t")).alias("c")).collect()}
    assert all(got[k] == json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for k, v in enumerate(values))
    assert got[100] is None and got[101] is None and got[102] is None and got[103] == '{"a":2,"b":3}' and got[104] is None


def test_sentences_keep_their_marks(spark):
    texts = ["One.\U0010fffe Two! \U0010fffdb three.\U0010fffda", "\U0010fffe", "a. \U0010fffe\U0010fffd b.", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.sentences(F.col("t")).alias("s")).collect()
    assert all("".join(x.s) == x.t for x in rows if x.t is not None) and rows[0].s == ["One.\U0010fffe Two! ", "\U0010fffdb three.\U0010fffda"]
