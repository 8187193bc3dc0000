"""Stored tables by key: only touched parts are written, whatever the change."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from folioframe.plans import keyed


def files(path):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in Path(path).glob("part=*/part-*.parquet")}


def test_changes_write_only_their_parts(spark, tmp_path):
    r = random.Random(1)
    base = {k: (k, f"v{k}", r.random()) for k in range(300)}
    schema = "id long, v string, x double"
    table = keyed.store_keyed(spark.createDataFrame(list(base.values()), schema), str(tmp_path / "t"), ["id"], parts=16)
    state = dict(base)

    def same():
        return {r.id: tuple(r) for r in table.rows().collect()} == state

    assert same() and len(files(table.path)) == 16 and [tuple(x) for x in table.find(id=7).collect()] == [base[7]] and table.find(id=-1).count() == 0
    before = files(table.path)
    changes = [(5, "old", 1.0, 1), (5, "new", 2.0, 2), (1000, "added", None, 1)]
    touched = table.upsert(spark.createDataFrame(changes, schema + ", n int"), [F.col("n")])
    state |= {5: (5, "new", 2.0), 1000: (1000, "added", None)}
    after = files(table.path)
    assert same() and 1 <= len(touched) <= 2 and {p for p in after if after[p] != before.get(p)} == {f"part={k}" for k in touched}
    before = after
    touched = table.patch(spark.createDataFrame([(9, None, 7.0), (-5, "no such row", 1.0)], schema))
    state[9] = (9, "v9", 7.0)
    assert same() and len(touched) <= 2 and sum(files(table.path)[p] != before[p] for p in before) == len(touched)
    gone = [k for k in state if k % 3 == 0]
    table.delete(spark.createDataFrame([(k,) for k in gone], "id long"))
    state = {k: v for k, v in state.items() if k % 3}
    assert same()
    assert table.upsert(spark.createDataFrame([], schema)) == [] and table.delete(spark.createDataFrame([], "id long")) == []


def test_an_emptied_part(spark, tmp_path):
    table = keyed.store_keyed(spark.createDataFrame([(1, "a", None), (None, "b", "k")], "id long, v string, part_ string"), str(tmp_path / "t"), ["id"], parts=8)
    assert table.find(id=None).first().v == "b"
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert [r.v for r in table.rows().collect()] == ["b"] and table.find(id=1).count() == 0
    table.upsert(spark.createDataFrame([(1, "c", None)], "id long, v string, part_ string"))
    assert sorted(r.v for r in table.rows().collect()) == ["b", "c"]
