"""Trees in reading order against a loop, on random forests with orphans, circles and one very deep and one very wide tree."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import tour, tree

NODES = "doc string, id long, parent long, turn long"


def forest(seed, doc, n):
    r = random.Random(seed)
    turns = r.sample(range(10 * n), n)
    out = []
    for k in range(n):
        up = None if k == 0 or r.random() < 0.1 else r.randrange(k)
        out.append((doc, k, 10**6 + k % 3 if r.random() < 0.05 else up, turns[k]))
    if n > 8:
        out[5], out[6], out[7] = (doc, 5, 6, turns[5]), (doc, 6, 5, turns[6]), (doc, 7, 7, turns[7])  # circles
    return out


def walked(rows):
    """(doc, id): (pre, post, depth, last), by a stack."""
    got = {}
    for doc in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: r[3])
        below = {}
        for _, i, up, _ in own:
            below.setdefault(up, []).append(i)
        pre = post = 0
        place, stack = {}, [(i, 0, False) for i in reversed(below.get(None, []))]
        while stack:
            i, depth, leaving = stack.pop()
            if leaving:
                got[doc, i] = (place[i], post, depth, pre - 1)
                post += 1
                continue
            place[i] = pre
            pre += 1
            stack.append((i, depth, True))
            stack += [(c, depth + 1, False) for c in reversed(below.get(i, []))]
        for _, i, _, _ in own:
            if i not in place:
                got[doc, i] = (pre, None, None, pre)
                pre += 1
    return got


@pytest.fixture(scope="module")
def rows():
    deep = [("deep", k, k - 1 if k else None, k) for k in range(300)]
    wide = [("wide", k, 0 if k else None, (k * 11) % 307) for k in range(300)]
    return forest(1, "a", 60) + forest(2, "b", 9) + forest(3, None, 20) + [("one", 1, None, 1), ("orphan", 1, 2, 1)] + deep + wide


def test_reading_order(spark, rows):
    table = spark.createDataFrame(rows, NODES).repartition(3)
    out = tour.toured(table, doc="doc", id_col="id", parent="parent", order="turn")
    assert {(r.doc, r.id): (r.pre, r.post, r.depth, r.last) for r in out.collect()} == walked(rows)
    assert tour.toured(table.limit(0), doc="doc", id_col="id", parent="parent", order="turn").count() == 0


def test_owners_and_subtrees(spark, rows):
    table = spark.createDataFrame(rows, NODES)
    toured = tour.toured(table, doc="doc", id_col="id", parent="parent", order="turn").persist()
    places = walked(rows)
    around = {}
    for (doc, i), (pre, _, _, _) in places.items():
        around[doc, i] = sorted((p, j) for (d, j), (p, _, _, last) in places.items() if d == doc and p <= pre <= last)
    got = {(r.doc, r.id): r.owner for r in tour.owners(toured, F.col("id") % 3 == 0, doc="doc", id_col="id").collect()}
    assert got == {k: ([j for _, j in v if j % 3 == 0] or [None])[-1] for k, v in around.items()}
    left = {(r.doc, r.id) for r in tour.without_subtrees(toured, F.col("id") % 7 == 3, doc="doc").collect()}
    assert left == {k for k, v in around.items() if not any(j % 7 == 3 for _, j in v)}
    assert tour.owners(toured, F.lit(False), doc="doc", id_col="id").where("owner IS NOT NULL").count() == 0
    toured.unpersist()


def test_headings_of_any_level(spark):
    r = random.Random(4)
    rows = [(d, k, r.choice([None, *levels])) for d, levels in ((1, range(1, 7)), (2, range(-3, 4000, 7)), (3, [16, 1, 15])) for k in range(120)]

    def parent(doc, at, level):
        above = [k for d, k, lv in rows if d == doc and k < at and lv is not None and level is not None and lv < level]
        return max(above, default=None)

    heads = spark.createDataFrame(rows, "doc long, at long, level int")
    got = {(x.doc, x.at): x.parent for x in tree.heading_parents(heads, key="doc", order="at", level="level").collect()}
    assert got == {(d, k): parent(d, k, lv) for d, k, lv in rows}
