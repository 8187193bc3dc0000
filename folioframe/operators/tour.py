"""Trees of any size in reading order: an Euler tour, ranked by pointer jumping; subtrees as intervals of places.

A tour enters and leaves each node. Its elements know the one before: entering follows the leaving of the sibling
before, or the entering of the parent; leaving follows the leaving of the last child, or the entering of the node
itself. Pointers double their reach with each join, so an element knows its place after log2 of the tour's length
rounds, whatever the tree's form; joins are on numbers that no two elements share, so no task gets more than others.
Each round is written to the shared folder.

In that order a node's subtree is the interval [pre, last]. Owners and subtrees are then joins of places with intervals.
An interval is dealt to the blocks of its own size that it touches, two at most, and a place to one block of each
size that there is, so that the join is on equal blocks; no document's nodes meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written


def _numbered(nodes: DataFrame, doc: str, id_col: str, parent: str, order: str) -> DataFrame:
    """(no, doc, id, up, ord) with a number of its own for each row, written once."""
    rows = nodes.select(F.col(doc).alias("doc"), F.col(id_col).alias("id"), F.col(parent).alias("up"), F.col(order).alias("ord"))
    return written(rows.withColumn("no", F.monotonically_increasing_id()), "nodes")


def _elements(rows: DataFrame) -> DataFrame:
    """(e, before, top): elements of the tours, 2 no for entering and 2 no + 1 for leaving, with the element before; top
    marks the entering of a document's first root.

    Siblings are sorted over all partitions by document, parent and order; a part's first row looks at the last row of
    the parts before, so that one node may have very many children.
    """
    from ..plans.catalog import in_parts

    keys = [F.col("doc"), F.col("up"), F.col("ord"), F.col("no")]
    parts = in_parts(rows, keys)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    within = W.partitionBy("part").orderBy(*keys)
    ends = parts.groupBy(F.col("part").alias("p")).agg(F.max_by(F.struct(F.col("doc").alias("end_doc"), F.col("up").alias("end_up"), F.col("no").alias("end_no")), F.struct("doc", "up", "ord", "no")).alias("e"))
    ends = ends.select(F.lead("p").over(W.orderBy("p")).alias("next"), "e.*").where("next IS NOT NULL")  # a row a part
    seen = parts.select("*", F.lag("no").over(within).alias("last_no"), F.lag("doc").over(within).alias("last_doc"), F.lag("up").over(within).alias("last_up"))
    seen = seen.join(F.broadcast(ends), F.col("part") == F.col("next"), "left")  # as many rows as parts
    here = F.when(same("last_doc", "doc") & same("last_up", "up"), F.col("last_no"))
    there = F.when(same("end_doc", "doc") & same("end_up", "up"), F.col("end_no"))
    sibling = F.when(F.col("last_no").isNotNull(), here).otherwise(there)
    placed = seen.select("no", "doc", "id", "up", "ord", sibling.alias("sibling"))
    known = rows.select(F.col("doc").alias("of"), F.col("id").alias("is"), F.col("no").alias("up_no"))
    around = placed.join(known, F.col("doc").eqNullSafe(F.col("of")) & (F.col("up") == F.col("is")), "left")
    entering = around.select((2 * F.col("no")).alias("e"), F.coalesce(2 * F.col("sibling") + 1, 2 * F.col("up_no")).alias("before"), (F.col("up").isNull() & F.col("sibling").isNull()).alias("top"))
    lasts = around.where("up_no IS NOT NULL").groupBy(F.col("up_no").alias("of_no")).agg(F.max_by("no", F.struct("ord", "no")).alias("last"))
    leaving = rows.select("no").join(lasts, F.col("no") == F.col("of_no"), "left").select((2 * F.col("no") + 1).alias("e"), F.coalesce(2 * F.col("last") + 1, 2 * F.col("no")).alias("before"), F.lit(False).alias("top"))
    return entering.union(leaving)


def toured(nodes: DataFrame, *, doc: str, id_col: str, parent: str, order: str) -> DataFrame:
    """(doc, id, pre, post, depth, last): each node's place in reading order from 0, its place by leaving, its depth and
    the last place of its subtree.

    Roots (null parent) come in order with all below them, children in order. Nodes that no root reaches, as their parent
    is missing or they are in or below a circle, follow in order; they have no post or depth, and are alone in their
    interval. Equal orders go by an arbitrary, fixed number. Ids must be unique in a document and not null; one document
    may be of any size and form. An empty table gives no rows.
    """
    rows = _numbered(nodes, doc, id_col, parent, order)
    first = _elements(rows)
    now = written(first.select("e", F.col("e").alias("at"), "before", "top", (1 - F.col("e") % 2).alias("entered"), (F.col("e") % 2).alias("left")), "tour")
    rounds, most = 0, 2 * rows.count()
    while (1 << rounds) < 2 * most and not now.where("before IS NOT NULL").isEmpty():
        far = now.select(F.col("e").alias("f"), F.col("at").alias("f_at"), F.col("before").alias("f_before"), F.col("top").alias("f_top"), F.col("entered").alias("f_entered"), F.col("left").alias("f_left"))
        open_ = now.where("before IS NOT NULL").join(far, F.col("before") == F.col("f"))
        moved = open_.select("e", F.col("f_at").alias("at"), F.col("f_before").alias("before"), F.col("f_top").alias("top"), (F.col("entered") + F.col("f_entered")).alias("entered"), (F.col("left") + F.col("f_left")).alias("left"))
        now = written(now.where("before IS NULL").union(moved), "tour")
        rounds += 1
    reached = F.col("before").isNull() & F.col("top")
    entry, exit_ = reached & (F.col("e") % 2 == 0), reached & (F.col("e") % 2 == 1)
    found = now.select(F.shiftright("e", 1).alias("no"), entry.alias("entry"), exit_.alias("exit"), "entered", "left").groupBy("no").agg(
        F.max(F.when(F.col("entry"), F.col("entered") - 1)).alias("pre"), F.max(F.when(F.col("entry"), F.col("entered") - F.col("left") - 1)).alias("depth"),
        F.max(F.when(F.col("exit"), F.col("left") - 1)).alias("post"), F.max(F.when(F.col("exit"), F.col("entered") - 1)).alias("last"),
    )
    both = written(rows.join(found, "no"), "places")
    good = both.where("pre IS NOT NULL")
    counts = good.groupBy(F.col("doc").alias("in_doc")).agg(F.count("*").alias("n"))
    loose = both.where("pre IS NULL").withColumn("turn", F.row_number().over(W.partitionBy("doc").orderBy("ord", "no")) - 1)
    loose = loose.join(counts, F.col("doc").eqNullSafe(F.col("in_doc")), "left").withColumn("place", F.coalesce("n", F.lit(0)) + F.col("turn"))
    names = [F.col("doc").alias(doc), F.col("id").alias(id_col)]
    none = F.lit(None).cast("long")
    return good.select(*names, "pre", "post", "depth", "last").union(loose.select(*names, F.col("place").alias("pre"), none, none, F.col("place")))


def _dealt(places: DataFrame, intervals: DataFrame, doc: str) -> DataFrame:
    """Pairs of a place (doc, pre, and what else places has) and an interval around it (low, high, and more)."""
    size = F.floor(F.log2((F.col("high") - F.col("low") + 1).cast("double"))).cast("int")
    held = intervals.withColumn("level", size)
    held = held.withColumn("block", F.explode(F.sequence(F.expr("shiftright(low, level)"), F.expr("shiftright(high, level)"))))
    levels = intervals.agg(F.collect_set(size).alias("levels"))  # one row of 63 numbers at most
    dealt = places.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).withColumn("block", F.expr("shiftright(pre, level)")).drop("levels")
    held = held.withColumnRenamed(doc, "of_doc").withColumnRenamed("level", "of_level").withColumnRenamed("block", "of_block")
    on = F.col(doc).eqNullSafe(F.col("of_doc")) & (F.col("level") == F.col("of_level")) & (F.col("block") == F.col("of_block"))
    return dealt.join(held, on).where((F.col("low") <= F.col("pre")) & (F.col("pre") <= F.col("high"))).drop("of_doc", "of_level", "of_block", "level", "block")


def owners(tour: DataFrame, holds: Column, *, doc: str, id_col: str) -> DataFrame:
    """The rows of `toured` with `owner`: the id of the deepest node around each, itself included, for which `holds`; null for none."""
    marked = tour.where(holds).select(doc, F.col("pre").alias("low"), F.col("last").alias("high"), F.col(id_col).alias("held_by"))
    best = _dealt(tour.select(doc, "pre"), marked, doc).groupBy(F.col(doc).alias("d"), F.col("pre").alias("p")).agg(F.max_by("held_by", "low").alias("owner"))
    return tour.join(best, F.col(doc).eqNullSafe(F.col("d")) & (F.col("pre") == F.col("p")), "left").drop("d", "p")


def without_subtrees(tour: DataFrame, gone: Column, *, doc: str) -> DataFrame:
    """The rows of `toured` that are neither one of the nodes `gone` nor below one."""
    marked = tour.where(gone).select(doc, F.col("pre").alias("low"), F.col("last").alias("high"))
    hit = _dealt(tour.select(doc, "pre"), marked, doc).select(F.col(doc).alias("d"), F.col("pre").alias("p")).distinct()
    return tour.join(hit, F.col(doc).eqNullSafe(F.col("d")) & (F.col("pre") == F.col("p")), "left_anti")
