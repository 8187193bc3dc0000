"""Connected components of a distributed edge table: large-star and small-star steps.

No step gathers a node's neighbours in one task: minima are aggregated with partial sums and joined back, those of
nodes with very many edges by broadcast (`hot_join`). Each round is written to the shared folder. Every task first
replaces its own edges by a spanning forest of them. Up to `LOCAL` edges, some 16 MB, are united in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, hot_join, release


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that span the given edges' components."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)].copy(), at[len(src) :].copy()
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of all the edges of a task, kept small by contracting as batches come."""
    src = dst = np.empty(0, np.int64)
    for pdf in batches:
        src, dst = forest(np.concatenate([src, pdf["src"].to_numpy(np.int64)]), np.concatenate([dst, pdf["dst"].to_numpy(np.int64)]))
    if len(src):
        yield pd.DataFrame({"src": src, "dst": dst})


#: Edges that one task unites.
LOCAL = 1 << 20


def components(edges: DataFrame, contracted: bool = False, max_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(id, component) for every node of `edges` (src, dst: long); component is the least id reachable.

    contracted: each task's edges are a forest already, so no further Python worker is needed for that. Nulls and loops are ignored. An empty table gives an empty result.
    """
    base = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    now = durable((base if contracted else base.mapInPandas(_local, "src long, dst long")).distinct(), "edges")
    total, before = now.count(), None
    if total <= local:
        found = durable(now.repartition(1).mapInPandas(_local, "src long, dst long"), "components")
        release(now)
        return found.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(found.select("dst", "dst").distinct())
    for _ in range(max_rounds):
        both = now.union(now.select("dst", "src").toDF("src", "dst"))
        least = both.groupBy("src").agg(F.least(F.first("src"), F.min("dst")).alias("low"), F.count("*").alias("n"))
        large = hot_join(both.where("dst > src"), least, "src", "n", 2 * total).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        down = durable(down, "down") if total > 10_000 else down
        low = down.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n"))
        small = hot_join(down, low, "src", "n", 2 * total)
        step = small.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(small.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()
        after = durable(step, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        release(now, down)
        now, total = after, state[0]
        if state == before:
            return now.select(F.col("src").alias("id"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
