"""Embedding near-dedup with hierarchical navigable small-world graphs, one a shard.

Equal vectors are one vector with a count. Distinct vectors are dealt to shards, as many as their number calls for; a
graph is built over each and every vector queries every shard. Queries run in lockstep, a block at a time. When a
graph is built, its recall is audited: exact neighbours, itself apart, of vectors of its own and of a sample of all
shards; the beam is widened until all are found. A query's beam is widened further until its worst candidate lies
below the threshold; a query whose beam would outgrow `WIDEST` is compared with the whole shard instead. Links are
verified by cosine in double precision and united to components.

The work is vectors times shards, as every vector queries every shard; a shard's graph and vectors (some 400 bytes a
vector of 64 numbers) go to each part of `query_rows` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .storage import bounded_batches, durable, hot_join

F32 = np.float32
#: Neighbours of a node above the ground layer (twice as many there), beam while building, narrowest and widest beam of a query.
M, BUILD_BEAM, BEAM, WIDEST = 12, 64, 48, 256
#: Queries in lockstep; audited vectors that have a neighbour, most vectors drawn for that, and vectors of all shards.
BLOCK, AUDIT, DRAWN, FOREIGN = 512, 64, 8192, 256
#: Fewest shards, and vectors in one.
SHARDS, SHARD_ROWS = 8, 50_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    v = np.asarray(vectors, np.float64)
    big = np.abs(v).max(1, keepdims=True)
    v = v / np.where(big > 0, big, 1)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(vectors, F32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(np.int64), 8)
        self.links = [np.full((n, 2 * M if lv == 0 else M), -1, np.int32) for lv in range(int(self.level.max(initial=0)) + 1)]
        order = np.argsort(-self.level, kind="stable")  # higher nodes first: each layer's graph stands when lower nodes come
        self.entry = int(order[0]) if n else -1
        at = min(n, 1)
        while at < n:
            new = order[at : at + min(BLOCK, max(16, at))]
            self._insert(order[:at], new)
            at += len(new)

    def _insert(self, old: np.ndarray, new: np.ndarray) -> None:
        """Link a batch of nodes: to what search finds among the old, and among each other by direct comparison."""
        q = self.x[new]
        start = np.full(len(new), self.entry)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -2)
        for lv in range(len(self.links) - 1, -1, -1):
            here = np.flatnonzero(self.level[new] >= lv)
            width = BUILD_BEAM if len(here) else 1
            ids, sims = self._beam(q, start, lv, width)
            start = np.where(ids[:, 0] >= 0, ids[:, 0], start)
            if not len(here):
                continue
            k = min(len(here), M)
            near = np.argsort(-mutual[np.ix_(here, here)], 1, kind="stable")[:, :k]
            cand = np.concatenate([ids[here], new[here][near]], 1)
            sim = np.concatenate([sims[here], np.take_along_axis(mutual[np.ix_(here, here)], near, 1)], 1)
            cand[cand == new[here][:, None]] = -1
            room = self.links[lv].shape[1]
            self.links[lv][new[here], : room // 2] = chosen = self._diverse(cand, sim, room // 2)
            a, b = np.repeat(new[here], chosen.shape[1]), chosen.ravel()
            self._back(lv, b[b >= 0], a[b >= 0])

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, room: int) -> np.ndarray:
        """Of each row's candidates, those nearer to it than to any chosen before; then the nearest others."""
        sim = np.where(cand >= 0, sim, -2).astype(F32)
        order = np.argsort(-sim, 1, kind="stable")[:, : 3 * room]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        again = np.tril(cand[:, :, None] == cand[:, None, :], -1).any(2)
        cand, sim = np.where(again, -1, cand), np.where(again, -2, sim)
        v = self.x[np.maximum(cand, 0)]
        among = np.einsum("bcd,bed->bce", v, v)
        taken = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            covered = (taken & (among[:, c, :] > sim[:, c : c + 1])).any(1)
            taken[:, c] = ~covered & (cand[:, c] >= 0) & (taken.sum(1) < room)
        rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * cand.shape[1] + np.arange(cand.shape[1])
        best = np.argsort(rank, 1)[:, :room]
        out = np.take_along_axis(cand, best, 1)
        if out.shape[1] < room:
            out = np.concatenate([out, np.full((len(out), room - out.shape[1]), -1, out.dtype)], 1)
        return out

    def _back(self, lv: int, node: np.ndarray, add: np.ndarray) -> None:
        """Link back; a node with too many links keeps a diverse choice of them."""
        order = np.argsort(node, kind="stable")
        node, add = node[order], add[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
        if not len(first):
            return
        nodes, size = node[first], np.diff(np.concatenate([first, [len(node)]]))
        room = self.links[lv].shape[1]
        for s in range(0, len(nodes), BLOCK):
            part, n = nodes[s : s + BLOCK], size[s : s + BLOCK]
            more = np.full((len(part), int(n.max())), -1, np.int64)
            for k in range(len(part)):
                more[k, : n[k]] = add[first[s + k] : first[s + k] + n[k]]
            cand = np.concatenate([self.links[lv][part], more], 1)
            sim = np.einsum("bd,bcd->bc", self.x[part], self.x[np.maximum(cand, 0)])
            self.links[lv][part] = self._diverse(cand, sim, room)

    def _beam(self, q: np.ndarray, start: np.ndarray, lv: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `width` nodes of a layer for each query, best first, searched in lockstep; -1 where there are fewer."""
        b, links = len(q), self.links[lv]
        rows = np.arange(b)
        seen = np.zeros((b, len(self.x)), bool)
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -2, F32)
        done = np.ones((b, width), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("bd,bd->b", q, self.x[start]), False
        seen[rows, start] = True
        while True:
            live = np.flatnonzero(~done.all(1))
            if not len(live):
                return ids, sims
            col = np.argmax(np.where(done[live], -3, sims[live]), 1)
            done[live, col] = True
            new = links[ids[live, col]].astype(np.int64)
            ok = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(ok)
            seen[live[r], new[r, c]] = True
            s = np.full(new.shape, -2, F32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[new[r, c]])
            all_s = np.concatenate([sims[live], s], 1)
            top = np.argsort(-all_s, 1, kind="stable")[:, :width]
            all_i, all_d = np.concatenate([ids[live], np.where(ok, new, -1)], 1), np.concatenate([done[live], ~ok], 1)
            sims[live], ids[live], done[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_d, top, 1)

    def near(self, q: np.ndarray, at_least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For queries (a block at a time): numbers of the queries, and of the nodes that lie at `at_least` or above."""
        for s in range(0, len(q), BLOCK):
            todo = np.arange(s, min(s + BLOCK, len(q)))
            start = np.full(len(todo), self.entry)
            for lv in range(len(self.links) - 1, 0, -1):
                start = self._beam(q[todo], start, lv, 1)[0][:, 0]
            wide = width
            while len(todo):
                if wide > min(WIDEST, len(self.x)):
                    hit = np.argwhere(q[todo] @ self.x.T >= at_least)
                    yield todo[hit[:, 0]], hit[:, 1]
                    break
                ids, sims = self._beam(q[todo], start, 0, wide)
                full = (sims[:, -1] >= at_least) & (ids[:, -1] >= 0)
                r, c = np.nonzero((sims >= at_least) & (ids >= 0) & ~full[:, None])
                yield todo[r], ids[r, c]
                todo, start, wide = todo[full], start[full], 2 * wide

    def audit(self, others: np.ndarray, at_least: float) -> tuple[int, float]:
        """A beam that finds every exact neighbour of the audited vectors, and the recall of the narrowest beam.

        Audited are `others` and, drawn over the shard until AUDIT of them have a neighbour besides themselves or
        DRAWN are drawn, vectors of the shard itself. A beam above WIDEST means comparing with the whole shard.
        """
        asked, truth, n = [others], 0, len(self.x)
        if len(others):
            truth += int((others @ self.x.T >= at_least).sum())
        order, having = np.random.default_rng(2).permutation(n)[:DRAWN], 0
        for s in range(0, len(order), BLOCK):
            pick = order[s : s + BLOCK]
            near = (self.x[pick] @ self.x.T >= at_least).sum(1)
            some = near > 1
            asked.append(self.x[pick[some]])
            truth += int(near[some].sum())
            having += int(some.sum())
            if having >= AUDIT:
                break
        q = np.concatenate(asked)
        width, first = BEAM, -1
        while truth and width <= WIDEST:
            found = sum(len(node) for _, node in self.near(q, at_least, width))
            first = found if first < 0 else first
            if found >= truth:
                break
            width *= 2
        return width, 1.0 if not truth else min(1.0, first / truth)

    def pack(self) -> bytes:
        """The links; vectors travel as they came."""
        head = np.array([len(self.x), len(self.links), self.entry], np.int64)
        return b"".join([head.tobytes(), *[x.tobytes() for x in self.links]])

    @classmethod
    def unpack(cls, data: bytes, vectors: np.ndarray) -> Graph:
        n, layers, entry = np.frombuffer(data, np.int64, 3).tolist()
        g = cls.__new__(cls)
        g.x, g.entry, g.links, at = np.ascontiguousarray(vectors, F32), entry, [], 24
        for lv in range(layers):
            room = 2 * M if lv == 0 else M
            g.links.append(np.frombuffer(data, np.int32, n * room, at).reshape(n, room))
            at += 4 * n * room
        return g


GRAPH = "dim int, shard int, ids binary, copies binary, vectors binary, links binary, beam int, recall double"


def _build(pdf: pd.DataFrame, sample: list[list[float]], threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "no"])
    raw = np.stack(pdf["embedding"].to_numpy())
    graph = Graph(unit(raw))
    same_size = [v for v in sample if len(v) == raw.shape[1]]
    beam, recall = graph.audit(unit(np.array(same_size)).astype(F32) if same_size else np.empty((0, raw.shape[1]), F32), threshold - SLACK)
    as_bytes = [[pdf[c].to_numpy(np.int64).tobytes()] for c in ("no", "copies")]
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "ids": as_bytes[0], "copies": as_bytes[1], "vectors": [raw.tobytes()], "links": [graph.pack()], "beam": [beam], "recall": [recall]})


#: Single precision finds what lies above the threshold less this, double precision decides.
SLACK = 1e-4


def _query(queries: pd.DataFrame, shards: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One part of all vectors against one shard: counts of links, and a forest that spans the links found."""
    empty = pd.DataFrame({"no": np.empty(0, np.int64), "n": np.empty(0, np.int64), "src": np.empty(0, np.int64), "dst": np.empty(0, np.int64)})
    if not len(queries) or not len(shards):
        return empty
    row = shards.iloc[0]
    mine, asked = queries["no"].to_numpy(np.int64), np.stack(queries["embedding"].to_numpy())
    ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
    exact = unit(np.frombuffer(row["vectors"], asked.dtype).reshape(len(ids), -1))
    graph = Graph.unpack(row["links"], exact)
    counts, src, dst = np.zeros(len(mine), np.int64), [], []
    for s in range(0, len(mine), 32 * BLOCK):  # in double precision a piece at a time
        q = unit(asked[s : s + 32 * BLOCK])
        for a, b in graph.near(q.astype(F32), threshold - SLACK, int(row["beam"])):
            cos = np.einsum("nd,nd->n", q[a], exact[b])
            link = (cos >= threshold) & (mine[s + a] != ids[b])
            a, b = a[link] + s, b[link]
            np.add.at(counts, a, copies[b])
            if len(a):
                x, y = forest(mine[a], ids[b])
                src.append(x)
                dst.append(y)
    found = pd.DataFrame({"no": mine, "n": counts})[counts > 0]
    if src:
        x, y = forest(np.concatenate(src), np.concatenate(dst))
        found = pd.concat([found, pd.DataFrame({"src": x, "dst": y})])
    return pd.concat([empty, found]).astype({c: "Int64" for c in empty})


def near_duplicates(embeddings: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None, query_rows: int = 100_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `embeddings`.

    Vectors link at a cosine of `threshold` or more in double precision; n_links counts other rows linked directly,
    component_id is the least id reachable, kept says that it is the row's own. A vector that is null, empty or zero, or
    holds null or non-finite numbers, links with nothing; so do vectors of different lengths. Equal vectors link.
    Repeated rows count as rows; rows that share an id are rows of their own, linked by their vectors alone. A null id takes no part: n_links 0, component_id null, kept false. `shards` follows
    from the number of distinct vectors (SHARD_ROWS in each, SHARDS at least), so that a task's graph stays of one size.
    An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(embeddings)
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].alias("embedding")).withColumn("good", F.coalesce(good, F.lit(False)))
    distinct = durable(rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumns({"dim": F.size("embedding"), "no": F.monotonically_increasing_id()}), "vectors")
    number, total = distinct.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    shards = max(SHARDS, -(-number // SHARD_ROWS)) if shards is None else shards
    sample = [r.embedding for r in distinct.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "no").limit(FOREIGN).select("embedding").collect()]
    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = durable(sharded.groupBy("dim", "shard").applyInPandas(lambda pdf: _build(pdf, sample, threshold), GRAPH), "graphs")
    parts = max(1, -(-number // query_rows))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = distinct.select("no", "embedding", "dim", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts)).cast("int").alias("part"), each(shards, "shard"))
    held = graphs.select("dim", "shard", "ids", "copies", "vectors", "links", "beam", each(parts, "part"))
    found = asked.groupBy("dim", "shard", "part").cogroup(held.groupBy("dim", "shard", "part")).applyInPandas(lambda a, b: _query(a, b, threshold), "no long, n long, src long, dst long")
    found = durable(found, "found")
    united = components(found.where("src IS NOT NULL").select("src", "dst"))
    counts = found.where("no IS NOT NULL").groupBy("no").agg(F.sum("n").alias("n"))
    named = distinct.select("no", "vec_id", "copies").join(counts, "no", "left").join(united, F.col("no") == F.col("id"), "left")
    named = durable(named.select("no", "vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "no").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("members"))
    named = distinct.select("no", "embedding", "copies").join(hot_join(named, least, "root", "members", number).select("no", "n_links", "component_id"), "no")
    named = named.select("embedding", "copies", "n_links", "component_id")
    linked = hot_join(rows.where("good").select("vec_id", "embedding"), named, "embedding", "copies", total).select("vec_id", "n_links", "component_id")
    out = linked.union(rows.where("NOT good").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
