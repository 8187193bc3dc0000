"""Ranked lexical search over an inverted index in shards.

A shard holds some of one task's documents, `SHARD` terms or so, sorted by doc_id; its index is one row: documents'
ids and lengths, and for each term the compressed distances of its documents' numbers and its occurrences there. It is
written once and serves any search; statistics (documents, terms, documents by term) are sums over shards.

A search reads each shard once. An item's terms have cursors in the shard, a heap merges them by document number, a
second heap, bounded, holds the best documents by score, then doc_id. Terms whose greatest contributions together
stay below the worst of these have no cursor: they are looked up for the documents that the others give, as long as
the document can still get in. The best of all shards of a task, then of all tasks, are merged in two steps.

Items come in blocks of BLOCK; what a block's tasks share grows with its items' texts, not with the documents.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import runs, spans
from .packed import gaps, pack, pack_keys, rows_of, unpack, unpack_keys
from .storage import bounded_batches, durable, give_back, shuffle_width

U64 = np.uint64
#: Terms of a shard, items of a block.
SHARD, BLOCK = 1_000_000, 4096
#: Documents without an id are ranked after all others.
LAST = (1 << 63) - 1
INDEX = "documents long, terms long, n long, ids binary, present binary, lengths binary, keys binary, counts binary, postings binary, occurrences binary"


@lru_cache(maxsize=1)
def _between() -> np.ndarray:
    """Bytes that are no part of a term: ASCII but for letters and digits."""
    out = np.zeros(256, bool)
    out[:128] = [not chr(c).isalnum() for c in range(128)]
    return out


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, A-Z as a-z, and where each text's begin."""
    found = spans(texts, _between())
    return found.hashes(found.begin, found.end), found.starts


def _shard(ids: list[int | None], hashes: list[np.ndarray]) -> tuple:
    """The row of a shard: documents sorted by id, those without one at the end."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    lengths = np.array([len(hashes[i]) for i in order], np.int64)
    every = np.concatenate([hashes[i] for i in order]) if len(order) else np.empty(0, U64)
    keys, at = np.unique(every, return_inverse=True)
    cells, n = np.unique(at * len(order) + np.repeat(np.arange(len(order)), lengths), return_counts=True)
    term, doc = np.divmod(cells, max(1, len(order)))
    counts = np.bincount(term, minlength=len(keys))
    starts = np.cumsum(counts) - counts
    present = np.array([ids[i] is not None for i in order])
    number = np.array([ids[i] or 0 for i in order], np.int64)
    return (int((lengths > 0).sum()), int(lengths.sum()), len(order), number.tobytes(), present.tobytes(), pack(lengths), pack_keys(keys), pack(counts), pack(gaps(doc, starts)), pack(n))


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents (one row a shard), written to the shared folder."""
    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        hashes: list[np.ndarray] = []
        held = 0
        columns = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            texts = [t.encode() if t is not None else b"" for t in batch.column(1).to_pylist()]
            numbers = batch.column(0).to_pylist()
            for a, b in runs(texts):
                h, starts = terms(texts[a:b])
                ids.extend(numbers[a:b])
                hashes.extend(h[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True))
                held += len(h)
                if held >= SHARD:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame([_shard(ids, hashes)], columns=columns))
                    ids, hashes, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([_shard(ids, hashes)], columns=columns))
        give_back()

    return durable(docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).mapInArrow(run, INDEX), "index")


@dataclass
class Shared:
    """What every task holds for a block of items."""

    keys: np.ndarray  # all terms of the block, ascending
    weights: list[int]
    items: list[list[tuple[int, int]]]  # for each item its terms' numbers and how often it has them
    documents: int
    terms: int
    best: int


class Shard:
    """One shard's lists of the terms that a block asks for."""

    def __init__(self, row: dict, shared: Shared):
        n = row["n"]
        self.ids = np.where(np.frombuffer(row["present"], bool), np.frombuffer(row["ids"], np.int64), LAST).tolist()
        lengths = unpack(row["lengths"], n)
        ratio = 75 * shared.documents
        if n and ratio * int(lengths.max()) >= 1 << 63:
            m = np.array([25 + ratio * int(x) // shared.terms for x in lengths.tolist()], np.int64)
        else:
            m = 25 + ratio * lengths // max(1, shared.terms)
        keys = unpack_keys(row["keys"])
        counts = unpack(row["counts"], len(keys))
        starts = np.cumsum(counts) - counts
        postings, often = unpack(row["postings"], int(counts.sum())), unpack(row["occurrences"], int(counts.sum()))
        at = np.minimum(np.searchsorted(keys, shared.keys), max(0, len(keys) - 1))
        self.lists: dict[int, tuple[list[int], list[int], int]] = {}
        for term in np.flatnonzero(keys[at] == shared.keys).tolist() if len(keys) else ():
            s, e = starts[at[term]], starts[at[term]] + counts[at[term]]
            docs, tf = np.cumsum(postings[s:e]), often[s:e]
            part = shared.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
            self.lists[term] = (docs.tolist(), part.tolist(), int(part.max()))

    def search(self, item: list[tuple[int, int]], best: list[tuple[int, int]], k: int) -> None:
        """Merge the item's lists by document and put the documents that are good enough into `best`, a heap of
        (score, ~doc_id) with the worst at its top."""
        own = sorted((self.lists[t][2] * q, t, q) for t, q in item if t in self.lists and self.lists[t][2] > 0)
        if not own:
            return
        docs, parts, times = [self.lists[t][0] for _, t, _ in own], [self.lists[t][1] for _, t, _ in own], [q for _, _, q in own]
        most = [0]  # what the lists before the j-th give together at most
        for top, _, _ in own:
            most.append(most[-1] + top)
        worst = best[0][0] if len(best) == k else 0
        first = 0  # lists before it can't, without others, give a document that gets in
        while first < len(own) and most[first + 1] < worst:
            first += 1
        heap = [(docs[j][0], j) for j in range(first, len(own))]
        heapq.heapify(heap)
        place = [0] * len(own)
        ids = self.ids
        while heap:
            doc = heap[0][0]
            score = 0
            while heap and heap[0][0] == doc:
                j = heap[0][1]
                p = place[j]
                score += parts[j][p] * times[j]
                place[j] = p = p + 1
                if j >= first and p < len(docs[j]):
                    heapq.heapreplace(heap, (docs[j][p], j))
                else:
                    heapq.heappop(heap)
            for j in range(first - 1, -1, -1):
                if score + most[j + 1] < worst:
                    break
                p = bisect_left(docs[j], doc, place[j])
                place[j] = p
                if p < len(docs[j]) and docs[j][p] == doc:
                    score += parts[j][p] * times[j]
            else:
                if score > 0:
                    entry = (score, ~ids[doc])
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k and best[0][0] > worst:
                        worst = best[0][0]
                        while first < len(own) and most[first + 1] < worst:
                            first += 1
                        if heap and any(j < first for _, j in heap):
                            heap = [x for x in heap if x[1] >= first]
                            heapq.heapify(heap)


def _frequencies(index: DataFrame, keys: np.ndarray) -> np.ndarray:
    """In how many documents each of the terms is, over all shards."""
    shared = index.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for packed_keys, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = unpack_keys(packed_keys)
                if len(found):
                    at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
                    total += np.where(found[at] == wanted, unpack(packed, len(found))[at], 0)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], names=["term", "n"])

    rows = index.select("keys", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row a term of the items
    out = np.zeros(len(keys), np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _block(index: DataFrame, items: list[tuple[int, str | None]], size: tuple[int, int], best: int, item_type: str) -> DataFrame:
    """(item, doc_id, score) of the best documents of each of some items, by task and then by a part of the tasks."""
    found, starts = terms([(t or "").encode() for _, t in items])
    keys = np.unique(found)
    number = np.searchsorted(keys, found).tolist()
    frequency = _frequencies(index, keys).tolist()
    weights = [math.floor(1000 * math.log((2 * size[0] + 2) / (2 * n + 1))) for n in frequency]
    asked = [sorted(Counter(number[s:e]).items()) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(Shared(keys, weights, asked, *size, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = sent.value
        found: list[list[tuple[int, int]]] = [[] for _ in shared.items]
        for batch in batches:
            for row in rows_of(batch):
                shard = Shard(row, shared)
                for item, heap in zip(shared.items, found, strict=True):
                    shard.search(item, heap, shared.best)
        rows = [(i, ~o, s) for i, heap in enumerate(found) for s, o in heap]
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])
        give_back()

    each = index.select("n", "ids", "present", "lengths", "keys", "counts", "postings", "occurrences").mapInArrow(run, "item int, doc_id long, score long")
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"item int, name {item_type}")
    return each.join(F.broadcast(names), "item").select("item", "name", "doc_id", "score")  # BLOCK rows at most


def search(index: DataFrame, items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", best: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `best` documents with a score above 0, highest first, equal ones by doc_id.

    Items without terms, null ones too, find nothing; items that share an id are searched together as rows of their own
    and ranked each; a null id stays null. Documents without an id come after all others of their score, as nulls;
    repeated documents are ranked each. An empty index finds nothing.
    """
    spark = index.sparkSession
    n, size = items.count(), index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(items[id_col].alias("i"), items[text_col].alias("t"))
    blocks = -(-n // BLOCK)
    rows = rows if blocks <= 1 else durable(rows.withColumn("b", F.floor(F.rand(11) * blocks)), "items")  # about BLOCK each
    found = []
    for b in range(blocks):
        own = [(r["i"], r["t"]) for r in (rows.where(F.col("b") == b) if blocks > 1 else rows).collect()]
        if own:
            found.append(_block(index, own, tuple(size), best, kind).withColumn("block", F.lit(b)))
    if not found:
        return spark.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    order = [F.desc("score"), F.asc("doc_id")]  # LAST, for no id, comes last
    key = ["block", "item"]
    salted = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(min(64, shuffle_width(spark)))))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy(*key, "part").orderBy(*order))).where(F.col("rank") <= best)
    last = some.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= best)
    return last.select(F.col("name").alias(id_col), "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")
