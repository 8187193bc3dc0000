"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary (all words of either corpus) and one smoothing: the background counts all
documents, the target the texts of a target corpus. The target's counts are scaled to the background's number of
tokens, so that the same constant k weighs alike in both. A document's score is its mean loss per token under the
target model minus that under the background model, so lower is more like the target. With

    p(w | u) = (c(u, w) + k) / (c(u) + k V)

a document's loss is a sum of terms of single bigrams and of single contexts, so each can be computed where that
n-gram's counts are, and no table of the corpus is sent anywhere whole. A document never scores itself: its own
counts are taken out of the background first.

1. a count-min sketch, of fixed size, over all n-grams; in the same pass the distinct words are counted exactly;
2. n-grams that the sketch can't rule out as hot are counted exactly; the hot ones, `MOST` at most by the threshold's
   definition, are broadcast;
3. all others go, packed, to buckets by hash; a bucket counts them for both models and returns each document's sum
   of terms; sums are added by block of documents.

N-grams are hashes of 40 bits and the bucket's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch as sk
from .hashing import mix64, runs, words
from .storage import bounded_batches, shuffle_width

U16, U32, U64 = np.uint16, np.uint32, np.uint64
#: Tokens and documents that a map task gathers before it deals them out.
FLUSH, BLOCK = 400_000, 30_000
#: An n-gram that occurs this often for each document is hot, but at least as often as leaves no more than MOST of them.
HOT, MOST = 1 / 50, 100_000
#: Buckets in which distinct words are counted, for each shuffle partition.
WORD_BUCKETS = 4
START = U64(0x5851F42D4C957F2D)
CONTEXT, BIGRAM, HOT_ROWS, DOCS = 0, 1, 2, 3


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, contexts and bigrams of all tokens, as hashes, and where each text's tokens begin."""
    h, starts = words(texts)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts[:-1][np.diff(starts) > 0]] = START
    context = mix64(before * U64(0xD6E8FEB86659FD93) + U64(CONTEXT))
    return h, context, mix64(before * U64(0xCA5A826395121157) + h * U64(0x8CB92BA72F3D8DD7)), starts


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]


def _surveyed(source: DataFrame, buckets: int) -> DataFrame:
    """One pass: rows (dest, cells, words, docs, background, target): summed segments of the sketch by negative dest,
    numbers of distinct words by other dest, and the corpora's sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(sk.CELLS, np.int64)
        sizes = np.zeros(3, np.int64)
        seen: list[np.ndarray] = []
        held = 0

        def words_so_far() -> pd.DataFrame:
            every = np.unique(np.concatenate(seen))
            dest = (every >> U64(32)).astype(np.int64) * buckets >> 32
            cut = np.searchsorted(dest, np.arange(buckets + 1))
            return pd.DataFrame([(d, every[cut[d] : cut[d + 1]].tobytes(), 0, 0, 0) for d in range(buckets) if cut[d + 1] > cut[d]], columns=["dest", "data", "docs", "background", "target"])

        for pdf in batches:
            texts, marked = _texts(pdf), pdf["marked"].to_numpy(bool)
            for a, b in runs(texts):
                h, context, bigram, starts = ngrams(texts[a:b])
                tokens = np.diff(starts)
                sizes += (b - a, tokens[~marked[a:b]].sum(), tokens[marked[a:b]].sum())
                sk.add(sketch, np.concatenate([context, bigram]))
                seen.append(np.unique(h))
                held += len(seen[-1])
                if held > 2_000_000:
                    seen = [np.unique(np.concatenate(seen))]
                    held = len(seen[0])
                    if held > 1_000_000:
                        yield words_so_far()
                        seen, held = [], 0
        if seen:
            yield words_so_far()
        yield pd.DataFrame([*((k, data, 0, 0, 0) for k, data in sk.parts(sketch)), (buckets, b"", *sizes.tolist())], columns=["dest", "data", "docs", "background", "target"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        dest = int(pdf["dest"].iloc[0])
        cells, words = b"", 0
        if dest < 0:
            cells = sk.summed(pdf["data"])
        elif dest < buckets:
            words = len(np.unique(np.concatenate([np.frombuffer(x, U64) for x in pdf["data"]])))
        return pd.DataFrame({"dest": [dest], "cells": [cells], "words": [words], "docs": [pdf["docs"].sum()], "background": [pdf["background"].sum()], "target": [pdf["target"].sum()]})

    rows = source.mapInPandas(run, "dest int, data binary, docs long, background long, target long")
    return rows.groupBy("dest").applyInPandas(unite, "dest int, cells binary, words long, docs long, background long, target long")


def _counted(source: DataFrame, sketch: np.ndarray, least: float) -> DataFrame:
    """(key, background, target): exact counts of the n-grams that occur `least` times or more."""
    shared = source.sparkSession.sparkContext.broadcast(sketch >= least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def so_far() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            sums = np.zeros((len(keys), 2), np.int64)
            np.add.at(sums, at, np.concatenate([c for _, c in held]))
            return keys, sums

        for pdf in batches:
            texts, marked = _texts(pdf), pdf["marked"].to_numpy(bool)
            for a, b in runs(texts):
                _, context, bigram, starts = ngrams(texts[a:b])
                mark = np.repeat(marked[a:b], np.diff(starts))
                for grams in (context, bigram):
                    maybe = sk.marked(shared.value, grams)
                    keys, at = np.unique(grams[maybe], return_inverse=True)
                    aims = np.bincount(at, mark[maybe], len(keys)).astype(np.int64)
                    held.append((keys, np.stack([np.bincount(at, minlength=len(keys)) - aims, aims], 1)))
                    n += len(keys)
                if n > 1_000_000:
                    held = [so_far()]
                    n = len(held[0][0])
                    if n > 500_000:
                        yield pd.DataFrame({"key": held[0][0].view(np.int64), "background": held[0][1][:, 0], "target": held[0][1][:, 1]})
                        held, n = [], 0
        if held:
            keys, sums = so_far()
            yield pd.DataFrame({"key": keys.view(np.int64), "background": sums[:, 0], "target": sums[:, 1]})

    rows = source.mapInPandas(run, "key long, background long, target long")
    return rows.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).where(F.col("background") + F.col("target") >= F.lit(least))


@dataclass
class Shared:
    """What every task holds: hot n-grams with their counts, by key, and the size of the vocabulary."""

    keys: np.ndarray
    background: np.ndarray
    target: np.ndarray
    vocabulary: int
    match: float  # background tokens by target tokens
    k: float

    def terms(self, kind: np.ndarray | int, background: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Loss differences that n-grams with these counts add: bigrams by k, contexts by k V, with opposite signs."""
        k = self.k * np.where(np.asarray(kind) == CONTEXT, self.vocabulary, 1.0)
        return np.where(np.asarray(kind) == CONTEXT, 1.0, -1.0) * (np.log(target * self.match + k) - np.log(background + k))


def survey(source: DataFrame, k: float, share: float) -> Shared:
    """Hot n-grams and the vocabulary's size, over all documents.

    What comes to the driver is bounded: a sketch of fixed size, a number for each bucket, and the hot n-grams. These
    occur, together, no more often than all n-grams, and each at least 1 / MOST of that; so there are MOST at most.
    """
    found = _surveyed(source, WORD_BUCKETS * shuffle_width(source.sparkSession)).toPandas()
    docs, tokens, aims = (int(found[c].sum()) for c in ("docs", "background", "target"))
    parts = found[found["dest"] < 0].sort_values("dest", ascending=False)
    sketch = np.frombuffer(b"".join(parts["cells"]), np.int64)
    hot = _counted(source, sketch, max(share * docs, 2 * (tokens + aims) / MOST, 1.0)).toPandas() if len(sketch) else pd.DataFrame({"key": [], "background": [], "target": []}, dtype=np.int64)
    keys = hot["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    return Shared(keys[order], hot["background"].to_numpy(np.int64)[order], hot["target"].to_numpy(np.int64)[order], max(1, int(found["words"].sum())), tokens / aims if aims else 1.0, k)


def _deal(source: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """One map: n-grams to buckets, hot ones and the documents themselves to a bucket of their block."""
    shared = source.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, part, block = shared.value, TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids: list[object] = []
        sizes: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal block, tokens
            name = part << 24 | block
            rows = []
            mark = np.concatenate(marks)
            owner = np.concatenate([x[0] for x in held]) if held else np.empty(0, np.int64)
            for kind, j in ((CONTEXT, 1), (BIGRAM, 2)):
                keys = np.concatenate([x[j] for x in held]) if held else np.empty(0, U64)
                at = np.searchsorted(hot, keys)
                common = at < len(hot)
                common[common] = hot[at[common]] == keys[common]
                if common.any():
                    cell, n = np.unique(at[common] << 16 | owner[common], return_counts=True)
                    rows.append((2 << bits, name, HOT_ROWS + 2 * kind, cell.astype(U64).tobytes(), n.astype(U32).tobytes(), b""))
                bucket = (keys[~common] >> U64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                who = (owner[~common] | mark[owner[~common]].astype(np.int64) << 15)[order]
                low, bucket = keys[~common][order] >> U64(24 - bits), bucket[order]  # 40 bits below the bucket's
                cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for b in range(1 << bits):
                    s, e = cut[b], cut[b + 1]
                    if e > s:
                        first = np.flatnonzero(np.concatenate([[True], who[s + 1 : e] != who[s : e - 1]]))
                        n = np.diff(np.concatenate([first, [e - s]]))
                        rows.append((kind << bits | b, name, kind, who[s:e][first].astype(U16).tobytes(), n.astype(U32).tobytes(), low[s:e].astype(U32).tobytes() + (low[s:e] >> U64(32)).astype(np.uint8).tobytes()))
            present = np.array([i is not None for i in ids])
            number = np.array([i if i is not None else 0 for i in ids], np.int64)
            rows.append((2 << bits, name, DOCS, number.tobytes(), np.concatenate(sizes).astype(U32).tobytes(), present.tobytes() + mark.tobytes()))
            held.clear(), ids.clear(), sizes.clear(), marks.clear()
            block, tokens = block + 1, 0
            out = pd.DataFrame(rows, columns=["dest", "block", "kind", "a", "b", "c"])
            spread = out["block"] // (1 << 24) + out["block"] % (1 << 24)  # a block's task and its turn there
            out["dest"] = np.where(out["dest"] == 2 << bits, (2 << bits) + spread % (1 << bits), out["dest"])
            return out

        for pdf in batches:
            texts, marked = _texts(pdf), pdf["marked"].to_numpy(bool)
            doc = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            for a, b in runs(texts):
                if ids and len(ids) + b - a > BLOCK:
                    yield flush()
                for a in range(a, b, BLOCK):
                    c = min(b, a + BLOCK)
                    if c - a == BLOCK and ids:
                        yield flush()
                    _, context, bigram, starts = ngrams(texts[a:c])
                    n = np.diff(starts)
                    held.append((np.repeat(np.arange(len(ids), len(ids) + c - a), n), context, bigram))
                    ids.extend(doc[a:c])
                    sizes.append(n)
                    marks.append(marked[a:c])
                    tokens += int(n.sum())
                    if tokens >= FLUSH:
                        yield flush()
        if ids:
            yield flush()

    return source.mapInPandas(run, "dest int, block long, kind int, a binary, b binary, c binary")


def _bucket(pdf: pd.DataFrame, shared: Shared) -> pd.DataFrame:
    """A bucket: each document's sum of terms over the n-grams counted here. Rows for blocks pass through."""
    kind = int(pdf["kind"].iloc[0])
    if kind >= HOT_ROWS:
        return pdf
    who = [np.frombuffer(x, U16) for x in pdf["a"]]
    n = [np.frombuffer(x, U32) for x in pdf["b"]]
    keys = np.concatenate([np.frombuffer(x, U32, len(x) // 5) for x in pdf["c"]]).astype(U64)
    keys |= np.concatenate([np.frombuffer(x, np.uint8, offset=len(x) // 5 * 4) for x in pdf["c"]]).astype(U64) << U64(32)
    base = np.concatenate([[0], np.cumsum([len(x) for x in who])])
    slot = np.repeat(np.arange(base[-1], dtype=U64), np.concatenate(n))
    target = np.concatenate(who) >> U16(15) > 0
    if base[-1] < 1 << 24:
        cells, own = np.unique(keys << U64(24) | slot, return_counts=True)
        at, key = (cells & U64(0xFFFFFF)).astype(np.int64), cells >> U64(24)
        del cells
    else:
        order = np.lexsort((slot, keys))
        keys, slot = keys[order], slot[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (slot[1:] != slot[:-1])]))
        own, at, key = np.diff(np.concatenate([new, [len(keys)]])), slot[new].astype(np.int64), keys[new]
    del keys, slot
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    own_target, own_document = own * target[at], own * ~target[at]
    total, hits = np.repeat(np.add.reduceat(own_document, first), size), np.repeat(np.add.reduceat(own_target, first), size)
    sums = np.bincount(at, own * shared.terms(kind, total - own_document, hits), minlength=base[-1])
    rows = [(int(d), int(b), kind, (w & U16(0x7FFF)).tobytes(), sums[base[i] : base[i + 1]].tobytes(), b"") for i, (d, b, w) in enumerate(zip(pdf["dest"], pdf["block"], who, strict=True))]
    return pd.DataFrame(rows, columns=["dest", "block", "kind", "a", "b", "c"])


def _block(pdf: pd.DataFrame, shared: Shared) -> pd.DataFrame:
    """A block of documents: add what the buckets returned and the terms of hot n-grams."""
    pdf = pdf.sort_values(["kind", "dest"], kind="stable")
    docs = pdf[pdf["kind"] == DOCS].iloc[0]
    ids, sizes = np.frombuffer(docs["a"], np.int64), np.frombuffer(docs["b"], U32).astype(np.int64)
    present, mark = np.frombuffer(docs["c"], bool).reshape(2, -1)
    total = np.zeros(len(ids))
    for kind, a, b in zip(pdf["kind"], pdf["a"], pdf["b"], strict=True):
        if kind in (CONTEXT, BIGRAM):
            np.add.at(total, np.frombuffer(a, U16), np.frombuffer(b, np.float64))
        elif kind != DOCS:
            cell, own = np.frombuffer(a, U64), np.frombuffer(b, U32).astype(np.int64)
            who, at = (cell & U64(0xFFFF)).astype(np.int64), (cell >> U64(16)).astype(np.int64)
            terms = shared.terms((kind - HOT_ROWS) // 2, shared.background[at] - own * ~mark[who], shared.target[at])
            total += np.bincount(who, own * terms, minlength=len(ids))
    out = pd.DataFrame({"doc_id": np.where(present, ids, 0), "n_tokens": sizes, "score": np.where(sizes > 0, total / np.maximum(sizes, 1), np.nan), "unnamed": ~present})
    return out[~mark]


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", k: float = 0.1, hot_share: float = HOT) -> DataFrame:
    """(doc_id, n_tokens, score), one row per row of `docs`; the target model counts the texts of `target`.

    Words are runs of non-white-space with A-Z as a-z. Null or blank text: n_tokens 0, score null. A null id stays
    null. Rows that share an id are documents of their own; a copy of a document counts for it. Equal texts have equal
    scores. Without target tokens the target model is uniform. An empty table gives no rows; other columns are ignored.
    """
    spark = bounded_batches(docs)
    bits = max(1, (shuffle_width(spark) - 1).bit_length() - 1)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.lit(False).alias("marked"))
    source = rows.union(target.select(F.lit(None).cast("long"), target[target_col], F.lit(True)))
    shared = survey(source, k, hot_share)
    schema = "dest int, block long, kind int, a binary, b binary, c binary"
    sums = _deal(source, shared.keys, bits).groupBy("dest").applyInPandas(lambda pdf: _bucket(pdf, shared), schema)
    out = sums.groupBy("block").applyInPandas(lambda pdf: _block(pdf, shared), "doc_id long, n_tokens long, score double, unnamed boolean")
    return out.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "n_tokens", F.when(~F.isnan("score"), F.col("score")).alias("score"))
