"""Language identification by the nearest of several centroids of each language.

A text is lower-cased; runs of what is not a letter count as one space; its n-grams of 1 to 3 code points, those of
spaces alone left out, are hashed to 2^BITS features. Its vector holds (1 + ln tf) * idf, with length 1. Documents'
frequencies are counted over all training documents, of which no task holds more than one batch. Of each language
`shown` documents at most, drawn by hash, are clustered (spherical k-means, deterministic), each language in a task of
its own; the centroids, `clusters` a language, are the model, whose size is languages * clusters * 2^BITS numbers.

The nearest centroid's language is the answer and its cosine the score. `rejected` says that the text is farther from
it than training texts of that language, and of the like length, almost ever were from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import runs
from .storage import bounded_batches, durable, give_back, release, unused

U32 = np.uint32
BITS, ORDERS = 13, 3
#: Documents of a language that are clustered, centroids of a language, rounds, and languages at most.
SHOWN, CLUSTERS, ROUNDS, MOST_LANGUAGES = 2000, 4, 8, 500
#: Texts whose counts are held at a time, and features whose frequencies are summed together.
TOGETHER, SEGMENT = 128, 256
#: Of training texts of a language and length class, so many in a thousand are farther away than its limit.
FAR = 5
CLASSES = 40
_FACTORS = (U32(0x9E3779B1), U32(0x85EBCA6B), U32(0xC2B2AE35))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of whole texts (a row each), and whether a text has a letter."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), U32) for t in texts]
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    every = np.concatenate(codes) if codes else np.empty(0, U32)
    letter = _letters()[every]
    found = np.zeros(len(texts), bool)
    found[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a letter
    keep[1:] |= owner[1:] != owner[:-1]
    keep[:1] = True  # and one at the beginning
    every, owner, letter = np.where(letter, every, U32(32))[keep], owner[keep], letter[keep]
    out = np.zeros(len(texts) << bits, np.int64)
    mixed = np.zeros(len(every), U32)
    some = np.zeros(len(every), bool)
    for n in range(ORDERS):
        size = len(every) - n
        if size <= 0:
            break
        mixed, some = (mixed[:size] ^ every[n:] * _FACTORS[n]) * U32(0x27D4EB2F) + U32(n + 1), some[:size] | letter[n:]
        whole = some & (owner[:size] == owner[n:])
        spread = (mixed ^ mixed >> U32(15)) * U32(0x2C1B3C6D)
        out += np.bincount((owner[:size] << bits | (spread >> U32(32 - bits)).astype(np.int64))[whole], minlength=len(out))
    return out.reshape(len(texts), 1 << bits), found


def _counted(texts: list[str | None], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, counts, lettered) for slices of the texts that are small together."""
    plain = [t if isinstance(t, str) else "" for t in texts]
    for a, b in runs([t.encode("utf-8", "surrogatepass") for t in plain]):
        for s in range(a, b, TOGETHER):
            yield s, *counts(plain[s : min(b, s + TOGETHER)], bits)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised vectors of counts; a text without n-grams has a null vector."""
    out = np.zeros(tf.shape, np.float32)
    at = tf > 0
    out[at] = 1 + np.log(tf[at].astype(np.float32))
    out *= idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def length_class(tf: np.ndarray) -> np.ndarray:
    """Texts by the power of two of their number of n-grams."""
    return np.minimum(np.log2(tf.sum(1) + 1).astype(np.int64), CLASSES - 1)


@dataclass
class Model:
    """Centroids (rows of length 1) with the number of their language, and the least cosines by language and length."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray
    bits: int = BITS
    documents: int = field(default=0)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's nearest language, its cosine, and whether it is too far from it; equal cosines: the first language."""
        if not len(self.centroids):
            return np.full(len(tf), -1), np.zeros(len(tf)), np.ones(len(tf), bool)
        cosine = vectors(tf, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        who, score = self.owner[best], np.clip(cosine[np.arange(len(tf)), best].astype(np.float64), 0, 1)
        return who, score, score < self.limits[who, length_class(tf)]


def clustered(x: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1 by spherical k-means; it begins at the vector nearest to all, then at the farthest from those chosen."""
    middle = x.sum(0)
    chosen = [int((x @ middle).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(clusters, len(x)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-6:
            break
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    centers = x[chosen]
    for _ in range(rounds):
        at = (x @ centers.T).argmax(1)
        sums = np.stack([x[at == k].sum(0) if (at == k).any() else centers[k] for k in range(len(centers))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
        if np.allclose(fresh, centers, atol=1e-6):
            break
        centers = fresh
    return centers[np.linalg.norm(centers, axis=1) > 0]


def limits_of(cosine: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The least cosine that is near enough, by length class: a low quantile, of the class if it has 50 texts, else of
    all texts no longer than that; shorter texts are never held to more than longer ones."""
    out = np.zeros(CLASSES)
    for k in range(CLASSES):
        own = cosine[classes == k]
        own = own if len(own) >= 50 else cosine[classes <= k]
        out[k] = np.quantile(own, FAR / 1000) if len(own) >= 50 else (own.min() if len(own) else 0.0)
    return np.minimum.accumulate(out[::-1])[::-1]


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: Column | None = None, bits: int = BITS, shown: int = SHOWN, clusters: int = CLUSTERS) -> Model:
    """The model of labelled rows; rows without a language are left out, those without text or letters teach nothing.

    Frequencies count all rows. Of each language about `shown` rows, at most 1.5 times as many, are clustered: those whose
    hash (of `order`, and the text) is least; rows equal in both are drawn once. More than MOST_LANGUAGES languages are an error. Without rows the model
    knows no language.
    """
    bounded_batches(docs)
    rows = docs.where(docs[lang_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), F.xxhash64(*([order] if order is not None else []), docs[text_col]).alias("draw"))
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not known:
        return Model([], np.empty(0, np.int64), np.empty((0, 1 << bits), np.float32), np.zeros(1 << bits, np.float32), np.zeros((0, CLASSES)), bits)
    below = {r["lang"]: -(1 << 63) + int(min(1.0, shown / r["n"]) * ((1 << 64) - 1)) for r in known}

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, documents, taken = np.zeros(1 << bits, np.int64), 0, set()
        columns = ["lang", "segment", "salt", "draw", "documents", "data"]
        for pdf in batches:
            drawn = []
            for first, tf, _ in _counted(list(pdf["text"]), bits):
                seen += (tf > 0).sum(0)
                documents += len(tf)
                for lang, draw, own in zip(pdf["lang"].iloc[first : first + len(tf)], pdf["draw"].iloc[first : first + len(tf)], tf, strict=True):
                    if draw <= below[lang] and (lang, draw) not in taken:
                        taken.add((lang, draw))
                        at = np.flatnonzero(own)
                        drawn.append((lang, -1, 0, int(draw), 0, at.astype(np.uint32).tobytes() + np.minimum(own[at], 2**32 - 1).astype(np.uint32).tobytes()))
            yield pd.DataFrame(drawn, columns=columns)
        give_back()
        salt = TaskContext.get().partitionId() % 64
        yield pd.DataFrame([("", k, salt, 0, documents, seen[k * SEGMENT : (k + 1) * SEGMENT].tobytes()) for k in range((1 << bits) // SEGMENT)], columns=columns)

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["data"]], axis=0)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "salt": [0], "documents": [int(pdf["documents"].sum())], "data": [total.tobytes()]})

    found = durable(rows.mapInPandas(tally, "lang string, segment int, salt int, draw long, documents long, data binary"), "language-counts")
    parts = found.where("segment >= 0").select("segment", "salt", "documents", "data")
    for _ in range(2):  # sums of parts of the tasks, then of these
        parts = parts.groupBy("segment", "salt").applyInPandas(united, "segment int, salt int, documents long, data binary")
    total = parts.toPandas().sort_values("segment")
    seen, documents = np.frombuffer(b"".join(total["data"]), np.int64), int(total["documents"].iloc[0])
    idf = np.log((documents + 1) / (seen + 1)).astype(np.float32) + np.float32(1)
    most = int(1.5 * shown)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("draw").sort_values("draw").iloc[:most]
        tf = np.zeros((len(pdf), 1 << bits), np.int64)
        for row, data in zip(tf, pdf["data"], strict=True):
            at, n = np.frombuffer(data, np.uint32).reshape(2, -1)
            row[at] = n
        tf = tf[tf.sum(1) > 0]
        x = vectors(tf, idf)
        centers = clustered(x, clusters) if len(x) else np.empty((0, 1 << bits), np.float32)
        limits = limits_of((x @ centers.T).max(1), length_class(tf)) if len(centers) else np.zeros(CLASSES)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centers": [centers.astype(np.float32).tobytes()], "limits": [limits.tobytes()]})

    learned = found.where("segment < 0").groupBy("lang").applyInPandas(learn, "lang string, centers binary, limits binary").toPandas().sort_values("lang")
    release(found)
    centers = [np.frombuffer(c, np.float32).reshape(-1, 1 << bits) for c in learned["centers"]]
    names = [lang for lang, c in zip(learned["lang"], centers, strict=True) if len(c)]
    limits = [np.frombuffer(x, np.float64) for x, c in zip(learned["limits"], centers, strict=True) if len(c)]
    centers = [c for c in centers if len(c)]
    owner = np.repeat(np.arange(len(names)), [len(c) for c in centers])
    return Model(names, owner, np.concatenate(centers) if centers else np.empty((0, 1 << bits), np.float32), idf, np.array(limits).reshape(-1, CLASSES), bits, documents)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", reject: bool = False) -> DataFrame:
    """Every row of `docs` with lang_pred, score (cosine, 0 to 1) and rejected; names that clash get underscores.

    Null texts and those without a letter are `und`, score 0, and rejected, as all are if the model knows no language.
    With `reject`, rejected texts are `und` too. Only the text counts: equal texts have equal results, repeated rows
    stay, an empty table gives no rows.
    """
    spark = bounded_batches(docs)
    shared = spark.sparkContext.broadcast(model)
    pred, score, far = names = unused(docs, "lang_pred", "score", "rejected")
    cols = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*cols.values())
    text = cols[text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = [*model.languages, "und"]
        for batch in batches:
            n = batch.num_rows
            who, near, out = np.full(n, len(known) - 1), np.zeros(n), np.ones(n, bool)
            for first, tf, lettered in _counted(batch.column(text).to_pylist(), model.bits):
                own, cosine, rejected = model.nearest(tf)
                s = slice(first, first + len(tf))
                named = lettered & (own >= 0) & ~(rejected & reject)
                who[s], near[s], out[s] = np.where(named, own, len(known) - 1), np.where(lettered & (own >= 0), cosine, 0), rejected | ~lettered
            added = [pa.array([known[k] for k in who], pa.string()), pa.array(near), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])
        give_back()

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(cols.values(), docs.schema, strict=True))
    found = rows.mapInArrow(run, f"{schema}, {pred} string, {score} double, {far} boolean")
    return found.select(*[F.col(n).alias(c) for c, n in cols.items()], *names)
