"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's vector is the mean of hashed embeddings of the word, its beginnings and its ending, so rare
inflections share what their stems teach. Filters of widths 1, 2 and 3 slide over the whole text; each
filter's maximum over all positions feeds a logistic output. The language is guessed from hashed words;
the logit at which documents of a language count as toxic is fitted on labelled rows kept out of training.
Scores depend on the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Spans, runs, spans
from .storage import bounded_batches, durable, give_back, release, unused

F32, U64 = np.float32, np.uint64
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Byte lengths of the beginnings that count as features.
HEADS = (3, 4, 5, 6, 7, 8)
#: Learning rates of the dense parts and of the embeddings.
RATE, EMBED_RATE = 0.01, 1.0
#: Texts shown in training, all epochs together; few texts are shown more often, within limits.
SHOWN, EPOCHS = 36_000, (3, 60)
#: Rows of zeros after each text: windows start in the first half of them at most, so that none reaches the next text.
REACH = max(WIDTHS) - 1
GAP = 2 * REACH

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(found: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word's features (words x features), and the distinct word at each position.

    Bucket 0 stands for a feature that the word is too short for.
    """
    whole = found.hashes(found.begin, found.end)
    _, first, at = np.unique(whole, return_index=True, return_inverse=True)
    begin, end = found.begin[first], found.end[first]
    size = end - begin
    cols = [whole[first]]
    for n in HEADS:
        h = found.hashes(begin, np.minimum(begin + n, end)) + U64(n)
        cols.append(np.where(size > n, h, U64(0)))
    cols.append(np.where(size > 4, found.hashes(np.maximum(end - 4, begin), end) + U64(99), U64(0)))
    return _buckets(np.stack(cols, 1)), at


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == 0, 0, (hashes >> U64(20)) % U64(BUCKETS - 1) + U64(1)).astype(np.int32)


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS x DIM; row 0 stays zero
    conv: list[np.ndarray]  # for each width, width x DIM x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    out: np.ndarray
    out_bias: float
    languages: list[str]
    lang_logp: np.ndarray  # BUCKETS x languages
    cut: np.ndarray  # logit at the threshold, by language


def _vectors(embed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return embed[ids].sum(1) / np.maximum((ids > 0).sum(1), 1)[:, None].astype(F32)


def _layout(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each word stands once GAP rows follow every text; where each text starts; the number of rows."""
    n = np.diff(starts)
    begin = np.concatenate([[0], np.cumsum(n + GAP)])
    return np.arange(starts[-1]) + np.repeat(begin[:-1] - starts[:-1], n), begin[:-1], int(begin[-1])


class Scorer:
    """A model with the projection of a word through every filter laid out for one gather a word."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.proj = np.concatenate([w[j] for w in model.conv for j in range(len(w))], 1)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the logit and the guessed language's number."""
        m, raw = self.model, [t.lower().encode() for t in texts]
        logit, lang = np.empty(len(raw)), np.zeros(len(raw), np.int64)
        for a, b in runs(raw):
            found = spans(raw[a:b], _BETWEEN, fold=False)
            ids, at = features(found)
            place, begin, total = _layout(found.starts)
            starts_and_ends = np.stack([begin, begin + np.diff(found.starts) + REACH], 1).ravel()
            table = (_vectors(m.embed, ids) @ self.proj).astype(F32)
            peak, col = np.empty((b - a, len(m.bias)), F32), 0
            for k, width in enumerate(WIDTHS):
                y = np.zeros((total, FILTERS), F32)
                for j in range(width):
                    y[place[place >= j] - j] += table[at[place >= j], col : col + FILTERS] if j else table[at, col : col + FILTERS]
                    col += FILTERS
                peak[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(y, starts_and_ends, 0)[::2]
            logit[a:b] = (np.maximum(peak + m.bias, 0).astype(float) * m.out).sum(1) + m.out_bias  # row by row: equal texts, equal logits
            votes = np.zeros((total, len(m.languages)), F32)
            votes[place] = m.lang_logp[ids[:, 0]][at]
            lang[a:b] = np.add.reduceat(votes, begin, 0).argmax(1)
        return logit, lang

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, a score that is 0.5 at its language's threshold, and the language."""
        logit, lang = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logit - self.model.cut[lang], -40, 40))), lang


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(shape, F32), np.zeros(shape, F32), 0, rate

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


def _best_cut(z: np.ndarray, n: np.ndarray, hits: np.ndarray, start: float) -> float:
    """The cut with the best F1, halfway between neighbouring logits, of equals the one nearest `start`.

    z: distinct logits; n, hits: the rows at each, and those of them that are toxic.
    """
    order = np.argsort(-z)
    z, above, hit = z[order], np.cumsum(n[order]), np.cumsum(hits[order])
    f1 = 2 * hit / (above + hit[-1])
    mid = np.concatenate([(z[:-1] + z[1:]) / 2, z[-1:] - 1])
    ok = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(mid[ok[np.abs(mid[ok] - start).argmin()]])


@dataclass
class State:
    """What training starts from and gives back."""

    embed: np.ndarray
    square: np.ndarray  # sums of squared gradients, by bucket
    dense: list[np.ndarray]  # filters of each width, bias, out, out_bias
    steps: list[_Adam]  # of each dense part

    def copy(self) -> State:
        return pickle.loads(pickle.dumps(self))


def _begin(seed: int = 5) -> State:
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(F32)
    embed[0] = 0
    conv = [rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(F32) for w in WIDTHS]
    dense = [*conv, np.zeros(n_out, F32), rng.normal(0, 0.2, n_out).astype(F32), np.zeros(1, F32)]
    return State(embed, np.full(BUCKETS, 1e-3, F32), dense, [_Adam(x.shape, RATE) for x in dense])


def _found(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids, at = features(spans([text.lower().encode()], _BETWEEN, fold=False))
    return ids, at.astype(np.int32)


def _together(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts' features: those of all words, the word at each position, and how many positions each text has."""
    base = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])])
    return np.concatenate([ids for ids, _ in found]), np.concatenate([at + k for (_, at), k in zip(found, base, strict=False)]), np.array([len(at) for _, at in found])


def _at_once(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = spans([t.lower().encode() for t in texts], _BETWEEN, fold=False)
    return *features(found), np.diff(found.starts)


def train(state: State, texts: list, y: np.ndarray, heavy: float, rng: np.random.Generator, *, batch: int = 32) -> None:
    """Show every text (or what `_found` gives for it) once, in an order drawn anew, and change the state. A toxic text weighs `heavy`."""
    y, turn = np.asarray(y, F32), rng.permutation(len(texts))
    for a in range(0, len(turn), batch):
        part = turn[a : a + batch]
        some = [texts[i] for i in part]
        _step(state, *(_at_once if isinstance(some[0], str) else _together)(some), y[part], np.where(y[part] > 0, heavy, 1.0).astype(F32), rng)


def _step(state: State, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One change of the state, by the gradients of some texts."""
    embed, square, (*conv, bias, out, out_bias), n_out = state.embed, state.square, state.dense, len(state.dense[-3])
    place, begin, total = _layout(np.concatenate([[0], np.cumsum(sizes)]))
    vec = _vectors(embed, ids)
    x = np.zeros((total + GAP, DIM), F32)
    x[place] = vec[at]
    word = np.full(total + GAP, -1)
    word[place] = at
    peak, where = np.empty((len(sizes), n_out), F32), np.empty((len(sizes), n_out), np.int64)
    for k, width in enumerate(WIDTHS):
        z = sum(x[j : j + total] @ conv[k][j] for j in range(width))
        for d in range(len(sizes)):
            s, e = begin[d], begin[d] + sizes[d] + REACH
            top = z[s:e].argmax(0)
            where[d, k * FILTERS : (k + 1) * FILTERS] = top + s
            peak[d, k * FILTERS : (k + 1) * FILTERS] = z[s:e][top, np.arange(FILTERS)]
    h = np.maximum(peak + bias, 0)
    keep = (rng.random(h.shape) > 0.2).astype(F32) / 0.8
    p = 1 / (1 + np.exp(-((h * keep) @ out + out_bias)))
    g = ((p - y) * weight / len(sizes)).astype(F32)
    gh = g[:, None] * out[None, :] * keep * (h > 0)
    g_out = (h * keep).T @ g + 1e-4 * out
    rows, grads = [], []
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        pos, gk = where[:, cols].ravel(), gh[:, cols]
        for j in range(width):
            xs = x[pos + j].reshape(len(sizes), FILTERS, DIM)
            g_conv = np.einsum("dfi,df->if", xs, gk)
            to_x = (gk[:, :, None] * conv[k][j].T[None]).reshape(-1, DIM)
            live = (word[pos + j] >= 0) & (np.abs(gk.ravel()) > 0)
            rows.append(word[pos + j][live])
            grads.append(to_x[live])
            if j == 0:
                total_grad = np.zeros_like(conv[k])
            total_grad[j] = g_conv
        state.steps[k].step(conv[k], total_grad)
    state.steps[-3].step(bias, gh.sum(0))
    state.steps[-2].step(out, g_out)
    state.steps[-1].step(out_bias, np.array([g.sum()], F32))
    if rows and len(r := np.concatenate(rows)):
        used = ids[r]
        each = np.concatenate(grads) / np.maximum((used > 0).sum(1), 1)[:, None].astype(F32)
        order = np.argsort(used, axis=None, kind="stable")
        hit, first = np.unique(used.ravel()[order], return_index=True)
        grad = np.add.reduceat(each[order // used.shape[1]], first, 0)
        square[hit] += (grad * grad).mean(1)
        embed[hit] -= EMBED_RATE * grad / np.sqrt(square[hit])[:, None]
        embed[0] = 0


#: Labelled rows of a shard, about; buckets of one block of a round's outcome.
SHARD, BLOCK = 6_000, 2_048
#: Rounds over all rows, once the first shard was shown for long; labelled rows that are broadcast.
ROUNDS, FEW = EPOCHS[0], 500_000


def _count_words(words: dict[str, np.ndarray], texts: list[str], langs: list[str]) -> None:
    """Add up, for each language, how many texts have a word in each bucket."""
    raw = [t.lower().encode() for t in texts]
    for a, b in runs(raw):
        found = spans(raw[a:b], _BETWEEN, fold=False)
        bucket = _buckets(found.hashes(found.begin, found.end))
        pair = np.unique(np.repeat(np.arange(b - a), np.diff(found.starts)) * BUCKETS + bucket)
        for lang in set(langs[a:b]):
            mine = np.array([x == lang for x in langs[a:b]])
            words[lang] = words.get(lang, 0) + np.bincount(pair[mine[pair // BUCKETS]] % BUCKETS, minlength=BUCKETS)


def _outcome(before: State, after: State, words: dict[str, np.ndarray], shard: int, n: int) -> Iterator[dict]:
    """Changes of a state in blocks, as sums that add up: of the dense parts (block -1) times n, and of touched buckets."""
    old, new = ([*s.dense, *[m for a in s.steps for m in (a.m, a.v)]] for s in (before, after))
    yield {"block": -1, "shard": shard, "data": pickle.dumps(([n * (y.astype(float) - x) for x, y in zip(old, new, strict=True)], n, after.steps[0].t - before.steps[0].t))}
    for k in range(0, BUCKETS, BLOCK):
        at = np.flatnonzero(after.square[k : k + BLOCK] > before.square[k : k + BLOCK]) + k
        found = {lang: count[k : k + BLOCK] for lang, count in words.items()}
        yield {"block": k, "shard": shard, "data": pickle.dumps((at, np.ones(len(at)), after.embed[at] - before.embed[at], after.square[at] - before.square[at], found))}


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's changes of some shards as one, whatever the order of the rows."""
    rows = rows.sort_values(["shard", "data"])
    block, parts = int(rows["block"].iloc[0]), [pickle.loads(x) for x in rows["data"]]
    if block < 0:
        out = ([sum(xs) for xs in zip(*[p[0] for p in parts], strict=True)], sum(p[1] for p in parts), max(p[2] for p in parts))
    else:
        at = np.unique(np.concatenate([p[0] for p in parts]))
        shards, embed, square, words = np.zeros(len(at)), np.zeros((len(at), DIM)), np.zeros(len(at)), {}
        for p in parts:
            k = np.searchsorted(at, p[0])
            for total, x in zip((shards, embed, square), p[1:4], strict=True):
                total[k] += x
            for lang, count in p[4].items():
                words[lang] = words.get(lang, 0) + count
        out = (at, shards, embed, square, words)
    return pd.DataFrame({"block": [block], "shard": [int(rows["shard"].iloc[0])], "data": [pickle.dumps(out)]})


def _applied(state: State, outcome: list) -> dict[str, np.ndarray]:
    """Add the shards' mean change to the state: by their rows; of a bucket, of those that touched it. Returns the languages' counts."""
    words: dict[str, np.ndarray] = {}
    for block, data in sorted(outcome):
        if block < 0:
            change, n, t = pickle.loads(data)
            for x, c in zip([*state.dense, *[m for a in state.steps for m in (a.m, a.v)]], change, strict=True):
                x += (c / n).astype(F32)
            for a in state.steps:
                a.t += t
                np.maximum(a.v, 0, out=a.v)
            continue
        at, shards, embed, square, found = pickle.loads(data)
        state.embed[at] += (embed / shards[:, None]).astype(F32)
        state.square[at] += (square / shards).astype(F32)
        for lang, count in found.items():
            words.setdefault(lang, np.zeros(BUCKETS))[block : block + BLOCK] = count
    return words


def _round(rows: DataFrame, state: State, number: int, heavy: float) -> dict[str, np.ndarray]:
    """Train on all rows, each shard from the same state, and take the shards' mean; number 0: shown for long, in one task.

    Returns the languages' counts of words, of rounds 0 and 1 only.

    Rows of a shard lie together in one order, so that the outcome does not depend on how files are dealt to tasks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, n, local, words, rng, kept = None, 0, None, {}, None, []
        pieces = (x for pdf in batches for _, x in pdf.groupby((pdf["shard"].diff() != 0).cumsum(), sort=False))
        for piece in pieces:
            if piece["shard"].iloc[0] != shard:
                if n:
                    yield pd.DataFrame(_outcome(shared.value, local, words, shard, n))
                shard, n, local, words = int(piece["shard"].iloc[0]), 0, shared.value.copy(), {}
                rng = np.random.default_rng([5, number, shard])
            if number < 2:
                _count_words(words, piece["text"].tolist(), [x if isinstance(x, str) else "" for x in piece["lang"]])
            n, fit = n + len(piece), piece[~piece["tuned"]]
            if number:
                train(local, fit["text"].tolist(), fit["toxic"].to_numpy(), heavy, rng)
            else:
                kept.append(([_found(t) for t in fit["text"]], fit["toxic"].to_numpy()))
        if kept:
            every, y = [x for found, _ in kept for x in found], np.concatenate([y for _, y in kept])
            for _ in range(int(np.clip(SHOWN // max(len(every), 1), *EPOCHS))):
                train(local, every, y, heavy, rng)
        if n:
            yield pd.DataFrame(_outcome(shared.value, local, words, shard, n))
        del kept, local
        give_back()

    changes = rows.select("shard", "text", "lang", "toxic", "tuned").mapInPandas(run, kind := "block int, shard int, data binary")
    some = changes.groupBy("block", F.expr("shard div 64")).applyInPandas(_summed, kind)
    outcome = [(x.block, x.data) for x in some.groupBy("block").applyInPandas(_summed, kind).collect()]
    shared.unpersist()
    return _applied(state, outcome)


def _cuts(rows: DataFrame, model: Model, least: int = 15) -> np.ndarray:
    """The languages' cuts, from the rows that training leaves out; logits count to a thousandth.

    A language with fewer than `least` toxic rows among those takes the cut of all languages.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            logit, lang = scorer.logits(pdf["text"].tolist())
            yield pd.DataFrame({"lang": lang, "z": np.round(1000 * np.clip(logit, -40, 40)).astype(int), "hits": pdf["toxic"].astype(int)})
        give_back()

    found = rows.where("tuned").select("text", "toxic").mapInPandas(run, "lang int, z int, hits int")
    at = found.groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("hits").alias("hits")).orderBy("lang", "z").toPandas()
    shared.unpersist()
    cut = np.zeros(len(model.languages))
    if not 0 < at["hits"].sum() < at["n"].sum():
        return cut
    whole = at.groupby("z", as_index=False)[["n", "hits"]].sum()
    cut[:] = _best_cut(whole["z"].to_numpy() / 1000, whole["n"].to_numpy(), whole["hits"].to_numpy(), 0.0)
    shared_cut = cut[0] if len(cut) else 0.0
    for lang, x in at.groupby("lang"):
        if x["hits"].sum() >= least:
            cut[lang] = _best_cut(x["z"].to_numpy() / 1000, x["n"].to_numpy(), x["hits"].to_numpy(), shared_cut)
    return cut


def _mixed(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))


def labelled(docs: DataFrame, labels: DataFrame, *, few: int = FEW) -> DataFrame:
    """Every labelled row that isn't held out: doc_id, text, lang, toxic, its shard, and whether it is kept for the cuts.

    An id and label is one row, however often it is repeated: the least text that has it. Texts are moved once: up to
    `few` ids and labels are broadcast; of more, a bitmap is, so that hardly any text without a label is joined.
    """
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    n, docs = rows.count(), docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull())
    if n <= few:
        found = docs.join(F.broadcast(rows), "doc_id")
    else:
        slots = 32_768 * (n // 2_048 + 1)
        slot = F.pmod(_mixed(7), F.lit(slots))
        marks = rows.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32_768).alias("marks"))
        byte = F.expr("cast(conv(hex(substring(marks, cast(slot % 32768 div 8 + 1 AS int), 1)), 16, 10) AS int)")
        likely = docs.withColumn("slot", slot).withColumn("part", F.expr("slot div 32768")).join(F.broadcast(marks), "part")
        found = likely.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(slot % 8 AS int))")) != 0).select(*docs.columns).join(rows, "doc_id")
    shards = -(-n // SHARD)
    found = found.withColumn("shard", F.pmod(_mixed(9), F.lit(max(shards, 1))).cast("int")).repartition(max(shards, 1), "shard")
    found = found.groupBy("shard", "doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    return found.select("shard", "doc_id", "t.text", "t.lang", "toxic", (F.pmod(_mixed(5), F.lit(5)) == 0).alias("tuned"))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, most_bytes: int) -> DataFrame:
    """At most `bound` labelled rows of `most_bytes` together, a third of them toxic where there are as many, never a held-out one.

    Which rows is settled by a hash of the id, so reruns take the same. An id and label is one row, however often it is
    repeated: the least text that has it. Columns: doc_id, text, lang, toxic.
    """
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    mixed = F.xxhash64("doc_id", F.lit(9))
    picked = rows.where("toxic = 1").orderBy(mixed, "doc_id").limit(bound // 3).union(rows.where("toxic = 0").orderBy(mixed, "doc_id").limit(bound - bound // 3))
    # at most `bound` ids and labels are broadcast
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "t.text", "t.lang", "toxic")
    # a window over `bound` rows at most, for a bound of bytes too
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy().orderBy(mixed, "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).drop("so_far")


def fit(docs: DataFrame, labels: DataFrame, *, bound: int | None = None, most_bytes: int = 1 << 26) -> Model:
    """Train on every labelled row outside the held-out fold, then fit the languages' cuts on every fifth, which training leaves out.

    Rows lie in shards. The first one, or what `most_bytes` hold of it, is shown for long in one task; then all shards are
    trained in rounds, each from one state, whose changes are averaged. So no task, and not the driver, holds more than
    a shard or a model. With `bound`, at most so many rows of `most_bytes` are drawn. Without rows of both classes the
    model scores every text below 0.5.
    """
    bounded_batches(docs)
    if bound is None:
        rows = labelled(docs, labels, few=FEW)
    else:
        rows = labelled_sample(docs, labels, bound, most_bytes).select(F.lit(0).alias("shard"), "doc_id", "text", "lang", "toxic", (F.pmod(_mixed(5), F.lit(5)) == 0).alias("tuned"))
        rows = rows.repartition(1)
    rows = durable(rows.sortWithinPartitions("shard", _mixed(3), "doc_id", "toxic"), "toxicity")
    state, names, logp = _begin(), [""], np.zeros((BUCKETS, 1), F32)
    in_first = F.sum(F.when(F.col("shard") == 0, F.octet_length("text")))
    last, size, fitted, toxic = rows.agg(F.max("shard"), in_first, F.count_if(~F.col("tuned")), F.count_if(~F.col("tuned") & (F.col("toxic") == 1))).first()
    model = Model(state.embed, state.dense[:-3], state.dense[-3], state.dense[-2], -4.0, names, logp, np.zeros(1))
    if 0 < toxic < fitted:
        heavy = min(5.0, (fitted - toxic) / toxic)
        so_far = F.sum(F.octet_length("text")).over(Window.orderBy(_mixed(3), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, 0))
        first = rows.where("shard = 0").withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes)
        words = _round(first.repartition(1).sortWithinPartitions(_mixed(3), "doc_id", "toxic"), state, 0, heavy)
        if last or size > most_bytes:
            for k in range(1, ROUNDS + 1):
                words = _round(rows, state, k, heavy) or words
        names = sorted(words)
        counts = 0.1 + np.stack([words[x] for x in names], 1)
        logp = np.log(counts / counts.sum(0)).astype(F32)
        model = Model(state.embed, state.dense[:-3], state.dense[-3], state.dense[-2], float(state.dense[-1][0]), names, logp, np.zeros(len(names)))
        model.cut = _cuts(rows, model)
    release(rows)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in `keep`, score (0 to 1), predicted (score >= 0.5) and the guessed language.

    Null text is empty. An empty text has no features and gets the model's bias. Equal texts have equal
    scores; repeated rows stay repeated; an empty table gives no rows; other columns play no part.
    """
    shared = bounded_batches(docs).sparkContext.broadcast(model)
    (source,) = unused(docs, "text_to_score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, pdf = Scorer(shared.value), None
        for pdf in batches:
            texts = pdf.pop(source)
            s, lang = scorer.scores([t if isinstance(t, str) else "" for t in texts])
            pdf["score"], pdf["predicted"], pdf["guessed_lang"] = s, (s >= 0.5).astype(np.int32), np.array(scorer.model.languages, object)[lang]
            yield pdf
        del pdf
        give_back()

    kept = docs.select(docs[id_col].alias("doc_id"), *[docs[c] for c in keep], docs[text_col].alias(source))
    schema = kept.drop(source).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("guessed_lang", T.StringType())
    return kept.mapInPandas(run, schema)
