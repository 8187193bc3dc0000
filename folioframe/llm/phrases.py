"""Phrase mining over position bitmaps.

Documents of one language, some SHARD words of one task, are a shard. Each of its words has a bitmap of the places
where it stands; between two pieces there is an empty place, so nothing reaches from one piece into the next. Stored,
a bitmap is the distances of its bits; at work it is its nonempty blocks of 16 places, as in SPAM's vertical
bitmaps. A phrase's bitmap marks its last words. Shifted by one place, and taken AND the bitmap of a word, it is that
of the phrase longer by the word, and its population count the occurrences in the shard. Blocks of two bitmaps meet
only if they have a number in common. Extension goes depth first, for some first words at a time, so that only their
descendants are held.

A phrase can be frequent only if its parts are, over all shards. So first words are counted, then pairs of frequent
words, then triples of frequent pairs. Counts are summed over shards in buckets by a phrase's 64-bit hash; how many
buckets there are depends on the number of words, and a bucket's row of a shard holds one count at least, so their
shuffle is linear in the counts. Which words and pairs are frequent goes to the tasks as a Bloom filter of fixed size:
where it errs, a phrase is counted for nothing, but none is lost. Frequent phrases name one shard that has them, which
tells their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import _LOWER, mix64, runs, spans
from .packed import gaps, pack, pack_keys, rows_of, ungap, unpack, unpack_keys
from .storage import bounded_batches, durable, give_back, hot_join, release, shuffle_width

U16, U64 = np.uint16, np.uint64
#: Words of a shard, counts that a bucket sums, buckets at least, and ANDs taken at a time.
SHARD, BUCKET, LEAST, TOGETHER = 250_000, 2_000_000, 64, 200_000
#: Bits of the filters of words and of pairs, and parts in which they are made.
FILTER_BITS, FILTER_PARTS = 27, 64
SHARDS = "lang string, shard long, words long, keys binary, counts binary, bits binary, names binary, ends binary"
BLOCK = 4  # places of a block, as a power of two


@lru_cache(maxsize=1)
def _marks() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end a piece, and those that are no part of a word."""
    ends = np.zeros(256, bool)
    ends[list(b".,;:!?\n\x0b\x0c\r")] = True
    between = ends.copy()
    between[list(b" \t")] = True
    return ends, between


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """All words' hashes, whether each begins a piece, where they begin and end, and the joined, folded text."""
    ends, between = _marks()
    found = spans(texts, between)
    joined = b" ".join(texts).translate(_LOWER)
    before = np.concatenate([[0], np.cumsum(ends[np.frombuffer(joined, np.uint8)])])[found.begin]
    new = np.ones(len(found.begin), bool)
    new[1:] = before[1:] != before[:-1]
    new[found.starts[:-1][np.diff(found.starts) > 0]] = True
    return found.hashes(found.begin, found.end), new, found.begin, found.end, joined


class Gathered:
    """Words of one language, until they are a shard."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.new: list[np.ndarray] = []
        self.names: dict[int, bytes] = {}
        self.held = 0

    def add(self, texts: list[bytes]) -> None:
        h, new, begin, end, joined = tokens(texts)
        keys, first = np.unique(h, return_index=True)
        for key, b, e in zip(keys.tolist(), begin[first].tolist(), end[first].tolist(), strict=True):
            if key not in self.names:
                self.names[key] = joined[b:e]
        self.hashes.append(h)
        self.new.append(new)
        self.held += len(h)

    def row(self, lang: str, shard: int) -> tuple:
        every, new = np.concatenate(self.hashes), np.concatenate(self.new)
        places = np.arange(len(every)) + np.cumsum(new)  # an empty place before each piece
        keys, at, counts = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        names = [self.names[k] for k in keys.tolist()]
        return (lang, shard, len(every), pack_keys(keys), pack(counts), pack(gaps(places[order], np.cumsum(counts) - counts)), b"".join(names), pack(np.array([len(x) for x in names])))


def shards(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", no_lang: str = "und") -> DataFrame:
    """The shards of all documents, written to the shared folder."""
    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, Gathered] = {}
        number = TaskContext.get().partitionId() << 32
        columns = [c.split()[0] for c in SHARDS.split(", ")]

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pandas(pd.DataFrame([held.pop(lang).row(lang, number)], columns=columns))

        for batch in batches:
            of: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.setdefault(lang, []).append((text or "").encode())
            for lang, texts in of.items():
                for a, b in runs(texts):
                    own = held.setdefault(lang, Gathered())
                    own.add(texts[a:b])
                    if own.held >= SHARD:
                        yield flush(lang)
            while sum(g.held for g in held.values()) >= 2 * SHARD or len(held) > 256:
                yield flush(max(held, key=lambda x: held[x].held))
        for lang in [x for x in held if held[x].held]:
            yield flush(lang)
        give_back()

    rows = docs.select(docs[text_col].alias("t"), F.coalesce(docs[lang_col].cast("string"), F.lit(no_lang)).alias("l"))
    return durable(rows.mapInArrow(run, SHARDS), "position-bitmaps")


def key_of(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A phrase's hash from that of the phrase without its last word, and the word's."""
    return mix64(left * U64(0xCA5A826395121157) + word * U64(0x8CB92BA72F3D8DD7) + U64(1))


def of_lang(keys: np.ndarray, lang: str) -> np.ndarray:
    """Words' hashes, apart for each language."""
    salt = int.from_bytes(lang.encode()[:64], "little") % ((1 << 61) - 1)
    for k in range(64, len(lang.encode()), 64):
        salt = (salt * 31 + int.from_bytes(lang.encode()[k : k + 64], "little")) % ((1 << 61) - 1)
    return mix64(keys + mix64(np.array([salt], U64)))


class Filter:
    """A Bloom filter of keys: a part by a key's first bits, and there three bits by its others."""

    def __init__(self, flags: np.ndarray | None):
        self.flags = flags  # packed, 8 bits a byte; None: all keys may be there

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """Bits within a key's part."""
        inner = bits - (FILTER_PARTS.bit_length() - 1)
        for k in range(3):
            yield mix64(keys + U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) >> U64(64 - inner)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        if self.flags is None:
            return out
        bits = (len(self.flags) * 8).bit_length() - 1
        inner = bits - (FILTER_PARTS.bit_length() - 1)
        part = (keys >> U64(64 - (FILTER_PARTS.bit_length() - 1))) << U64(inner)
        for at in self.places(keys, bits):
            bit = part | at
            out &= (self.flags[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(frequent: DataFrame, n: int, most: int = FILTER_BITS) -> Filter:
    """The filter of the keys (column key) of `frequent`, n rows: 16 bits a key, 2^`most` at most, whatever n."""
    bits = min(most, max(16, (16 * n).bit_length()))
    inner = bits - (FILTER_PARTS.bit_length() - 1)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << inner, np.uint8)
        for at in Filter.places(pdf["key"].to_numpy(np.int64).view(U64), bits):
            flags[at.astype(np.int64)] = 1
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "data": [np.packbits(flags, bitorder="little").tobytes()]})

    number = F.shiftrightunsigned("key", 64 - (FILTER_PARTS.bit_length() - 1)).cast("int")
    found = frequent.select("key", number.alias("part")).groupBy("part").applyInPandas(part, "part int, data binary").toPandas()
    flags = np.zeros(1 << bits - 3, np.uint8)
    for k, data in zip(found["part"], found["data"], strict=True):
        flags[k << inner - 3 : k + 1 << inner - 3] = np.frombuffer(data, np.uint8)
    return Filter(flags)


class Bitmaps:
    """A shard at work: blocks of the bitmaps of its frequent words."""

    def __init__(self, row: dict, words: Filter):
        keys = unpack_keys(row["keys"])
        counts = unpack(row["counts"], len(keys))
        places = ungap(unpack(row["bits"], int(counts.sum())), np.cumsum(counts) - counts)
        self.hashes = of_lang(keys, row["lang"])
        self.frequent = words.has(self.hashes)
        kept = np.repeat(self.frequent, counts)
        word, place = np.repeat(np.arange(len(keys)), counts)[kept], places[kept]
        cell = word << 40 | place >> BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bits = (1 << (place & 15)).astype(U16)
        self.word, self.block = word[first], (place >> BLOCK)[first]
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        order = np.argsort(self.block, kind="stable")  # bitmaps' blocks by number
        self.by_word, self.by_bits = self.word[order], self.bits[order]
        last = int(self.block.max(initial=0)) + 2
        self.starts = np.searchsorted(self.block[order], np.arange(last + 1))
        self.per_word = np.searchsorted(self.word, np.arange(len(keys) + 1))

    def shifted(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps moved on by one place."""
        over = np.flatnonzero(bits >> U16(15))
        return np.concatenate([node, node[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([bits << U16(1), np.ones(len(over), U16)])

    def extended(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, word, block, bits): the nonempty blocks of each node's bitmap, shifted, AND each word's."""
        node, block, bits = self.shifted(node, block, bits)
        some = bits > 0
        node, block, bits = node[some], block[some], bits[some]
        n = self.starts[block + 1] - self.starts[block]
        ends = np.cumsum(n)
        at = 0
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            own = n[at:to]
            from_ = np.repeat(np.arange(at, to), own)
            other = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.starts[block[at:to]], own)
            both = bits[from_] & self.by_bits[other]
            hit = np.flatnonzero(both)
            yield node[from_[hit]], self.by_word[other[hit]], block[from_[hit]], both[hit]
            at = to

    def roots(self) -> Iterator[slice]:
        """Blocks of some words' bitmaps at a time."""
        step = max(1, TOGETHER // 8)
        at = 0
        while at < len(self.word):
            to = int(self.per_word[self.word[min(at + step, len(self.word)) - 1] + 1])
            yield slice(at, to)
            at = to

    def pairs(self, of: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, second word, block, bits) of the pairs that begin with some words."""
        parts = list(self.extended(self.word[of], self.block[of], self.bits[of]))
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))  # type: ignore[return-value]

    def counted(self, deep: Filter | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, occurrences) of the pairs of frequent words or, given the filter of pairs, of the triples."""
        for of in self.roots():
            u, v, block, bits = self.pairs(of)
            key = key_of(self.hashes[u], self.hashes[v])
            if deep is None:
                yield summed(key, np.bitwise_count(bits))
            else:
                for _, _, _, key3, _, both in self.triples(u, v, key, block, bits, deep):
                    yield summed(key3, np.bitwise_count(both))

    def triples(self, u, v, key, block, bits, deep: Filter) -> Iterator[tuple[np.ndarray, ...]]:
        """(node, word, second word, key, block, bits) of the frequent pairs' extensions by words with which their second
        word is a frequent pair; a node is a place in u, v and key."""
        node = np.flatnonzero(deep.has(key))
        for k, w, b, both in self.extended(node, block[node], bits[node]):
            good = np.flatnonzero(deep.has(key_of(self.hashes[v[k]], self.hashes[w])))
            k, w = k[good], w[good]
            yield k, w, v[k], key_of(key[k], self.hashes[w]), b[good], both[good]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and the sums of their numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _frequent(table: DataFrame, words: Filter | None, pairs: Filter | None, least: int, buckets: int) -> DataFrame:
    """(key, f, shard) of the words, pairs or triples with f >= least over all shards; one of the shards that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                if words is None:
                    keys = unpack_keys(row["keys"])
                    keys, n = summed(of_lang(keys, row["lang"]), unpack(row["counts"], len(keys)))
                else:
                    parts = list(Bitmaps(row, words).counted(pairs))
                    keys, n = summed(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))) if parts else (np.empty(0, U64), np.empty(0, np.int64))
                cut = np.searchsorted((keys >> U64(32)).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut)).tolist()
                cols = [pa.array(full, pa.int32()), pa.array([row["shard"]] * len(full), pa.int64()), pa.array([pack_keys(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary()), pa.array([pack(n[cut[b] : cut[b + 1]]) for b in full], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "shard", "keys", "counts"])
        give_back()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(x) for x in pdf["keys"]]
        every, f = summed(np.concatenate(keys), np.concatenate([unpack(x, len(k)) for k, x in zip(keys, pdf["counts"], strict=True)]))
        every, f = every[f >= least], f[f >= least]
        where = np.zeros(len(every), np.int64)
        for own, shard in zip(keys, pdf["shard"], strict=True):
            at = np.minimum(np.searchsorted(every, own), max(0, len(every) - 1))
            where[at[every[at] == own] if len(every) else []] = shard
        return pd.DataFrame({"key": every.view(np.int64), "f": f, "shard": where})

    columns = ["lang", "shard", "keys", "counts"] + (["bits"] if words is not None else [])
    rows = table.select(*columns).mapInArrow(run, "bucket int, shard long, keys binary, counts binary")
    return durable(rows.groupBy("bucket").applyInPandas(unite, "key long, f long, shard long"), "frequent")


def _named(table: DataFrame, wanted: DataFrame, words: Filter, pairs: Filter) -> DataFrame:
    """(lang, phrase, size, key, first, second, third, head, tail): the words and the parts' keys of the wanted phrases,
    (key, shard), each told by its shard. head and tail are the pairs in a triple."""
    schema = "lang string, phrase string, size int, key long, first long, second long, third long, head long, tail long"

    def tell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        row = left.iloc[0].to_dict()
        maps = Bitmaps(row, words)
        asked = np.sort(right["key"].to_numpy(np.int64).view(U64))
        size = unpack(row["ends"], len(maps.hashes))
        end = np.cumsum(size)
        name = lambda k: row["names"][end[k] - size[k] : end[k]].decode("utf-8", "replace")
        signed = lambda x: int(x.astype(np.int64)) if x < U64(1 << 63) else int(x) - (1 << 64)
        out: dict[int, tuple] = {}
        hit = lambda keys: np.flatnonzero(asked[np.minimum(np.searchsorted(asked, keys), len(asked) - 1)] == keys)
        for of in maps.roots():
            u, v, block, bits = maps.pairs(of)
            key = key_of(maps.hashes[u], maps.hashes[v])
            at = hit(key)
            at = at[np.unique(key[at], return_index=True)[1]]
            for k in at.tolist():
                a, b = u[k], v[k]
                out[int(key[k])] = (row["lang"], f"{name(a)} {name(b)}", 2, signed(key[k]), signed(maps.hashes[a]), signed(maps.hashes[b]), None, None, None)
            for node, w, second, key3, _, _ in maps.triples(u, v, key, block, bits, pairs):
                at = hit(key3)
                at = at[np.unique(key3[at], return_index=True)[1]]
                tails = key_of(maps.hashes[second[at]], maps.hashes[w[at]])
                for k, tail in zip(at.tolist(), tails, strict=True):
                    a, b, c = u[node[k]], second[k], w[k]
                    out[int(key3[k])] = (row["lang"], f"{name(a)} {name(b)} {name(c)}", 3, signed(key3[k]), signed(maps.hashes[a]), signed(maps.hashes[b]), signed(maps.hashes[c]), signed(key[node[k]]), signed(tail))
        return pd.DataFrame({c: pd.Series([r[k] for r in out.values()], dtype="Int64" if k > 5 else None) for k, c in enumerate(columns)})  # never as floats

    return table.select("shard", "lang", "keys", "counts", "bits", "names", "ends").groupBy("shard").cogroup(wanted.groupBy("shard")).applyInPandas(tell, schema)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, best: int = 2000, inside: int = 50, no_lang: str = "und") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of two or three words.

    a is the phrase's number of occurrences within pieces, `least` or more; l and r are those of its two parts at the
    cut with the least score, floor(10^6 a a / (l r)), of equal ones the first; n is the language's number of words. A
    phrase goes if a longer one around it has `inside` per cent of its occurrences or more. Ranks go by score, a, then
    phrase in byte order. Letters A-Z count as a-z. Null or empty texts have no words, null languages are `no_lang`,
    repeated rows count each, other columns are ignored; without frequent phrases, or rows, nothing is returned.
    Phrases are counted by 64-bit hashes: one of a million is mistaken for one of 10^9 others with probability 10^-4.
    """
    spark = bounded_batches(docs)
    table = shards(docs, text_col=text_col, lang_col=lang_col, no_lang=no_lang)
    total = table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(LEAST, -(-int(total) // BUCKET))
    ones = _frequent(table, None, None, least, buckets)
    words = bloom(ones, ones.count())
    twos = _frequent(table, words, None, least, buckets)
    n_twos = twos.count()
    pairs = bloom(twos, n_twos)
    threes = _frequent(table, words, pairs, least, buckets)
    named = durable(_named(table, twos.union(threes).select("shard", "key"), words, pairs), "phrases")
    counts = durable(ones.select("key", "f").union(twos.select("key", "f")).union(threes.select("key", "f")), "counts")
    cuts = F.when(F.col("size") == 2, F.array(F.struct(F.lit(1).alias("k"), F.col("first").alias("left"), F.col("second").alias("right")))).otherwise(
        F.array(F.struct(F.lit(1).alias("k"), F.col("first").alias("left"), F.col("tail").alias("right")), F.struct(F.lit(2).alias("k"), F.col("head").alias("left"), F.col("third").alias("right"))))
    each = named.select("key", F.explode(cuts).alias("c")).select("key", "c.*")
    each = durable(each, "cuts")
    n_cuts = each.count()
    for side, as_ in (("left", "l"), ("right", "r")):
        often = each.groupBy(side).agg(F.count("*").alias("often"))
        known = counts.select(F.col("key").alias(side), F.col("f").alias(as_)).join(often, side)
        each = durable(hot_join(each, known, side, "often", n_cuts).drop("often"), "cuts")
    known = counts.select("key", F.col("f").alias("a"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(1000000 as decimal(7,0)) * (wa * wa) div (wl * wr)")
    scored = each.join(known, "key").withColumns({"wa": wide("a"), "wl": wide("l"), "wr": wide("r")}).select("key", "a", "k", "l", "r", score.alias("score"))
    lowest = scored.groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("key", "a", "c.score", "c.l", "c.r")
    around = named.where("size = 3").join(known, "key").select(F.explode(F.array("head", "tail")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    rows = kept.join(named.select("key", "lang", "phrase"), "key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = F.pmod(F.xxhash64("phrase"), F.lit(min(64, shuffle_width(spark))))
    some = rows.withColumn("part", parts).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    last = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    sizes = table.groupBy("lang").agg(F.sum("words").alias("n"))
    out = durable(last.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(table, ones, twos, threes, named, counts)
    return out
