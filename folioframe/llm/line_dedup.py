"""Fuzzy line dedup by MinHash.

Lines (split at newlines, trimmed, blank ones left alone) become sets of character shingles. Signatures are cut
into bands; lines that share a band meet in a block and are verified by exact Jaccard similarity; verified links
are united, and one line of each component stays: the first by (document, position). Equal lines are one line
throughout.

Only hashes of lines travel, packed, until candidates are known. A Bloom filter of the candidates' ids then keeps other
lines' text out of the shuffle; what it lets through by chance drops out in the join. It has 16 bits a candidate, up to
64 MB; with more than some 100 million candidates it lets more through, which costs shuffling, not results.

Lines and documents are known by 64-bit hashes: of a billion distinct lines, two collide with probability 0.03, and
one of them may then go with the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix64
from .ngram_join import linked_blocks, linked_tiles, overlap_links
from .storage import bounded_batches, durable, give_back, hot_join, release, shuffle_width, unused

U32, U64 = np.uint32, np.uint64
#: Characters in a shingle; bands and rows: a pair of similarity 0.8 shares a band with probability 0.998.
WIDTH, BANDS, ROWS = 8, 12, 4
#: Characters hashed at a time, and lines gathered before their bands are dealt out.
RUN, FLUSH = 1 << 18, 40_000
#: The Bloom filter: powers of two of the fewest and most bits, bits a candidate, probes, bits in a segment.
FEWEST, WIDEST, PER_LINE, PROBES, SEGMENT = 20, 29, 16, 4, 1 << 19

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


@lru_cache(maxsize=1)
def _code_values() -> np.ndarray:
    return mix64(np.arange(1, (1 << 16) + 1, dtype=U64))


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point."""
    out = _code_values()[codes & U32(0xFFFF)]
    high = np.flatnonzero(codes >> U32(16))
    if len(high):
        out[high] = mix64(codes[high].astype(U64) + U64(1))
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R, U64), np.full(n, _R_INV, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Lines:
    """The lines of some texts, trimmed: where each begins and ends, its text's number and its place there."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), U32)
        stop = np.flatnonzero(codes == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        solid = np.flatnonzero(codes > 32)
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, stop)
        self.filled = b > a
        grown = np.append(solid, 0)
        self.begin = np.where(self.filled, grown[a], start)
        self.end = np.where(self.filled, grown[b - 1] + 1, start)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.place = np.arange(len(start)) - first[self.text]
        self.joined = joined
        up, self._down = _powers(1 << max(16, len(codes).bit_length()))
        self._total = np.zeros(len(codes) + 1, U64)
        np.cumsum(np.multiply(value := _values(codes), up[: len(codes)], out=value), out=self._total[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._total[end] - self._total[begin]) * self._down[begin])

    def ids(self) -> np.ndarray:
        return self.hashes(self.begin, self.end).view(np.int64)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of the lines `which`, and where each line's begin; short lines are one shingle."""
        begin, end = self.begin[which], self.end[which]
        n = np.maximum(end - begin - WIDTH + 1, 1)
        cut = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(cut[-1]) - np.repeat(cut[:-1] - begin, n)
        return self.hashes(at, np.minimum(at + WIDTH, np.repeat(end, n))), cut


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > RUN:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


@lru_cache(maxsize=1)
def _permutations() -> np.ndarray:
    """Odd factors: multiplying by one permutes the 32-bit integers."""
    return (mix64(np.arange(1, BANDS * ROWS + 1, dtype=U64)) >> U64(32)).astype(U32) | U32(1)


def band_keys(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Lines x bands: a key for each band of each line's signature."""
    h = (hashes >> U64(32)).astype(U32)
    mul, buffer = _permutations(), np.empty_like(h)
    keys = np.empty((len(cut) - 1, BANDS), U64)
    for b in range(BANDS):
        key = np.full(len(cut) - 1, b + 1, U64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat(np.multiply(h, mul[r], out=buffer), cut[:-1])
            key = mix64(key * U64(_R) + low)
        keys[:, b] = key
    return keys


def _deal(ids: np.ndarray, keys: np.ndarray, bits: int) -> pd.DataFrame:
    key, line = keys.ravel(), np.repeat(ids, BANDS)
    order = np.argsort(key)
    key, line = key[order], line[order]
    cut = np.searchsorted(key >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
    rows = [(b, line[cut[b] : cut[b + 1]].tobytes(), (key[cut[b] : cut[b + 1]] >> U64(32 - bits)).astype(U32).tobytes()) for b in range(1 << bits) if cut[b + 1] > cut[b]]
    return pd.DataFrame(rows, columns=["bucket", "ids", "keys"])


def _scan(source: DataFrame, bits: int) -> DataFrame:
    """One map: occurrences (row, doc_id, line, place) of all lines, and the dealt bands (bucket, ids, keys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row", "doc_id", "line", "place", "bucket", "ids", "keys"]
        kinds = {"row": "Int64", "doc_id": "Int64", "line": "Int64", "place": "Int32", "bucket": "Int32"}
        seen: set[int] = set()
        held_ids, held_keys, held = [], [], 0

        def flush() -> pd.DataFrame:
            return _deal(np.concatenate(held_ids), np.concatenate(held_keys), bits).reindex(columns=columns).astype(kinds)

        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            row, doc = pdf["row"].to_numpy(np.int64), pdf["doc_id"].astype("Int64")
            for a, b in runs(texts):
                lines = Lines(texts[a:b])
                ids = lines.ids()
                full = np.flatnonzero(lines.filled)
                owner = lines.text[full] + a
                yield pd.DataFrame({"row": row[owner], "doc_id": doc.iloc[owner].to_numpy(), "line": ids[full], "place": lines.place[full]}).reindex(columns=columns).astype(kinds)
                _, first = np.unique(ids[full], return_index=True)
                new = [k for k in full[first].tolist() if int(ids[k]) not in seen]
                if not new:
                    continue
                new = np.array(new)
                seen.update(ids[new].tolist())
                seen = seen if len(seen) < 1_000_000 else set()
                held_ids.append(ids[new])
                held_keys.append(band_keys(*lines.shingles(new)))
                held += len(new)
                if held >= FLUSH:
                    yield flush()
                    held_ids, held_keys, held = [], [], 0
        if held:
            yield flush()
        held_ids, held_keys = [], []
        give_back()

    return source.mapInPandas(run, "row long, doc_id long, line long, place int, bucket int, ids binary, keys binary")


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of bands: each line with the least line of any band that it shares."""
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    keys = np.concatenate([np.frombuffer(x, U32) for x in pdf["keys"]])
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    pivot, many = np.repeat(ids[first], size), np.repeat(size > 1, size)
    pair = np.unique(np.stack([pivot[many], ids[many]], 1), axis=0) if many.any() else np.empty((0, 2), np.int64)
    alone = np.unique(pair[pair[:, 0] != pair[:, 1], 0])
    pair = pair[np.isin(pair[:, 0], alone)]
    return pd.DataFrame({"pivot": pair[:, 0], "sid": pair[:, 1]})


def _probes(ids: np.ndarray, power: int) -> np.ndarray:
    h = mix64(ids.view(U64) ^ U64(0xA24BAED4963EE407))
    return np.stack([(h * U64(2 * k + 1) + U64(k)) >> U64(64 - power) for k in range(PROBES)], 1).astype(np.int64)


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the longs in `ids` as packed bits: as many as their number calls for, within bounds."""
    power = min(max((PER_LINE * ids.count()).bit_length(), FEWEST), WIDEST)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(_probes(pdf.iloc[:, 0].to_numpy(np.int64), power))
            part = at // SEGMENT
            cut = np.searchsorted(part, np.unique(part))
            yield pd.DataFrame([(int(p[0] // SEGMENT), (p % SEGMENT).astype(U32).tobytes()) for p in np.split(at, cut[1:]) if len(p)], columns=["segment", "bits"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(SEGMENT, bool)
        for x in pdf["bits"]:
            flags[np.frombuffer(x, U32)] = True
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros((1 << power) // 8, np.uint8)
    for row in ids.mapInPandas(probe, "segment int, bits binary").groupBy("segment").applyInPandas(unite, "segment int, bits binary").toLocalIterator():
        at = row["segment"] * SEGMENT // 8
        out[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _held(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _probes(ids, (8 * len(flags)).bit_length() - 1)
    return ((flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _texts(source: DataFrame, flags: np.ndarray) -> DataFrame:
    """(sid, line) of the lines that the filter lets through, once a task."""
    shared = source.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in runs(texts):
                lines = Lines(texts[a:b])
                ids = lines.ids()
                full = np.flatnonzero(lines.filled)
                full = full[_held(shared.value, ids[full])]
                sids, found = [], []
                for k in full.tolist():
                    if (sid := int(ids[k])) not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        found.append(lines.joined[lines.begin[k] : lines.end[k]])
                seen = seen if len(seen) < 1_000_000 else set()
                if sids:
                    yield pd.DataFrame({"sid": sids, "line": found})
        give_back()

    return source.select("text").mapInPandas(run, "sid long, line string")


def _verify(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the tiles of one bin by exact Jaccard similarity."""
    _, first, which = np.unique(pdf["sid"].to_numpy(np.int64), return_index=True, return_inverse=True)
    texts = pdf["line"].to_numpy()[first].tolist()
    sets: list[np.ndarray] = []
    for a, b in runs(texts):
        lines = Lines(texts[a:b])
        hashes, at = lines.shingles(np.arange(b - a))
        sets.extend(np.unique(hashes[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    sizes = np.fromiter(map(len, sets), np.float64, len(sets))

    def pairs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = which[place]
        n = sizes[here]
        if len(here) > 2:
            return overlap_links(n, [sets[k] for k in here], percent)
        none = np.empty(0, np.int64)
        if 100 * min(n) < percent * max(n):
            return none, none
        one, two = sets[here[0]], sets[here[1]]
        at = np.searchsorted(one, two)
        both = np.count_nonzero(one[np.minimum(at, len(one) - 1)] == two)
        return (np.array([0]), np.array([1])) if 100 * both >= percent * (n[0] + n[1] - both) else (none, none)

    return linked_tiles(pdf, pairs)


def dedup_lines(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = 256) -> DataFrame:
    """`docs` with the lines removed that repeat, exactly or nearly, an earlier line of any document.

    All columns of `docs` are kept, `text_col` with the lines that stay, and `n_lines` and `n_dropped` (non-blank lines
    and how many of them went) added or replaced. Earlier is by (id, null last; a hash of the row; position). Blank lines
    stay. Null text stays null with counts 0, as does empty text. Rows equal in id and text keep the same lines: they
    are one document stored twice. An empty table gives no rows; other columns pass through, whatever their names.
    """
    spark = bounded_batches(docs)
    bits = max(1, (shuffle_width(spark) - 1).bit_length() - 1)
    row = F.xxhash64(docs[id_col], docs[text_col])
    source = docs.select(row.alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = durable(_scan(source, bits), "lines")
    occurs = found.where("bucket IS NULL").select("row", "doc_id", "line", "place")
    blocks = durable(found.where("bucket IS NOT NULL").select("bucket", "ids", "keys").groupBy("bucket").applyInPandas(_meet, "pivot long, sid long").distinct(), "meet")
    texts = durable(_texts(source, bloom(blocks.select("sid").distinct())).groupBy("sid").agg(F.first("line").alias("line")), "texts")
    edges = linked_blocks(blocks, texts, lambda pdf: _verify(pdf, percent), tile, 4 * shuffle_width(spark))
    united = components(edges, contracted=True)
    release(blocks, texts)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "place"))
    lines = occurs.groupBy("line").agg(first.alias("first"), F.count("*").alias("c"))
    several = lines.join(united, lines["line"] == united["id"], "left").where("c > 1 OR component IS NOT NULL")
    several = durable(several.select("line", "first", "c", F.coalesce("component", "line").alias("component")), "several")
    total, number = several.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    kept = several.groupBy("component").agg(F.min("first").alias("kept"), F.count("*").alias("n"))
    goes = hot_join(several, kept, "component", "n", number).select("line", "c", F.col("kept.row").alias("kept_row"), F.col("kept.place").alias("kept_place"))
    drops = hot_join(occurs, goes, "line", "c", total).where("row <> kept_row OR place <> kept_place").groupBy("row").agg(F.array_sort(F.collect_set("place")).alias("drop"))
    (key,) = unused(docs, "row")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.withColumn(key, row).toDF(*names.values(), "key").join(drops, F.col("key") == F.col("row"), "left")
    text, drop = F.col(names[text_col]), F.col("drop")
    counts = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x00-\x20]"))))
    # What lies between two dropped places stays; the text is split once, in a column of its own.
    after = lambda j: F.when(j == 0, 0).otherwise(F.get(drop, j - 1) + 1)
    upto = lambda j: F.coalesce(F.get(drop, j), F.size("lines"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda j: F.slice("lines", after(j) + 1, F.greatest(upto(j) - after(j), F.lit(0)))))
    rows = rows.withColumn("lines", F.when(drop.isNotNull(), F.split(text, "\n")))
    out = {c: F.col(names[c]) for c in docs.columns if c not in ("n_lines", "n_dropped")} | {"n_lines": counts.cast("int"), "n_dropped": F.when(drop.isNull(), 0).otherwise(F.size(drop))}
    out[text_col] = F.when(drop.isNull(), text).otherwise(F.array_join(left, "\n"))
    return rows.select(*[out[c].alias(c) for c in (*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns))])
