"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

Texts become sets of shingle hashes; equal sets share one id (a digest), so copies are one row of the
incidence matrix. The product is never formed whole:

1. columns: incidences go to buckets by hash; each bucket drops the columns with one row, which no overlap can contain,
   and counts the rows of the others. Columns that a sketch of fixed size shows to be hot don't go to a bucket, where
   all their rows would meet: they come last in the order of columns, and need no count;
2. rows: by size-derived bound, two sets of Jaccard t share at least ceil(t * n) of either's n shingles,
   so among the n - ceil(t * n) + 1 rarest columns of each (in one order for all) there is a shared one.
   A set with that many columns of its own links with nothing and is dropped here;
3. blocks: rows that share such a rare column meet in the block of the least row among them, the pivot. A block is dealt
   over tiles, each with the pivot; a tile multiplies its part of the incidence matrix by its transpose, accumulating
   overlap counts, and links what reaches the bound. Rows that the links of their tile unite with the pivot are done:
   they are one component. The others, few where a block is a group of near copies, are multiplied with the
   whole block in further tiles;
4. links are united to components.

Every pair at or above the threshold is compared in some tile or united without: the join is exact up to collisions of
hashes. A shingle is known by 32 bits and its bucket's (7 at 128 buckets), so a pair of sets of m and n shingles counts
one too many with probability m * n / 2 ** 39; a set is known by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from . import sketch as sk
from .components import components, forest
from .hashing import digest, mix64, shingle_sets
from .storage import bounded_batches, durable, give_back, hot_join, release, shuffle_width, unused

U16, U32, U64 = np.uint16, np.uint32, np.uint64
#: Incidences that a map task gathers before it deals them to buckets.
FLUSH = 600_000
#: A bucket's columns are counted in so many slices, a power of two.
SLICES = 8
#: Columns multiplied at a time, cells of the product and of its factor held at a time, rows of the largest tiles.
STRIP, CELLS, WIDEST = 4096, 1 << 20, 2048
#: A column with this share of all incidences is hot, however many buckets there are: the sketch can tell so many apart.
#: One below it adds less than half a bucket to a bucket of 2^14.
MOST_HOT = 1 << 15


def _packed(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _headers(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a sorted array: their values and 16-bit lengths; a longer run becomes several."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.diff(np.concatenate([first, [len(owner)]]))
    if size.max() > 65535:
        more = (size - 1) // 65535 + 1
        last = np.cumsum(more) - 1
        whole = np.full(more.sum(), 65535)
        whole[last] = size - (more - 1) * 65535
        return np.repeat(owner[first], more), whole
    return owner[first], size


#: Stands for the bucket of hot columns, whose rows go straight to where the rows are put together.
HOT = -1


def _deal(ids: list[int], sets: list[np.ndarray], bits: int, hot: np.ndarray) -> pd.DataFrame:
    """Rows (bucket, ids, counts, keys) that hold the incidences of `sets`; a bucket is a key's upper bits.

    Incidences in hot columns have a bucket for each share of the rows, above the others.
    """
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), counts)
    sid = np.array(ids, np.int64)
    common = sk.marked(hot, keys)
    rows = []
    for some, width, bucket in ((~common, U32, keys >> U64(64 - bits)), (common, U64, (_dest(sid, bits) + (1 << bits))[owner])):
        place = bucket[some].astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, who, key = place[order], owner[some][order], (keys[some][order] >> U64(32 - bits)).astype(width)
        cut = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)] if len(place) else [0]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            at, n = _headers(who[s:e])
            rows.append((int(place[s]), _packed(sid[at], np.int64), _packed(n, U16), key[s:e].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "ids", "counts", "keys"])


def survey(docs: DataFrame, width: int) -> DataFrame:
    """One map over the texts: rows (doc_id, sid, n) of every document's set, and those of a sketch of all columns (part, data, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, total, held, size = np.zeros(sk.CELLS, np.int64), 0, [], 0
        seen: set[int] = set()
        for pdf in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in pdf["text"]]
            sids, sizes = [], []
            for known, keys in zip(pdf["doc_id"].notna(), shingle_sets(texts, width), strict=True):
                sid = digest(keys)
                sids.append(sid)
                sizes.append(len(keys))
                if len(keys) and known and sid not in seen:
                    seen.add(sid)
                    held.append(keys)
                    size += len(keys)
                if size > 200_000:
                    sk.add(sketch, np.concatenate(held))
                    total, held, size = total + size, [], 0
            seen = seen if len(seen) < 1_000_000 else set()
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "sid": pd.array(sids, "Int64"), "n": sizes, "part": pd.array([None] * len(sids), "Int32"), "data": None})
        if size:
            sk.add(sketch, np.concatenate(held))
        rows = pd.DataFrame([(k, d, 0) for k, d in sk.parts(sketch)] + [(0, b"", total + size)], columns=["part", "data", "n"])
        yield rows.reindex(columns=["doc_id", "sid", "n", "part", "data"]).astype({"doc_id": "Int64", "sid": "Int64", "part": "Int32"})
        give_back()

    return docs.mapInPandas(run, "doc_id long, sid long, n long, part int, data binary")


def incidences(docs: DataFrame, width: int, bits: int, hot: np.ndarray) -> DataFrame:
    """One map over the texts: rows (bucket, ids, counts, keys) of the incidences of distinct sets, a set once a task."""
    flags = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for pdf in batches:
            for keys in shingle_sets([t.encode() if isinstance(t, str) else b"" for t in pdf["text"]], width):
                sid = digest(keys)
                if len(keys) and sid not in seen:
                    seen.add(sid)
                    ids.append(sid)
                    sets.append(keys)
                    held += len(keys)
                    if held >= FLUSH:
                        yield _deal(ids, sets, bits, flags.value)
                        ids, sets, held = [], [], 0
                        seen = seen if len(seen) < 1_000_000 else set()
        if sets:
            yield _deal(ids, sets, bits, flags.value)
        sets = []
        give_back()

    return docs.where("doc_id IS NOT NULL").select("text").mapInPandas(run, "bucket int, ids binary, counts binary, keys binary")


def _columns(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """A bucket: keep the columns that at least two rows share, with classes of their counts, and deal them by row.

    Incidences in hot columns pass through. Any one order of columns will do, so an eighth of a doubling is a class.
    """
    src = int(pdf["bucket"].iloc[0])
    if src >= 1 << bits:
        return pd.DataFrame({"dest": src - (1 << bits), "bucket": HOT, "ids": pdf["ids"], "counts": pdf["counts"], "keys": pdf["keys"], "dfs": b""})
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    counts = np.concatenate([np.frombuffer(x, U16) for x in pdf["counts"]])
    keys = np.concatenate([np.frombuffer(x, U32) for x in pdf["keys"]])
    del pdf
    nodes, at = np.unique(ids, return_inverse=True)
    owner = np.repeat(at.astype(U32), counts)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in range(SLICES):  # a slice of the columns at a time bounds what is held
        here = keys >> U32(32 - SLICES.bit_length() + 1) == part
        cells = np.unique(keys[here].astype(U64) << U64(32) | owner[here])
        if not len(cells):
            continue
        key = (cells >> U64(32)).astype(U32)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        keep = np.repeat(size > 1, size)
        kept.append((key[keep], np.repeat(8 * np.log2(size), size)[keep].astype(np.uint8), (cells[keep] & U64(0xFFFFFFFF)).astype(U32)))
    del keys, owner
    rows = []
    if kept:
        key, df, owner = (np.concatenate(x) for x in zip(*kept, strict=True))
        dest = _dest(nodes, bits)[owner]
        order = np.lexsort((owner, dest))
        key, df, owner, dest = key[order], df[order], owner[order], dest[order]
        cut = np.searchsorted(dest, np.arange((1 << bits) + 1))
        for d in range(1 << bits):
            s, e = cut[d], cut[d + 1]
            if e > s:
                who, n = _headers(owner[s:e])
                rows.append((d, src, _packed(nodes[who], np.int64), _packed(n, U16), _packed(key[s:e], U32), df[s:e].tobytes()))
    return pd.DataFrame(rows, columns=["dest", "bucket", "ids", "counts", "keys", "dfs"])


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of 32 + `bits` bits: as many bytes each as that takes, whatever the number of buckets."""
    return packed.pack_keys(keys, (bits + 39) // 8)


def unpack_keys(data: bytes, bits: int) -> np.ndarray:
    return packed.unpack_keys(data, (bits + 39) // 8)


def _dest(sids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(sids.view(U64)) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sids), np.int64)


def _rows(pdf: pd.DataFrame, bits: int, percent: int) -> pd.DataFrame:
    """A share of the rows: those that may link, with their shared columns and the rare ones among these."""
    sized = pdf[pdf["bucket"].isna()]
    size_of = dict(zip(np.concatenate([np.frombuffer(x, np.int64) for x in sized["ids"]]).tolist(), np.concatenate([np.frombuffer(x, U32) for x in sized["counts"]]).tolist(), strict=True)) if len(sized) else {}
    part = pdf[pdf["bucket"].notna()]
    out = []
    if len(part):
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in part["ids"]])
        counts = np.concatenate([np.frombuffer(x, U16) for x in part["counts"]])
        keys = np.concatenate([np.frombuffer(x, U64) if b == HOT else np.frombuffer(x, U32).astype(U64) | U64(int(b) << 32) for b, x in zip(part["bucket"], part["keys"], strict=True)])
        dfs = np.concatenate([np.full(len(x) // 8, 255, np.uint8) if b == HOT else np.frombuffer(d, np.uint8) for b, x, d in zip(part["bucket"], part["keys"], part["dfs"], strict=True)])
        nodes, at = np.unique(ids, return_inverse=True)
        owner = np.repeat(at, counts)
        order = np.lexsort((keys, dfs, owner))
        keys, owner = keys[order], owner[order]
        cut = np.searchsorted(owner, np.arange(len(nodes) + 1))
        for i, sid in enumerate(nodes.tolist()):
            n, own = size_of[sid], keys[cut[i] : cut[i + 1]]
            rare = n - (percent * n + 99) // 100 + 1 - (n - len(own))
            if rare > 0:
                out.append((sid, n, pack_keys(np.sort(own), bits), own[:rare].view(np.int64)))
    return pd.DataFrame(out, columns=["sid", "n", "keys", "rare"])


def overlap_links(n: np.ndarray, keys: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows with 100 * overlap >= percent * union, by the product of the incidence matrix.

    Columns with one row are left out; the others are multiplied a strip at a time, for some rows at a time.
    """
    m = len(keys)
    flat, col = np.unique(np.concatenate(keys), return_inverse=True)
    row = np.repeat(np.arange(m), [len(k) for k in keys])
    times = np.bincount(col, minlength=len(flat))
    live = times > 1
    place = np.cumsum(live) - 1
    use = live[col]
    row, col = row[use], place[col[use]]
    width = int(live.sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = max(64, min(STRIP, CELLS // m))
    high = max(1, min(m, CELLS // m))
    src, dst = [], []
    for top in range(0, m, high):
        overlap = np.zeros((min(high, m - top), m - top), np.float32)
        for s in range(0, width, step):
            a, b = np.searchsorted(col, (s, s + step))
            strip = np.zeros((m - top, min(step, width - s)), np.float32)
            below = row[a:b] >= top
            strip[row[a:b][below] - top, col[a:b][below] - s] = 1
            overlap += strip[: len(overlap)] @ strip.T
        union = n[top : top + high, None] + n[None, top:] - overlap
        i, j = np.nonzero(np.triu(100 * overlap.astype(np.float64) >= percent * union.astype(np.float64), 1))
        src.append(i + top)
        dst.append(j + top)
    return np.concatenate(src), np.concatenate(dst)


def linked_tiles(pdf: pd.DataFrame, pairs: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Links of the tiles in one bin, as a forest that spans them; of open tiles also the rows (src, pivot) left to compare.

    `pairs` gives the linked pairs among the rows with the given places in `pdf`.
    """
    src, dst, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    if len(pdf):
        pdf = pdf.sort_values(["pivot", "a", "b", "sid"], kind="stable")
        tile, sid, place = pdf[["pivot", "a", "b"]].to_numpy(np.int64), pdf["sid"].to_numpy(np.int64), pdf.index.to_numpy()
        cut = [0, *(np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1).tolist(), len(tile)]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            new = np.flatnonzero(np.concatenate([[True], sid[s + 1 : e] != sid[s : e - 1]])) + s
            own, pivot = sid[new], tile[s, 0]
            i, j = pairs(place[new]) if len(new) > 1 else ((), ())
            x, y = forest(own[list(i)], own[list(j)])
            src.append(x)
            dst.append(y)
            if tile[s, 1] == tile[s, 2] == OPEN:
                with_pivot = np.unique(np.concatenate([[pivot], y[x == pivot]]))  # the pivot is no more than its root
                done = np.isin(own, x[np.isin(y, with_pivot)]) | np.isin(own, with_pivot)
                left.append((own[~done], np.full((~done).sum(), pivot)))
    x, y = forest(np.concatenate(src), np.concatenate(dst))
    give_back()
    found = pd.DataFrame({"src": x, "dst": y}).astype("Int64")
    return pd.concat([found, *(pd.DataFrame({"src": u, "pivot": p}).astype("Int64") for u, p in left if len(u))]).reindex(columns=["src", "dst", "pivot"]).astype("Int64")


#: Stands for a and b of a tile whose block has others.
OPEN = -1


def linked_blocks(blocks: DataFrame, rows: DataFrame, verify: Callable[[pd.DataFrame], pd.DataFrame], tile: int, bins: int) -> DataFrame:
    """Edges (src, dst) that span all links within the blocks (pivot, sid), each pivot being the least row of its own.

    `rows` (sid and what `verify` needs) are joined to the tiles' rows (pivot, a, b, sid); `verify` calls
    `linked_tiles`. Of a block that is more than one tile, rows that aren't united with the pivot in their first tile
    are compared with all rows of the block. These tiles grow with the block, up to `WIDEST` rows, so that a row is in
    eight of them at most and the rows dealt grow with the block's size, not its square; of blocks above twice `WIDEST`
    rows, a row is in as many as the block is wide. Both tables should be written ones, as they are read twice.
    """
    total = blocks.count()
    sizes = blocks.groupBy("pivot").agg(F.count("*").alias("members")).where("members > 1")
    known = hot_join(blocks, sizes, "pivot", "members", total).withColumn("parts", F.ceil(F.col("members") / tile))
    part = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), n).cast("int")
    binned = lambda df: df.withColumn("bin", F.pmod(F.xxhash64("pivot", "part", "a", "b"), F.lit(bins)).cast("int"))
    mine = F.when(F.col("sid") == F.col("pivot"), F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).otherwise(F.array(part(F.col("parts"), 3)))
    first = known.select("pivot", "sid", "parts", F.explode(mine).alias("part"))
    mark = F.when(F.col("parts") > 1, F.lit(OPEN)).otherwise(F.lit(0))
    first = binned(first.select("pivot", "sid", "part", mark.alias("a"), mark.alias("b")))
    schema = "src long, dst long, pivot long"
    done = durable(_by_part(first, rows, verify, schema), "tiles")
    left = done.where("pivot IS NOT NULL").select("pivot", F.col("src").alias("sid")).distinct()
    edges = done.where("dst IS NOT NULL").select("src", "dst")
    if left.isEmpty():
        return edges
    open_blocks = left.groupBy("pivot").agg(F.count("*").alias("open"))
    side = F.least(F.greatest(F.ceil(F.col("members") / 2), F.lit(tile)), F.lit(max(tile, WIDEST)))
    cut = F.ceil(F.col("members") * 2 / side), F.ceil(F.col("open") * 2 / side)
    known = hot_join(blocks, sizes.join(open_blocks, "pivot"), "pivot", "members", total).withColumns({"wide": cut[0], "tall": cut[1]})
    asked = hot_join(left, sizes.join(open_blocks, "pivot"), "pivot", "open", total).withColumns({"wide": cut[0], "tall": cut[1]})
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    second = known.select("pivot", "sid", every(F.col("tall")).alias("a"), part(F.col("wide"), 5).alias("b")).union(asked.select("pivot", "sid", part(F.col("tall"), 4), every(F.col("wide"))))
    more = _by_part(binned(second.withColumn("part", F.lit(0))), rows, verify, schema)
    return edges.union(more.where("dst IS NOT NULL").select("src", "dst"))


def _by_part(dealt: DataFrame, rows: DataFrame, verify: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Tiles of a bin together, the parts of a block kept apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [verify(x.drop(columns="part").reset_index(drop=True)) for _, x in pdf.groupby("part", sort=False)]
        return pd.concat(found) if found else pd.DataFrame({"src": [], "dst": [], "pivot": []}, dtype="Int64")

    return dealt.join(rows, "sid").groupBy("bin").applyInPandas(run, schema)


def link_sets(cand: DataFrame, percent: int, tile: int, bins: int, bits: int) -> DataFrame:
    """Edges (src, dst) between candidate sets (sid, n, keys, rare) that span all links at the threshold."""
    posts = cand.select("sid", F.explode("rare").alias("key"))
    heads = posts.groupBy("key").agg(F.min("sid").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    blocks = durable(hot_join(posts, heads, "key", "c", posts.count()).select("pivot", "sid").distinct(), "blocks")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        n, keys = pdf["n"].to_numpy(np.float64), pdf["keys"].to_numpy()
        return linked_tiles(pdf, lambda at: overlap_links(n[at], [unpack_keys(keys[k], bits) for k in at.tolist()], percent))

    return linked_blocks(blocks, cand.select("sid", "n", "keys"), verify, tile, bins)


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    A-Z count as a-z; words are runs of non-white-space; a set holds the distinct `width`-word shingles, or the
    whole sequence where there are fewer words. Sets link when 100 * intersection >= percent * union.
    component_id is the least id reachable by links, its own included. Null or blank text: n_shingles 0, linked
    with nothing. Rows that share an id are one node. A row without an id links with nothing: component_id null.
    Equal rows stay repeated; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = bounded_batches(docs)
    bits = max(1, (shuffle_width(spark) - 1).bit_length() - 1)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = durable(survey(source, width), "sets")
    info = found.where("part IS NULL").select("doc_id", "sid", "n")
    hot = sk.hot_flags(found.where("part IS NOT NULL"), min(16 << bits, MOST_HOT))
    kinds = "dest int, bucket int, ids binary, counts binary, keys binary, dfs binary"
    shared = incidences(source, width, bits, hot).groupBy("bucket").applyInPandas(lambda pdf: _columns(pdf, bits), kinds)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates("sid")
            sid, n = pdf["sid"].to_numpy(np.int64), pdf["n"].to_numpy(U32)
            dest = _dest(sid, bits)
            rows = [(int(d), None, _packed(sid[dest == d], np.int64), _packed(n[dest == d], U32), None, None) for d in np.unique(dest)]
            yield pd.DataFrame(rows, columns=["dest", "bucket", "ids", "counts", "keys", "dfs"]).astype({"bucket": "Int32"})

    sized = info.where("n > 0 AND doc_id IS NOT NULL").select("sid", "n").mapInPandas(sizes, kinds)
    cand = durable(shared.union(sized).groupBy("dest").applyInPandas(lambda pdf: _rows(pdf, bits, percent), "sid long, n long, keys binary, rare array<long>"), "candidates")
    edges = durable(link_sets(cand, percent, tile, 4 * shuffle_width(spark), bits), "links")
    rows = info.where("n > 0 AND doc_id IS NOT NULL")
    copies = durable(rows.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")), "copies")
    several = rows.groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("doc_id")
    by_id = several.join(rows, "doc_id").join(copies, "sid").select(F.col("doc_id").alias("src"), F.col("least").alias("dst"))
    roots = edges.groupBy("dst").agg(F.count("*").alias("n")).join(copies.select(F.col("sid").alias("dst"), F.col("least").alias("d")), "dst")
    ends = hot_join(edges, roots, "dst", "n", edges.count()).join(copies.select(F.col("sid").alias("src"), F.col("least").alias("s")), "src")
    united = components(ends.select(F.col("s").alias("src"), F.col("d").alias("dst")).union(by_id), contracted=True)
    release(cand)
    sets = copies.join(united, copies["least"] == united["id"], "left").select("sid", F.coalesce("component", "least").alias("component_id"), "c")
    named = hot_join(rows, sets, "sid", "c", info.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.union(info.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of `docs` whose id is their component's: one document of each group of near duplicates.

    All columns are kept. Of rows that share an id one stays, that of the least hash of its columns, whatever the
    order of rows (columns of maps have no hash and don't count); rows without an id stay.
    """
    found = jaccard_components(docs, id_col=id_col, **options)
    hashed = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row, key = F.xxhash64(*hashed, *[c.isNull() for c in hashed]), docs[id_col].cast("long")
    first = docs.select(key.alias("id"), row.alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    kept = first.join(found.where("doc_id = component_id").select(F.col("doc_id").alias("of")), F.col("id") == F.col("of"), "left_semi")
    named = docs.join(kept, (key == kept["id"]) & (row == kept["row"]), "left_semi").dropDuplicates([id_col])
    return named.union(docs.where(docs[id_col].isNull()))


def one_of_each_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of `docs` without those whose text is, or by links is like, that of a row that stays.

    Rows are told apart by id and text: ids link nothing, a row without an id is one like others. Of a group that row
    stays whose id is least, nulls last, then by a hash of id and text; of rows equal in both, one. Rows with blank
    texts, linked with nothing, all stay but for equal ones. All columns are kept, whatever their names.
    """
    (key,) = unused(docs, "key")
    row = F.xxhash64(docs[id_col], docs[id_col].isNull(), docs[text_col], docs[text_col].isNull())
    keyed = docs.withColumn(key, row)
    found = durable(jaccard_components(keyed.select(F.col(key).alias("doc_id"), docs[text_col].alias("text")), **options).select("doc_id", "component_id").distinct(), "groups")
    names = docs.select(row.alias("of"), docs[id_col].cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "of")).alias("first")
    kept = found.join(names, F.col("doc_id") == F.col("of")).groupBy("component_id").agg(first).select(F.col("first.of").alias("kept_key"))
    return keyed.join(kept, F.col(key) == F.col("kept_key"), "left_semi").dropDuplicates([key]).select(*docs.columns)
