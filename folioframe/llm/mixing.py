"""Mixing sources to target weights, with DataFrame functions only.

Efraimidis-Spirakis sampling: each document gets the exponential key -ln(u) / w, u from a hash of
seed and id and w its quality weight; within a source, smaller keys come first. Complete epochs of
a source precede the fractional selection, which takes documents in key order until the prefix sum
of their sizes reaches the rest of the source's token budget.

The prefix sum never puts a source in one task: keys map monotonically to buckets of about `bucket_rows`
documents by the distribution function of a source's keys, which its weights determine; bucket totals are
summed first, and only one bucket is sorted at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import durable, unused

WORD = r"[^\x20\x09-\x0D]+"
#: 2 ** 52, so that 13 hex digits give a double exactly.
SCALE = 4503599627370496.0


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1], the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 1.0) / F.lit(SCALE)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Targets by source from (source, source_size, n_docs): one row per source.

    Sources in code-point order, null last, take the weights in turn. All sizes together are shared
    by weight; a source stops at `max_epochs` times its size, and the excess is shared again by weight
    until no source is above: with sources by ascending cap / weight, the common level is the first
    (total - caps before) / (weights from here) that does not exceed the source's own cap / weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int") + 1)
    cap = F.col("source_size") * max_epochs
    by_ratio = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(whole)["level"])
    )
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _taken(base: DataFrame, weights: tuple[float, ...], max_epochs: int, bucket_rows: int) -> DataFrame:
    """`base` (rid, doc_id, source, size, q, key) with source_size, target and copies.

    Rows equal in id, source, size and weight are one group with a number of members, so that however many there are
    they take one place in the order. At most one group of a source is taken in part; only its members are numbered.
    """
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(totals, weights, max_epochs)
    groups = base.groupBy("doc_id", "source", "size", "q", "key").agg(F.count("*").alias("m"))
    # Quarter-octave classes of weights: the least weight of a class gives an upper bound of the share beyond a key.
    floor_q = F.pow(F.lit(2.0), F.floor(F.log2("q") * 4) / 4)
    classes = base.groupBy("source", floor_q.alias("w")).agg(F.count("*").alias("n")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("classes"))
    known = targets.join(classes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    slots = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows))
    below = F.aggregate("classes", F.lit(0.0), lambda done, c: done + c["n"] * (1 - F.exp(-c["w"] * F.col("key")))) / F.col("n_docs")
    placed = groups.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.least(F.floor(below * slots), slots - 1)).drop("classes", "n_docs")
    words = F.col("size") * F.col("m")
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    offset = per_bucket.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    order = W.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.coalesce(F.sum(words).over(order), F.lit(0))
    fits = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).otherwise(F.when(left >= 0, F.col("m")).otherwise(0))
    more = F.when((F.col("epochs") < max_epochs) & (F.col("target") > F.col("epochs") * F.col("source_size")), F.least(F.greatest(fits, F.lit(0)), F.col("m"))).otherwise(0)
    counted = (
        placed.withColumn("epochs", epochs).join(offset, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select(F.col("doc_id").alias("g_id"), F.col("source").alias("g_source"), F.col("size").alias("g_size"), F.col("q").alias("g_q"), "source_size", "target", "epochs", more.cast("long").alias("more"), "m")
    )
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")) & (F.col("q") == F.col("g_q"))
    rows = base.join(counted, same).select("rid", "doc_id", "source", "size", "source_size", "target", "epochs", "more", "m")
    whole = rows.where("more = 0 OR more = m").withColumn("copies", F.col("epochs") + F.when(F.col("more") > 0, 1).otherwise(0))
    part = rows.where("more > 0 AND more < m").withColumn("slice", F.shiftright("rid", 20))
    before = part.groupBy("source", "slice").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.col("slice").alias("b"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.col("before") + F.row_number().over(W.partitionBy("source", "slice").orderBy("rid"))
    part = part.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("b"))).withColumn("copies", F.col("epochs") + F.when(turn <= F.col("more"), 1).otherwise(0))
    out = ("rid", "doc_id", "source", "size", "source_size", "target", "copies")
    return whole.select(*out).union(part.select(*out))


def _base(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (rid, doc_id, source, size, quality) written with their weights and keys."""
    q = F.coalesce(F.when((F.col("quality") > 0) & (F.col("quality") < float("inf")), F.col("quality").cast("double")), F.lit(1.0))
    return durable(rows.withColumn("q", q).drop("quality").withColumn("key", sampling_key(F.col("doc_id"), F.col("q"), seed)), "mix-base")


def mixed_rows(
    docs: DataFrame, *, qualities: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, bucket_rows: int = 2_000,
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, all columns kept, whatever their names.

    `qualities`: (id, quality), one row per id; documents without a row weigh 1. Each row is a document of its own,
    also where rows are equal: of equal rows as many are taken as the budget has room for. Null text: size 0; rows of
    size 0 come along where the order reaches them, and never more than `max_epochs` times. An empty table gives none.
    """
    (rid,) = unused(docs, "rid")
    rows = durable(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-rows")
    sized = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    if qualities is not None:
        sized = sized.join(qualities.toDF("labelled", "quality"), F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    else:
        sized = sized.withColumn("quality", F.lit(1.0))
    times = _taken(_base(sized, seed), weights, max_epochs, bucket_rows).where("copies > 0").select(F.col("rid").alias("of"), F.array_repeat(F.lit(True), F.col("copies").cast("int")).alias("turns"))
    names = {c: f"c{k}" for k, c in enumerate(rows.columns)}
    taken = rows.toDF(*names.values()).join(times, F.col(names[rid]) == F.col("of"))
    return taken.select(*[F.col(names[c]) for c in docs.columns], F.explode("turns")).drop("col").toDF(*docs.columns)


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, quality: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, bucket_rows: int = 2_000,
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one per row of `docs`.

    `size` defaults to the word count of `text`, `quality` (a positive weight) to 1. `copies` says how many times the
    mix takes the document, `taken` that many times its size: the complete epochs of its source, and once more
    where the source's fractional selection includes it. A document is included when the budget's end
    lies past its middle, so a source misses its target by at most half a document.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Null id: one key for all such rows,
    ties ordered by size. Equal rows are separate documents, of which the budget's end may take some. Null, infinite
    or non-positive quality: 1. Empty table: no rows. Other columns of `docs` are ignored, whatever their names.
    """
    size = word_count(F.col("text")) if size is None else size
    quality = F.lit(1.0) if quality is None else quality
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), quality.alias("quality"))
    out = _taken(_base(rows, seed), weights, max_epochs, bucket_rows)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
