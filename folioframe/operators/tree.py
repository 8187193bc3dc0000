"""Trees of nodes and measures of documents, in columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written

#: Coverage below this makes a document doubtful.
COVERED = 0.97


def coverage(found: Column, stated: Column) -> Column:
    """Share of the stated characters that were found: 1 at most, 1 where there are none, null where nothing is stated."""
    return F.when(stated.isNull(), None).when(stated == 0, 1.0).otherwise(F.least(F.lit(1.0), found.cast("double") / stated))


#: Up to so many different levels, parents are found by a window for each level.
LEVELS = 16


def heading_parents(heads: DataFrame, *, key: str, order: str, level: str) -> DataFrame:
    """Each heading with the nearest one before it of a smaller level, as column parent (null: none, or no level).

    With levels of 1 to LEVELS, that is the latest of the last headings of each smaller level: one sort a document, no
    join, no look at the data. Headings of a document with other levels are taken in order, with a stack of those open.
    """
    plain = F.col(level).between(1, LEVELS) | F.col(level).isNull()
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = F.array(*[F.last(F.when(F.col(level) == lv, F.col(order)), ignorenulls=True).over(before) for lv in range(1, LEVELS)])
    least = F.array_max(F.slice(last, 1, F.greatest(F.least(F.col(level), F.lit(LEVELS)) - 1, F.lit(0)).cast("int")))
    every = heads.withColumn("__odd", F.max(~plain).over(W.partitionBy(key)))
    near = every.where(~F.col("__odd")).drop("__odd").withColumn("parent", F.when(F.col(level).isNotNull(), least))
    odd = every.where("__odd").drop("__odd")
    kind = heads.schema[order].dataType.simpleString()

    def stacked(pdf: pd.DataFrame) -> pd.DataFrame:
        out, open_ = [], []
        for at, lv in pdf.sort_values("at", kind="stable")[["at", "level"]].itertuples(index=False):
            while open_ and not pd.isna(lv) and open_[-1][0] >= lv:
                open_.pop()
            out.append((pdf["key"].iloc[0], at, open_[-1][1] if open_ and not pd.isna(lv) else None))
            if not pd.isna(lv):
                open_.append((lv, at))
        return pd.DataFrame({"k": [r[0] for r in out], "o": [r[1] for r in out], "parent": pd.Series([r[2] for r in out], dtype=object)})

    found = odd.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(level).alias("level")).groupBy("key").applyInPandas(stacked, f"k {heads.schema[key].dataType.simpleString()}, o {kind}, parent {kind}")
    joined = odd.join(found, F.col(key).eqNullSafe(F.col("k")) & (F.col(order) == F.col("o"))).drop("k", "o")
    return near.unionByName(joined)


def chains(nodes: DataFrame, *, id_col: str, parent_col: str, label_col: str) -> DataFrame:
    """(id, ids, labels): the path from the root to each node; pointers to nowhere end a path, circles are cut.

    Paths double in length with each join, so a tree of depth d takes log2(d) rounds. They go on until no path has
    anything above it; from 8 levels on, each round is written to the shared folder, as plans would double too.
    """
    rows = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.array(id_col).alias("ids"), F.array(label_col).alias("labels"))
    reach = 1
    while True:
        above = rows.select(F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("ids").alias("__ids"), F.col("labels").alias("__labels"))
        joined = rows.join(above, rows["up"] == above["__id"], "left")
        fresh = F.col("__id").isNotNull() & ~F.arrays_overlap("ids", F.coalesce("__ids", F.slice("ids", 1, 0)))
        rows = joined.select(
            "id", F.when(fresh, F.col("__up")).alias("up"),
            F.when(fresh, F.concat("__ids", "ids")).otherwise(F.col("ids")).alias("ids"), F.when(fresh, F.concat("__labels", "labels")).otherwise(F.col("labels")).alias("labels"),
        )
        reach *= 2
        if reach >= 4 and rows.where("up IS NOT NULL").isEmpty():
            return rows.select("id", "ids", "labels")
        if reach >= 8:
            rows = written(rows, "chains")


def vote(rows: DataFrame, *, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equals the one whose first row comes first."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value))


def document_status(docs: DataFrame, warned: DataFrame, *, key: str, degraded: str, coverage: str) -> DataFrame:
    """ok, or warning where pages were degraded, too little text was found, or a warning is on record."""
    marks = warned.select(F.col(key).alias("__warned")).distinct()
    status = F.when(F.coalesce(degraded, F.lit(0)) > 0, "warning").when(F.coalesce(coverage, F.lit(1.0)) < COVERED, "warning").when(F.col("__warned").isNotNull(), "warning").otherwise("ok")
    return docs.join(marks, docs[key] == marks["__warned"], "left").withColumn("status", status).drop("__warned")


def page_metrics(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages, pages read by OCR, nodes, and table confidence by document."""
    pages = F.explode_outer("pages").alias("page")
    rows = nodes.select(key, "id", "type", F.coalesce("content.ocr", F.lit(False)).alias("ocr"), pages)
    return rows.groupBy(key).agg(
        F.coalesce(F.max("page"), F.lit(0)).alias("pages"), F.countDistinct(F.when(F.col("ocr"), F.col("page"))).alias("ocr_pages"), F.countDistinct("id").alias("nodes"),
        F.max(F.when(F.col("type").isin("table", "sheet_region"), 1.0)).alias("table_confidence"),
    )


def type_counts(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return nodes.groupBy(key, "type").agg(F.count("*").alias("nodes"))


def numerator(content: Column) -> Column:
    """Visible characters of all text in a node's content."""
    from ..functions.text import visible_chars

    texts = sum((visible_chars(content[f]) for f in ("text", "title", "notes", "caption", "ocr_text", "name")), F.lit(0).cast("long"))
    cells = F.coalesce(F.aggregate(content["cells"], F.lit(0).cast("long"), lambda a, c: a + visible_chars(c["text"])), F.lit(0).cast("long"))
    return texts + cells


def low_confidence_chunks(chunks: DataFrame, nodes: DataFrame, below: float = 0.6) -> DataFrame:
    """Chunks that hold a node read with low confidence."""
    low = nodes.where(F.col("confidence") < below).select(F.col("doc_id").alias("__doc"), F.col("id").alias("__node")).distinct()
    named = chunks.select("id", "doc_id", F.explode("node_ids").alias("node"))
    hit = named.join(low, (named["doc_id"] == low["__doc"]) & (named["node"] == low["__node"]), "left_semi").select(F.col("id").alias("__id")).distinct()
    return chunks.join(hit, chunks["id"] == hit["__id"], "left_semi")


def first_chunk_of_node(chunks: DataFrame) -> DataFrame:
    """(doc_id, node, chunk_id): the first chunk of each node."""
    return chunks.select("doc_id", F.explode("node_ids").alias("node"), "seq", "id").groupBy("doc_id", "node").agg(F.min_by("id", "seq").alias("chunk_id"))
