"""Dashboard aggregates. Each is one scan and one partial aggregation, made dense by a small list of known values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Token bins, error texts.
TOKEN_BINS = (("0-128", 0, 128), ("128-256", 128, 256), ("256-512", 256, 512), ("512-1024", 512, 1024), (">=1024", 1024, None))
DOC_STATUS = ("imported", "parsing", "ok", "warning", "failed")
UNKNOWN_CODE = "E06"


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded half to even; null where whole is 0 or null."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def totals(docs: DataFrame, *, pages: str, degraded: str, measures: Sequence[str] = ()) -> DataFrame:
    """One row: rows, sums of pages and degraded pages (0 for none), and means of the measures (nulls skipped)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in ((pages, "pages_total"), (degraded, "degraded_pages"))]
    return docs.agg(F.count("*").alias("total"), *sums, *[F.avg(m).alias(f"avg_{m}") for m in measures])


def dense_counts(rows: DataFrame, key: str, known: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Rows by key for exactly the known keys, 0 where there are none; `extra` are further aggregates, 0 for null."""
    found = rows.where(F.col(key).isin(*known)).groupBy(key).agg(F.count("*").alias("count"), *extra)
    names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{key} string")
    filled = names.join(F.broadcast(found), key, "left")  # at most as many rows as known keys
    return filled.fillna(0)


def distribution(rows: DataFrame, key: str, recent: Column | None = None) -> DataFrame:
    """Rows by key, most first, then by key: count, and how many of them are recent."""
    return rows.groupBy(key).agg(F.count("*").alias("count"), F.count_if(F.lit(False) if recent is None else recent).alias("recent")).orderBy(F.desc("count"), key)


def token_histogram(chunks: DataFrame, tokens: str = "token_count") -> DataFrame:
    """Chunks by bin of token count; bins are half open, the last has no end, empty ones show 0."""
    t = F.col(tokens)
    bin_no = F.when(t < TOKEN_BINS[0][1], None)
    for k, (_, lo, hi) in enumerate(TOKEN_BINS):
        bin_no = bin_no.when((t >= lo) & (F.lit(True) if hi is None else t < hi), k)
    found = chunks.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("count"))
    bins = chunks.sparkSession.createDataFrame([(k, *b) for k, b in enumerate(TOKEN_BINS)], "bin int, bucket string, min int, max int")
    return bins.join(F.broadcast(found), "bin", "left").select("bucket", "min", "max", F.coalesce("count", F.lit(0)).alias("count"))


def top_documents(chunks: DataFrame, docs: DataFrame, *, key: str = "doc_id", name: str = "name", tokens: str = "token_count", k: int = 20) -> DataFrame:
    """The k documents with most chunks (ties by key), with their names: aggregated and cut before the join."""
    most = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")).orderBy(F.desc("chunks"), key).limit(k)
    found = docs.select(F.col(key).alias("__key"), name).join(F.broadcast(most.select(key)), F.col("__key") == F.col(key), "left_semi")  # k rows are sent, documents stay
    return most.join(F.broadcast(found), F.col(key) == F.col("__key"), "left").select(key, name, "chunks", "tokens")


def top_failures(events: DataFrame, messages: dict[str, str], *, level: str = "level", code: str = "code", k: int = 5) -> DataFrame:
    """The k most frequent error codes with their messages; events without a code count as unknown."""
    found = events.where(F.col(level) == "error").groupBy(F.coalesce(code, F.lit(UNKNOWN_CODE)).alias("code")).agg(F.count("*").alias("count"))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in messages.items() for x in kv]), F.col("code")) if messages else F.lit(None).cast("string")
    return found.orderBy(F.desc("count"), "code").limit(k).withColumn("message", F.coalesce(text, F.lit("发生未知错误")))


#: How far from the middle, of a sketch's accuracy, values are looked at; and cells in which they are counted.
ACCURACY, CELLS = 10_000, 4096


def exact_medians(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, median): the exact median of each group's values, nulls left out, in memory that doesn't grow with them.

    A sketch gives a bracket around the middle, whose error it bounds; values in the bracket are counted in cells, and
    only those of the cell or two with the middle ones are put in order. Three passes, no buffer of a group's values.
    """
    keys = [f"__k{k}" for k in range(len(by))]
    v = rows.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({k: f"{k}_" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
        return (left.join(right, on) if keys else left.crossJoin(F.broadcast(right))).drop(*[f"{k}_" for k in keys])  # without keys, one row

    near = [0.5 - 3 / ACCURACY, 0.5 + 3 / ACCURACY]
    bracket = v.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", near, ACCURACY).alias("q")).select(*keys, "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
    counted = joined(v, bracket).where(F.col("v") <= F.col("hi")).groupBy(*keys, F.when(inside, cell).otherwise(-1).alias("cell")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = W.partitionBy(*keys).orderBy("cell")  # CELLS + 1 rows a group at most
    cells = counted.select("*", F.coalesce(F.sum("c").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranks = [F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)]
    holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("c"))
    middle = cells.where(holds(ranks[0]) | holds(ranks[1])).groupBy(*keys).agg(F.min("cell").alias("from_cell"), F.max("cell").alias("to_cell"), F.min("before").alias("before"))
    chosen = joined(joined(v, bracket).where(inside), middle).where(cell.between(F.col("from_cell"), F.col("to_cell"))).groupBy(*keys, "v").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("before").alias("before"))
    ordered = W.partitionBy(*keys).orderBy("v")
    placed = chosen.select("*", (F.col("before") + F.coalesce(F.sum("c").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("at"))
    at = lambda r: F.max(F.when((F.col("at") <= r) & (r < F.col("at") + F.col("c")), F.col("v")))
    found = placed.groupBy(*keys).agg(F.first("n").alias("n"), at(ranks[0]).alias("a"), at(ranks[1]).alias("b"))
    return found.where("n IS NOT NULL").select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", ((F.col("a") + F.col("b")) / 2).alias("median"))


def duration_stats(tasks: DataFrame, *, type_col: str, ms: Column, newest: Column | None = None, sample: int = 2000) -> DataFrame:
    """Samples, mean and exact median by type, and over all (type null), of the newest `sample` tasks; of all of them
    where `newest` isn't given."""
    rows = tasks.select(F.col(type_col).alias("type"), ms.alias("ms"), *([newest.alias("newest")] if newest is not None else [])).where("ms IS NOT NULL")
    if newest is not None:
        rows = rows.orderBy(F.desc("newest")).limit(sample)
    else:
        each = rows.withColumn("of", F.explode(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast(rows.schema["type"].dataType).alias("type")), F.struct(F.lit(False).alias("all"), F.col("type"))))).select("of.all", "of.type", "ms")
        means = each.groupBy("all", "type").agg(F.count("*").alias("samples"), F.bround(F.avg("ms"), 0).alias("avg_ms"))
        p50 = exact_medians(each, "ms", ["all", "type"]).select(F.col("all").alias("a"), F.col("type").alias("t"), F.bround("median", 0).alias("p50_ms"))
        return means.join(p50, (F.col("all") == F.col("a")) & F.col("type").eqNullSafe(F.col("t"))).select("type", "samples", "avg_ms", "p50_ms")
    return rows.rollup("type").agg(F.count("*").alias("samples"), F.bround(F.avg("ms"), 0).alias("avg_ms"), F.bround(F.percentile("ms", 0.5), 0).alias("p50_ms"))


def daily(rows: DataFrame, day: Column, sums: dict[str, Column]) -> DataFrame:
    """Sums by day: what an upsert that accumulates would hold, recomputed and so safe to repeat."""
    return rows.groupBy(day.cast("date").alias("day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def trend(per_day: DataFrame, first: Column, last: Column, *, keep_null: Sequence[str] = ()) -> DataFrame:
    """A row for every day from first to last: 0 where there is nothing, but null in the columns `keep_null`."""
    days = per_day.sparkSession.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias("day"))
    out = days.join(per_day, "day", "left")
    return out.fillna(0, subset=[c for c in per_day.columns if c != "day" and c not in keep_null])


def stage_timeline(events: DataFrame, *, key: Sequence[str], stage: str, ts: str, order: str, level: str, code: str, message: str) -> DataFrame:
    """By key and stage: first and last time, events, and the worst level with the code and message of its first event."""
    rank = F.when(F.col(level) == "error", 2).when(F.col(level) == "warning", 1).otherwise(0)
    worst = F.max_by(F.struct(F.col(level).alias("level"), F.when(rank > 0, F.col(code)).alias("code"), F.when(rank > 0, F.col(message)).alias("message")), F.struct(rank, -F.col(order)))
    out = events.groupBy(*key, F.col(stage).alias("stage")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"), worst.alias("w"), F.min(order).alias("first_order"))
    return out.select(*key, "stage", "started", "ended", "events", "w.level", "w.code", "w.message", "first_order")


def level_distribution(docs: DataFrame, *, level: str, pages: str, known: Sequence[str] = ("L0", "L1", "L2")) -> DataFrame:
    """Documents by parse level with their share of pages; where no document has pages, of documents. Null: unknown."""
    named = F.coalesce(F.col(level), F.lit("unknown"))
    found = docs.groupBy(named.alias("level")).agg(F.count("*").alias("documents"), F.coalesce(F.sum(pages), F.lit(0)).alias("pages"))
    names = docs.sparkSession.createDataFrame([(k,) for k in known], "level string").union(found.where("level = 'unknown'").select("level"))
    out = names.join(F.broadcast(found), "level", "left").fillna(0)  # as many rows as there are levels
    whole = out.agg(F.sum("pages").alias("all_pages"), F.sum("documents").alias("all_documents"))
    share = F.when(F.col("all_pages") > 0, ratio(F.col("pages"), F.col("all_pages"))).otherwise(ratio(F.col("documents"), F.col("all_documents")))
    count = F.when(F.col("all_pages") > 0, F.col("pages")).otherwise(F.col("documents"))
    return out.join(F.broadcast(whole)).select("level", "documents", "pages", count.alias("count"), share.alias("page_ratio"))  # one row broadcast


def cards(docs: DataFrame, chunks: DataFrame, *, status: str = "status", tokens: str = "token_count", doc: str = "doc_id") -> DataFrame:
    """One row of headline numbers; a document with a warning counts as parsed."""
    d = docs.agg(F.count("*").alias("docs_total"), F.count_if(F.col(status).isin("ok", "warning")).alias("good"), F.count_if(F.col(status).isin("ok", "warning", "failed")).alias("parsed"))
    c = chunks.agg(F.count("*").alias("chunks_total"), F.countDistinct(doc).alias("chunk_docs"), F.avg(tokens).alias("mean"))
    return d.join(F.broadcast(c)).select(  # one row each
        "docs_total", ratio(F.col("good"), F.col("parsed")).alias("success_rate"), "chunks_total",
        F.bround(ratio(F.col("chunks_total"), F.col("chunk_docs")), 2).alias("avg_chunks_per_doc"), F.bround(F.col("mean"), 1).alias("avg_chunk_tokens"),
    )


def all_time(per_day: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the sums of daily counts over all days, 0 where there are none."""
    return per_day.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def all_cards(docs: DataFrame, chunks: DataFrame, tasks: DataFrame, recent: Column) -> DataFrame:
    """One row of all headline numbers.

    docs: status, pages, degraded_pages, ocr_pages, text_coverage, table_confidence, ocr_confidence; chunks: doc_id,
    token_count; tasks: status, ms (of tasks that ended). `recent` marks documents of the last days. A number under
    two names has both, as readers look for either.
    """
    d = docs.agg(
        F.count("*").alias("docs_total"), F.count_if(recent).alias("docs_recent"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("pages", "pages_total"), ("degraded_pages", "degraded_pages"), ("ocr_pages", "ocr_pages"))],
        *[F.bround(F.avg(c), 4).alias(f"avg_{c}") for c in ("text_coverage", "table_confidence", "ocr_confidence")],
    )
    t = tasks.agg(
        *[F.count_if(F.col("status") == s).alias(f"tasks_{s}") for s in ("queued", "running", "failed")],
        F.bround(F.avg("ms"), 0).alias("avg_duration_ms"),
    )
    half = exact_medians(tasks, "ms").agg(F.bround(F.max("median"), 0).alias("p50_duration_ms"))
    t = t.join(F.broadcast(half))
    whole = cards(docs, chunks).drop("docs_total").join(F.broadcast(d)).join(F.broadcast(t))  # one row each
    ocr = ratio(F.col("ocr_pages"), F.col("pages_total"))
    return whole.withColumns({"ocr_ratio": ocr, "documents": F.col("docs_total"), "chunk_total": F.col("chunks_total"), "imported_7d": F.col("docs_recent")})


def corpus_summary(samples: DataFrame, *, passed: str, graceful: str, coverage: str, seconds: str, level: str) -> DataFrame:
    """One row over a run of samples: passes, failures, share of graceful failures, means, and samples by level."""
    return samples.agg(
        F.count("*").alias("samples"), F.count_if(F.col(passed)).alias("passed"), F.count_if(~F.col(passed)).alias("failed"),
        ratio(F.count_if(~F.col(passed) & F.col(graceful)), F.count_if(~F.col(passed))).alias("graceful_rate"), F.avg(coverage).alias("mean_coverage"), F.avg(seconds).alias("mean_seconds"),
        *[F.count_if(F.col(level) == lv).alias(f"level_{lv}") for lv in ("L0", "L1", "L2")],
    )


def trend_view(days: DataFrame) -> DataFrame:
    """A trend for display: imports are at least the documents created, coverage in percent."""
    return days.withColumns({"imported": F.greatest("imported", "docs_created"), "text_coverage": F.col("text_coverage") * 100})


def characters_label(tokens: Column) -> Column:
    """About how many characters so many tokens are, to the nearest 50."""
    return F.floor(tokens * 1.7 / 50 + 0.5) * 50


def step_states(steps: Sequence[str], cursor: Column, failed: Column) -> Column:
    """State of each of a task's steps when it stands at `cursor` (from 0): done before it, then active or failed, then pending or skipped."""
    state = lambda k: F.when(F.lit(k) < cursor, "done").when(F.lit(k) == cursor, F.when(failed, "failed").otherwise("active")).otherwise(F.when(failed, "skipped").otherwise("pending"))
    return F.array(*[F.struct(F.lit(s).alias("step"), state(k).alias("state")) for k, s in enumerate(steps)])


def since_days(rows: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    """Rows of the last `days` days before `now`; those without a readable time stay.

    Columns of times are compared as they are, so that the filter reaches the files' statistics.
    """
    kind = rows.schema[column].dataType.typeName()
    at = F.col(column) if kind in ("timestamp", "timestamp_ntz", "date") else F.try_to_timestamp(F.col(column).cast("string"))
    return rows.where(at.isNull() | (at >= now.cast("timestamp") - F.make_dt_interval(F.lit(days))))
