"""Catalogue queries: filters, pages, lookups, edits by key. All declarative; the engine pushes filters to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written


#: States of tasks that have not ended.
OPEN_STATES = ("queued", "running")


def contains(q: str, *columns: str) -> Column:
    """Whether a column holds q, letters alike in either case; % and _ in q are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return hit


def select_rows(rows: DataFrame, equal: dict[str, object] | None = None, q: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Rows equal to each given value (None: not asked) that hold q in one of the columns."""
    for name, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows.where(contains(q, *columns)) if q else rows


def page(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, largest: int = 200) -> DataFrame:
    """A page of rows in order, which should end with a unique column; sizes are held to 1..largest."""
    size = min(max(1, size), largest)
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, largest: int = 200) -> DataFrame:
    """A page of rows, each with the number of all rows as `total`: one count, joined as a single row. An empty page has no rows."""
    return page(rows, order, number, size, largest).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def active(tasks: DataFrame, doc_id: object, *, doc: str = "doc_id", status: str = "status") -> bool:
    """Whether a document has tasks that wait or run, so that it must not be deleted or parsed again now."""
    return not tasks.where((F.col(doc) == F.lit(doc_id)) & F.col(status).isin(*OPEN_STATES)).isEmpty()


def exportable(docs: DataFrame, q: str | None = None, *, status: str = "status", name: str = "name") -> DataFrame:
    """Documents that can be exported, by name if `q` is given, letters alike in either case."""
    return select_rows(docs, {status: "ok"}, q, [name])


def chunk_scan(chunks: DataFrame, doc_id: object, kind: str | None = None) -> DataFrame:
    """A document's chunks in order, all or of one kind."""
    return select_rows(chunks, {"doc_id": doc_id, "kind": kind}).orderBy("seq")


def ir_summary(files: DataFrame, *, size: str = "size", nodes: str = "nodes", largest: int = 16 * 1024**2) -> DataFrame:
    """Stored trees with their number of nodes, null above a size at which they aren't opened for a summary."""
    return files.withColumn("node_count", F.when(F.col(size) <= largest, F.size(nodes)))


def missing_members(manifest: Column, members: Column) -> tuple[Column, Column]:
    """Members of a package that its manifest doesn't name, and names that have no member."""
    return F.array_except(members, manifest), F.array_except(manifest, members)


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key: partial maxima instead of a sort of each key's rows."""
    rest = [c for c in rows.columns if c not in key]
    kept = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*key).agg(kept).select(*key, "__row.*").select(*rows.columns)


def oldest(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The one row that a queue hands out next."""
    return rows.orderBy(*order).limit(1)


def without(rows: DataFrame, gone: DataFrame, on: str, gone_on: str | None = None) -> DataFrame:
    """Rows whose key is not among those that go."""
    keys = gone.select(F.col(gone_on or on).alias("__gone")).distinct()
    return rows.join(keys, rows[on] == keys["__gone"], "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows that belong to what goes."""
    return {name: without(rows, gone, on, key) for name, (rows, on) in tables.items()}


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Base with changed rows in place of those with the same key. Of several changes to a key the last in `order` counts,
    without an order the greatest row."""
    last = latest(changes, key, list(order) or [F.col(c) for c in changes.columns if c not in key])
    return base.join(last.select(*key), list(key), "left_anti").unionByName(last)


def patch(base: DataFrame, changes: DataFrame, key: str, nulls: Sequence[str] = ()) -> DataFrame:
    """Base with the values of changes (one row a key) where these are not null; in the columns `nulls`, also where they are."""
    fields = {c: f"new_{k}" for k, c in enumerate(c for c in changes.columns if c != key)}
    names = {c: f"old_{k}" for k, c in enumerate(base.columns)}
    fresh = changes.select(F.col(key).alias("changed"), *[F.col(c).alias(n) for c, n in fields.items()])
    joined = base.toDF(*names.values()).join(fresh, F.col(names[key]) == F.col("changed"), "left")

    def value(c: str) -> Column:
        old = F.col(names[c])
        if c not in fields:
            return old.alias(c)
        new = F.col(fields[c])
        return (F.when(F.col("changed").isNotNull(), new).otherwise(old) if c in nulls else F.coalesce(new, old)).alias(c)

    return joined.select(*[value(c) for c in base.columns])


def replace_documents(base: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base with all rows of the documents in fresh replaced by fresh."""
    return without(base, fresh, key).unionByName(fresh)


def in_parts(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows sorted over all partitions, written to the shared folder, with the number of their part: parts are in order too."""
    return written(rows.orderBy(*order).withColumn("part", F.spark_partition_id()), "parts")


def earlier_duplicate(docs: DataFrame, *, content: str, order: Sequence[str], id_col: str) -> DataFrame:
    """Each row with the id of the latest earlier row of the same content; advisory, nothing is dropped. Null content has none.

    Rows are sorted by content and order over all partitions, so one content of very many rows is spread too; the first
    row of a part looks at the last of the parts before.
    """
    names = [F.col(c) for c in order]
    sorted_ = in_parts(docs.where(F.col(content).isNotNull()), [F.col(content), *names])
    ends = sorted_.groupBy(F.col("part").alias("p")).agg(F.max_by(F.struct(F.col(content).alias("end_content"), F.col(id_col).alias("end_id")), F.struct(content, *order)).alias("e"))
    ends = ends.select((F.lead("p").over(W.orderBy("p"))).alias("next"), "e.*")  # a row a part
    within = W.partitionBy("part").orderBy(content, *order)
    seen = sorted_.select(*docs.columns, "part", F.lag(content).over(within).alias("last_content"), F.lag(id_col).over(within).alias("last_id"))
    seen = seen.join(F.broadcast(ends.where("next IS NOT NULL")), F.col("part") == F.col("next"), "left")  # as many rows as parts
    before = F.when(F.col("last_content").isNull(), F.when(F.col("end_content") == F.col(content), F.col("end_id"))).when(F.col("last_content") == F.col(content), F.col("last_id"))
    return seen.select(*docs.columns, before.alias("duplicate_of")).unionByName(docs.where(F.col(content).isNull()).withColumn("duplicate_of", F.lit(None).cast(docs.schema[id_col].dataType)))


def unique_names(rows: DataFrame, *, folder: str, name: str, order: str, id_col: str) -> DataFrame:
    """Names made unique within a folder, cases alike: all but the first by order are preceded by the start of their id.

    Where that is a name already, of whatever row, by the whole id; where that is, by a hash of id and order besides. So
    rows of different ids, or orders, never share a name; of equal ones no name can tell more.
    """
    place = F.struct(F.col(order).alias("order"), F.col(id_col).alias("id"))
    first = rows.groupBy(F.col(folder).alias("in_folder"), F.lower(name).alias("lower_name")).agg(F.min(place).alias("first"))
    joined = rows.join(first, F.col(folder).eqNullSafe(F.col("in_folder")) & F.lower(name).eqNullSafe(F.col("lower_name")), "left")
    whole, dash = F.col(id_col).cast("string"), F.lit("-")
    forms = [F.concat(F.substring(whole, 1, 8), dash, F.col(name)), F.concat(whole, dash, F.col(name)), F.concat(whole, dash, F.sha2(F.to_json(place), 256), dash, F.col(name))]
    out = joined.select(*[rows[c] for c in rows.columns], (place == F.col("first")).alias("__first"), F.when(place != F.col("first"), forms[0]).otherwise(F.col(name)).alias("file_name"))
    for form in forms[1:]:
        names = out.groupBy(F.col(folder).alias("in_folder"), F.lower("file_name").alias("lower_name")).agg(F.count("*").alias("n")).where("n > 1 AND lower_name IS NOT NULL")
        found = out.join(names, F.col(folder).eqNullSafe(F.col("in_folder")) & (F.lower("file_name") == F.col("lower_name")), "left")
        out = found.select(*[out[c] for c in rows.columns], "__first", F.when(F.col("n").isNotNull() & ~F.col("__first"), form).otherwise(F.col("file_name")).alias("file_name"))
    return out.drop("__first")


def within_budget(files: DataFrame, *, size: str, order: Sequence[Column], budget: int) -> DataFrame:
    """Files in order until their sizes pass the budget, with the running sum; the first is always kept.

    The order should be one of single files. Sums of sorted parts come first; then each part is summed by itself.
    """
    parts = in_parts(files, order)
    sums = parts.groupBy(F.col("part").alias("p")).agg(F.sum(size).alias("s"))
    before = sums.select("p", F.coalesce(F.sum("s").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.row_number().over(W.orderBy("p")) == 1).alias("top"))  # a row a part
    w = W.partitionBy("part").orderBy(*order)
    here = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    known = parts.select(*files.columns, "part", here.alias("here"), F.row_number().over(w).alias("turn")).join(F.broadcast(before), F.col("part") == F.col("p"))
    known = known.withColumn("running", F.col("before") + F.col("here"))
    return known.where((F.col("top") & (F.col("turn") == 1)) | (F.col("running") <= budget)).select(*files.columns, "running")


def terminal_state(tasks: DataFrame, *, status: str) -> DataFrame:
    """A closing event for tasks that have ended: done, failed or canceled."""
    return tasks.where(F.col(status).isin("done", "failed", "canceled")).withColumn("event", F.when(F.col(status) == "done", "done").otherwise("failed"))


def decorate_codes(rows: DataFrame, code: str, registry: dict[str, tuple[str, str]], default: tuple[str, str]) -> DataFrame:
    """Rows with the message and the advice of their error code."""
    texts = F.create_map(*[x for k, (m, a) in registry.items() for x in (F.lit(k), F.struct(F.lit(m).alias("message"), F.lit(a).alias("advice")))])
    found = F.coalesce(F.element_at(texts, F.col(code)), F.struct(F.lit(default[0]).alias("message"), F.lit(default[1]).alias("advice")))
    return rows.withColumn("__text", found).select(*rows.columns, "__text.message", "__text.advice")
