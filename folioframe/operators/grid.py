"""Tables and sheets as cells: dense grids, islands of cells, packing of lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.packing import line_sums, runs


def numbered(rows: DataFrame, *, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with their number within the key, from 0, as column r."""
    return rows.withColumn("r", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def dense(cells: Column) -> Column:
    """Rows of texts from an array of cells with spans; what a span covers is empty, the last cell written stands.

    Cells are sorted by place and the gaps between them filled: work grows with the cells and the grid, not their product.
    """
    n_rows = F.array_max(F.transform(cells, lambda c: c["r"] + c["rowspan"]))
    n_cols = F.array_max(F.transform(cells, lambda c: c["c"] + c["colspan"]))

    def filled(size: Column) -> Column:
        place = lambda c, i: F.struct((c["r"].cast("long") * size["cols"] + c["c"]).alias("k"), i.alias("i"), F.coalesce(c["text"], F.lit("")).alias("text"))
        last = lambda s: F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(b.isNull() | (a["k"] != b["k"]), a)), lambda a: a.isNotNull())
        return let(F.array_sort(F.transform(cells, place)), lambda s: let(last(s), lambda ones: rows(size, ones)))

    def rows(size: Column, ones: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(-1).cast("long")), F.transform(ones, lambda a: a["k"])), 1, F.size(ones))
        parts = F.zip_with(ones, before, lambda a, k: F.concat(F.array_repeat(F.lit(""), (a["k"] - k - 1).cast("int")), F.array(a["text"])))
        rest = F.array_repeat(F.lit(""), (size["rows"] * size["cols"] - 1 - F.element_at(ones, -1)["k"]).cast("int"))
        return let(F.concat(F.flatten(parts), rest), lambda flat: F.transform(F.sequence(F.lit(0), size["rows"] - 1), lambda r: F.slice(flat, r * size["cols"] + 1, size["cols"])))

    return F.when(F.size(cells) > 0, let(F.struct(n_rows.cast("int").alias("rows"), n_cols.cast("int").alias("cols")), filled))


def has_merged(cells: Column) -> Column:
    return F.coalesce(F.exists(cells, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)), F.lit(False))


def header_rows(cells: Column, most: int = 3) -> Column:
    """Leading rows, three at most, that hold a head cell."""
    heads = F.array_distinct(F.transform(F.filter(cells, lambda c: F.coalesce(c["is_header"], F.lit(False)) & (c["r"] < most)), lambda c: c["r"]))
    return let(heads, lambda h: F.size(F.filter(F.array(*[F.lit(k) for k in range(most)]), lambda k: F.forall(F.sequence(F.lit(0), k), lambda j: F.array_contains(h, j)))))


def islands(rows: DataFrame, key: Sequence[str], position: str, name: str) -> DataFrame:
    """Distinct (key, position) with the number of the run of neighbouring positions that it is in."""
    distinct = rows.select(*key, position).distinct()
    return distinct.withColumn(name, F.col(position) - F.row_number().over(W.partitionBy(*key).orderBy(position)))


def regions(cells: DataFrame, *, key: Sequence[str], row: str = "r", col: str = "c") -> DataFrame:
    """Non-blank cells of sheets with the region they are in: islands of rows, then of the columns used in each of these."""
    by_row = cells.join(islands(cells, key, row, "row_island"), [*key, row])
    by_col = islands(by_row, [*key, "row_island"], col, "col_island")
    return by_row.join(by_col, [*key, "row_island", col])


def clip_spans(merges: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Merged ranges (r0, r1, c0, c1) held to the bounds (top, bottom, left, right) of the region that holds their origin."""
    inside = (F.col("r0") >= F.col("top")) & (F.col("r0") <= F.col("bottom")) & (F.col("c0") >= F.col("left")) & (F.col("c0") <= F.col("right"))
    return merges.join(found, list(key)).where(inside).select(*key, "r0", "c0", (F.least("r1", "bottom") - F.col("r0") + 1).alias("rowspan"), (F.least("c1", "right") - F.col("c0") + 1).alias("colspan"))


def serial_value(serial: Column) -> Column:
    """A spreadsheet's day number as text: a time below 1, a date if whole, else both."""
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("long")
    moment = F.timestamp_seconds(F.floor(serial).cast("long") * 86400 - 25569 * 86400 + seconds)
    return F.when(serial < 1, F.date_format(moment, "HH:mm:ss")).when(seconds == 0, F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


# Codes of errors in cells of binary sheets.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def cell_value(kind: Column, number: Column, text: Column) -> Column:
    """What a typed cell shows: text as it is, dates from day numbers, TRUE or FALSE, an error's sign, a number without a needless fraction."""
    sign = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), number.cast("int")), F.lit("#N/A"))
    plain = F.when(number == F.floor(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string"))
    return (
        F.when(kind == "text", text).when(kind == "date", serial_value(number)).when(kind == "bool", F.when(number != 0, "TRUE").otherwise("FALSE"))
        .when(kind == "error", sign).when(kind == "number", plain).otherwise("")
    )


def pack_lines(docs: DataFrame, *, key: str, lines: str, budget: int) -> DataFrame:
    """(key, bin, first, last, cost): runs of lines whose tokens stay within the budget; a longer line is a run itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, texts in zip(pdf[key], pdf[lines], strict=True):
                costs = line_sums([] if texts is None else list(texts))
                out += [(k, number, i, j - 1, costs[j] - costs[i]) for number, (i, j) in enumerate(runs(costs, budget))]
            yield pd.DataFrame(out, columns=[key, "bin", "first", "last", "cost"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, lines).mapInPandas(run, f"{key} {kind}, bin int, first int, last int, cost long")
