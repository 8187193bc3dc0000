"""Rules for pages given as characters, lines and boxes: headings by size, paragraphs by gaps, text outside tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tokens import CJK

# Size ratios of headings, the body size where nothing is known, the gap that ends a paragraph.
LEVELS = ((1.55, 1), (1.30, 2), (1.12, 3))
BODY_SIZE, GAP, FEW_CHARS = 10.0, 1.6, 10


def heading_level(size: Column, body: Column) -> Column:
    """Level of a line by its size against the body's; null for body text."""
    ratio = F.try_divide(size, body)
    out = F.when(ratio >= LEVELS[0][0], LEVELS[0][1])
    for least, level in LEVELS[1:]:
        out = out.when(ratio >= least, level)
    return out


def body_size(chars: DataFrame, *, key: str, size: str, page: str | None = None, pages: int = 3) -> DataFrame:
    """(key, body): the most frequent character size, in tenths, on the first pages; of equals the smallest."""
    rows = chars.where(F.col(page) <= pages) if page else chars
    counts = rows.groupBy(key, F.round(size, 1).alias("s")).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.coalesce(F.max_by("s", F.struct(F.col("n"), -F.col("s"))), F.lit(BODY_SIZE)).alias("body"))


def paragraph_numbers(lines: DataFrame, *, key: Sequence[str], top: str, bottom: str, order: Sequence[str] = ()) -> DataFrame:
    """Lines with the number of their paragraph: a new one where the gap is above 1.6 times the line's height."""
    w = W.partitionBy(*key).orderBy(top, *order)
    starts = F.when(F.lag(bottom).over(w).isNull() | (F.col(top) - F.lag(bottom).over(w) > GAP * (F.col(bottom) - F.col(top))), 1).otherwise(0)
    return lines.withColumn("__starts", starts).withColumn("paragraph", F.sum("__starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__starts")


def join_lines(lines: Column) -> Column:
    """Lines as one text: a hyphen at an end goes, CJK meets without a space, others with one."""
    cjk = lambda c: c.rlike(f"[{CJK}]")
    def seam(a: Column, b: Column) -> Column:
        last, first = F.substring(a, -1, 1), F.substring(b, 1, 1)
        return F.when((a == "") | (b == ""), F.concat(a, b)).when((last == "-") & ~cjk(first), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).when(cjk(last) | cjk(first), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return F.aggregate(lines, F.lit(""), seam)


def outside(points: DataFrame, boxes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Points (x, y) in none of their page's boxes (x0, y0, x1, y1); a page bounds the boxes a point meets."""
    b = boxes.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    on = (F.col("x") >= F.col("__x0")) & (F.col("x") <= F.col("__x1")) & (F.col("y") >= F.col("__y0")) & (F.col("y") <= F.col("__y1"))
    for k in key:
        on = on & (points[k] == b[f"__{k}"])
    return points.join(b, on, "left_anti")


def page_kind(chars: Column, has_image: Column) -> Column:
    """text, or of pages with hardly any: blank without an image, scanned with one."""
    return F.when(chars >= FEW_CHARS, "text").when(F.coalesce(has_image, F.lit(False)), "scanned").otherwise("blank")


def plain_cells(rows: Column) -> Column:
    """Cells of an extracted table, an array of rows of texts: the first row is the head, blanks are left out."""
    return F.flatten(F.transform(rows, lambda row, r: F.filter(
        F.transform(row, lambda t, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.trim(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(" "))).alias("text"), (r == 0).alias("is_header"))),
        lambda cell: cell["text"] != "",
    )))
