"""A count-min sketch of 64-bit keys: counts that may be too high, never too low, in a fixed number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .hashing import mix64

U64 = np.uint64
#: Rows, bits of a row's length, and cells that are summed together.
ROWS, WIDTH, SEGMENT = 3, 17, 4096
CELLS = ROWS << WIDTH


def cells(keys: np.ndarray) -> Iterator[np.ndarray]:
    """A key's cell in each row."""
    for r in range(ROWS):
        yield (mix64(keys + U64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) >> U64(64 - WIDTH)).astype(np.int64) + (r << WIDTH)


def add(sketch: np.ndarray, keys: np.ndarray) -> None:
    for at in cells(keys):
        np.add.at(sketch, at, 1)


def marked(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' cells are all flagged."""
    out = np.ones(len(keys), bool)
    for at in cells(keys):
        out &= flags[at]
    return out


def parts(sketch: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Segments of a sketch, numbered from -1 downwards."""
    for k in range(CELLS // SEGMENT):
        yield -1 - k, sketch[k * SEGMENT : (k + 1) * SEGMENT].tobytes()


def summed(data: pd.Series) -> bytes:
    total = np.zeros(SEGMENT, np.int64)
    for x in data:
        total += np.frombuffer(x, np.int64)
    return total.tobytes()


def hot_flags(found: DataFrame, most: int) -> np.ndarray:
    """Flags of cells such that a key in 1 / `most` or more of all keys has all its cells flagged; few others have.

    `found`: rows (part, data) of the segments of tasks' sketches, and rows of part 0 whose column n counts keys. What
    the driver gathers is of fixed size.
    """

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        return pd.DataFrame({"part": [part], "data": [summed(pdf["data"]) if part < 0 else b""], "n": [pdf["n"].sum()]})

    rows = found.select("part", "data", "n").groupBy("part").applyInPandas(unite, "part int, data binary, n long").toPandas()
    sketch = np.frombuffer(b"".join(rows.sort_values("part", ascending=False)["data"]), np.int64)
    return sketch >= max(2.0, rows["n"].sum() / most) if len(sketch) else np.zeros(CELLS, bool)
