"""Whole numbers in few bytes, coded and decoded by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32 - 1: one byte each below 255, four more for each of the others, at the end."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.uint32).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    """The n numbers that `pack` coded."""
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.uint32, offset=n)
    return out


def gaps(sorted_: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distances of ascending numbers from their predecessors in each run; a run's first counts from 0. No run is empty."""
    out = np.diff(sorted_, prepend=0)
    out[starts] = sorted_[starts]
    return out


def ungap(distances: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What `gaps` took the distances of."""
    total = np.cumsum(distances)
    sizes = np.diff(starts, append=len(distances))
    return total - np.repeat(total[starts] - distances[starts], sizes)


def pack_keys(keys: np.ndarray, width: int = 8) -> bytes:
    """Ascending keys of up to `width` bytes as distances, byte by byte, so that what compresses stands together."""
    return np.diff(keys, prepend=np.zeros(1, np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes() if len(keys) else b""


def unpack_keys(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, 8 - width :] = planes.T
    return np.cumsum(whole.view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one at a time: rows of packed columns are large."""
    for k in range(batch.num_rows):
        yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
