"""Vectorised word and shingle hashes over whole texts, the same in every process."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U64 = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
#: Bytes hashed at a time; a longer text is a run of its own.
RUN = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(_R))


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[9, 10, 11, 12, 13, 32]] = True
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R, dtype=U64), np.full(n, _R_INV, dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Spans:
    """Words of some joined texts: where each begins and ends, and what hashes any part of it."""

    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray  # per text, its first word; one more than there are texts
    total: np.ndarray
    down: np.ndarray

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from begin to end, wherever they stand."""
        return mix64((self.total[end] - self.total[begin]) * self.down[begin])


def spans(texts: list[bytes], between: np.ndarray, fold: bool = True) -> Spans:
    """The runs of bytes that `between` (256 flags) does not mark; fold: letters A-Z count as a-z."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined.translate(_LOWER) if fold else joined, np.uint8)
    solid = np.empty(len(data) + 2, np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not(between[data], out=solid[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(solid))
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=total[1:])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = edge[::2]
    return Spans(begin, edge[1::2], np.searchsorted(begin, np.concatenate([[0], np.cumsum(lengths)])), total, down)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that aren't ASCII white space) and, per text, where its words begin.

    Letters A-Z count as a-z. Returns (hashes, starts) with len(starts) == len(texts) + 1.
    """
    found = spans(texts, _is_space())
    return found.hashes(found.begin, found.end), found.starts


def runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Slices of `texts` of about RUN bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > RUN:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


@lru_cache(maxsize=8)
def _factors(width: int) -> tuple[int, ...]:
    return tuple(int(x) | 1 for x in mix64(np.arange(11, 11 + width, dtype=U64)))


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its `width`-word shingles.

    Fewer words than `width`: the whole sequence is the one shingle. No words: empty.
    """
    factors = [U64(f) for f in _factors(width)]
    for a, b in runs(texts):
        h, starts = words(texts[a:b])
        n = len(h) - width + 1
        if n > 0:
            whole = np.zeros(n, U64)
            for j, f in enumerate(factors):
                whole += h[j : j + n] * f
            whole = mix64(whole)
        for i in range(b - a):
            s, e = int(starts[i]), int(starts[i + 1])
            if e - s >= width:
                yield np.unique(whole[s : e - width + 1])
            elif e > s:
                part = np.array([e - s], U64)
                for j in range(s, e):
                    part = mix64(part * U64(3) + h[j : j + 1])
                yield part
            else:
                yield np.empty(0, U64)


def digest(keys: np.ndarray) -> int:
    """A signed 64-bit id of a set of hashes, whatever their order."""
    total = int(mix64(keys + U64(0x632BE59BD9B4E019)).sum(dtype=U64)) + len(keys) * _R
    return int(mix64(np.array([total & (1 << 64) - 1], U64)).view(np.int64)[0])
