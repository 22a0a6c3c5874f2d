"""Word and shingle fingerprints of whole texts, over Arrow buffers with NumPy.

A word is a maximal run of bytes other than space and the controls 0x09-0x0D
(the UTF-8 form of ``[^\\x20\\x09-\\x0D]+``), with A-Z in lower case.  Words and
shingles are named by 64-bit fingerprints: polynomial sums over random byte
values, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(21)).integers(1, 2**64 - 1, 8, dtype=np.uint64) | U(1)
_WINDOW = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 array (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _WINDOW + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 20):
    """Consecutive row ranges of about ``most`` bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word, and the row that each word stands in."""
    found, where = [], []
    at, n = 0, len(data)
    inner = offsets[1:-1]
    while at < n:
        to = min(n, at + _WINDOW)
        if to < n:  # cut between two words
            back = np.flatnonzero(SEPARATOR[data[at:to]])
            row = int(np.searchsorted(offsets, to, side="right")) - 1
            cut = max(at + int(back[-1]) + 1 if len(back) else at, int(offsets[row]))
            while cut <= at:  # a word longer than the window: take it whole
                ahead = np.flatnonzero(SEPARATOR[data[to:to + _WINDOW]])
                end = int(offsets[row + 1])
                if len(ahead):
                    end = min(end, to + int(ahead[0]) + 1)
                elif to + _WINDOW < end:
                    to += _WINDOW
                    continue
                cut = end
            to = cut
        part = LOWER[data[at:to]]
        solid = ~SEPARATOR[part]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = inner[(inner > at) & (inner < to)] - at
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[:len(part)], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts]))
        where.append(np.searchsorted(offsets, starts + at, side="right") - 1)
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(where)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5,
             whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all k-word shingles in order, and the row of each.

    A row with 1 to k-1 words gives its whole sequence as one shingle when
    ``whole_short``; a row without words gives none.
    """
    w, row = words(data, offsets)
    n = len(w)
    if not n:
        return w, row
    counts = np.bincount(row, minlength=len(offsets) - 1)
    if n >= k:
        h = w[:n - k + 1] * _PLACE[0]
        for j in range(1, k):
            h += w[j:n - k + 1 + j] * _PLACE[j]
        inside = row[:n - k + 1] == row[k - 1:]
        h, hrow = mix(h)[inside], row[:n - k + 1][inside]
    else:
        h, hrow = w[:0], row[:0]
    if whole_short and ((counts > 0) & (counts < k)).any():
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        extra, extra_row = [], []
        for size in range(1, k):
            rows = np.flatnonzero(counts == size)
            if len(rows):
                s = np.full(len(rows), 7919 * size, np.uint64)
                for j in range(size):
                    s += w[first[rows] + j] * _PLACE[j]
                extra.append(mix(s))
                extra_row.append(rows)
        h, hrow = np.concatenate([h, *extra]), np.concatenate([hrow, *extra_row])
        order = np.argsort(hrow, kind="stable")
        h, hrow = h[order], hrow[order]
    return h, hrow
