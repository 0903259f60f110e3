"""Vectorised word hashes of Arrow text columns (NumPy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes of text that one vectorised step takes, unless a single text is longer; a worker holds about 80 bytes for each.
STEP = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to at least n."""
    size = max(2 * STEP, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the result (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of the column as one byte array, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``step`` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        yield at, to
        at = to


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def word_table(blank_words: bool) -> np.ndarray:
    """Which lower-cased bytes belong to words: letters, digits and non-ASCII, or all but ASCII white space."""
    c = np.arange(256)
    if blank_words:
        return ~((c == 32) | ((c >= 9) & (c <= 13)))
    return ((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122)) | (c >= 128)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the n + 1 offsets of the rows' words. ``offsets`` start at 0 and cover ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    word = is_word[low]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets).astype(np.int64)


def word_windows(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, step: int = 4 * STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and row of every word, some ``step`` bytes at a time; a window ends at a row's end or between words.

    ``data`` is lower-cased; ``offsets`` start at 0 and cover it.  One long
    row takes several windows, so memory does not follow the longest text.
    """
    at, n = 0, len(data)
    while at < n:
        to = min(at + step, n)
        while to < n and is_word[data[to]]:
            edge = offsets[min(np.searchsorted(offsets, to), len(offsets) - 1)]
            if edge == to:
                break
            gap = np.flatnonzero(~is_word[data[to:to + 4096]])
            ahead = to + (int(gap[0]) if len(gap) else 4096)
            to = min(ahead, int(edge), n)
        word = is_word[data[at:to]]
        before, after = np.zeros(to - at, bool), np.zeros(to - at, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, to)] - at
        before[inner] = False
        after[inner - 1] = False
        starts, ends = np.flatnonzero(word & ~before) + at, np.flatnonzero(word & ~after) + at + 1
        yield starts, ends, np.searchsorted(offsets, starts, "right") - 1
        at = to
