"""Numpy helpers that run inside Spark tasks: words, shingles and their hashes over Arrow batches.

A batch is cut into chunks of whole texts of about ``CHUNK`` bytes, so that memory stays
bounded whatever the batch size; a single longer text forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93


def text_chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets from 0, bytes) of consecutive rows; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, off[a : b + 1] - off[a], data[off[a] : off[b]]
        a = b


def gathered(batches, text: int, limit: int) -> Iterator[list]:
    """The columns of consecutive Arrow batches as whole arrays, of about ``limit`` bytes of column ``text`` or one larger batch."""
    import pyarrow as pa

    def whole(held):
        names = range(held[0].num_columns)
        large = [[pa.array(b.column(i).cast(pa.large_string())) if i == text else b.column(i) for b in held] for i in names]
        return [pa.chunked_array(c).combine_chunks() for c in large]

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(text).nbytes
        if size >= limit:
            yield whole(held)
            held, size = [], 0
    if held:
        yield whole(held)


def masked_runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run goes over the end of a text."""
    start, end = mask.copy(), mask.copy()
    if len(mask):
        start[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        cut = off[(off > 0) & (off < len(mask))]
        start[cut] = mask[cut]
        end[cut - 1] = mask[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def string_array(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Byte ranges of valid UTF-8, in order and apart from each other, as an Arrow array of strings."""
    import pyarrow as pa

    step = np.zeros(len(data) + 1, np.int8)
    step[s] += 1
    step[e] -= 1  # ranges that touch cancel out
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=at[1:])
    own = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(at), pa.py_buffer(own))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """Finds words and hashes them: a polynomial in the lower-cased bytes, modulo 2^64.

    ``inside`` says for each byte value whether it belongs to words.
    """

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        rng = np.random.default_rng(20240501)
        self.code = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[low]
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, min(2 * len(self.power), CHUNK + 1))
            inv = pow(_P, -1, 1 << 64)
            for name, base in (("power", _P), ("inverse", inv)):
                f = np.full(n, base, np.uint64)
                f[0] = 1
                setattr(self, name, np.cumprod(f, dtype=np.uint64))

    def find(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and for each text the number of its first word (one more at the end)."""
        w = self.inside[data]
        start, end = w.copy(), w.copy()
        if len(w):
            start[1:] &= ~w[:-1]
            end[:-1] &= ~w[1:]
            cut = off[(off > 0) & (off < len(w))]
            start[cut] = w[cut]
            end[cut - 1] = w[cut - 1]
        s = np.flatnonzero(start)
        return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)

    def hashes(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[: len(data)], out=total[1:])
        return mix((total[e] - total[s]) * self.inverse[s])


def space_words() -> Words:
    """Words are runs of anything but ASCII white space."""
    inside = np.ones(256, bool)
    inside[[32, 9, 10, 11, 12, 13]] = False
    return Words(inside)


def plain_words() -> Words:
    """Words are runs of ASCII letters, digits and non-ASCII characters."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return Words(inside)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 entries run over the end and are wrong."""
    out = h.copy()
    for j in range(1, k):
        out *= np.uint64(_Q)
        out[: len(h) - j] += h[j:]
    return mix(out + np.uint64(k))


def bigram_sets(off: np.ndarray, data: np.ndarray, words: Words, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and where each text's begin.

    A text of fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    """
    s, e, first = words.find(off, data)
    h = words.hashes(data, s, e)
    sh = shingles(h, size)
    sets, at = [], np.zeros(len(off), np.int64)
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            x = np.sort(sh[a : b - size + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            x = shingles(h[a:b], int(b - a))[:1] if b > a else sh[:0]
        sets.append(x)
        at[i + 1] = at[i] + len(x)
    return (np.concatenate(sets) if sets else sh[:0]), at
