"""Words of whole texts as numpy arrays, for functions that run on Arrow batches inside tasks.

A word is a run of bytes other than ``\\x20 \\x09-\\x0D``. Words and word sequences are represented by 64-bit hashes; every
step is a handful of array operations over a few megabytes of text, whatever the number and length of the documents.
A NULL text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: all ASCII but letters and digits
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SLICE_BYTES = 2 << 20
HASH_BYTES = 256 << 10  # text hashed at once: a dozen numbers of 8 bytes are held for each byte of it

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (multiply and shift, twice)."""
    x = x.astype(U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _BASE)


def give_back() -> None:
    """Return what this worker has freed to the system: Spark keeps idle workers for a minute, beside those of the next step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``limit`` bytes of text; a longer text is a slice of its own.

    Memory that was freed is given back after each batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(column)).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            stop = min(batch.num_rows, max(at + 1, stop))
            yield batch.slice(at, stop - at)
            at = stop
        del batch, ends
        give_back()


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and ends in them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = offsets_of(column).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


class Words:
    """``start`` and ``end`` (byte places) of each word, and ``row``: where each document's words begin and end.

    ``apart`` tells which bytes part words.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, apart: np.ndarray = SPACE):
        inside = ~apart[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = ends[:-1][ends[:-1] < ends[1:]]  # a document's edge ends a word as well
        first[begins] = inside[begins]
        last[begins[1:] - 1] = inside[begins[1:] - 1]
        self.data, self.ends, self.inside = data, ends, inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, ends)
        self.counts = np.diff(self.row)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``lower`` maps A-Z to a-z first."""
        out = np.empty(len(self.start), U)
        table = _BYTE.copy()
        if lower:
            table[65:91] = _BYTE[97:123]
        at = 0
        while at < len(out):  # a part at a time, also of one very long text
            stop = max(at + 1, int(np.searchsorted(self.end, self.start[at] + HASH_BYTES, side="right")))
            lo, hi = self.start[at], self.end[stop - 1]
            starts = self.start[at:stop] - lo
            place = np.arange(hi - lo) - np.repeat(starts, np.diff(np.append(starts, hi - lo)))
            power = np.cumprod(np.full(int(place.max()) + 1, _STEP))
            value = table[self.data[lo:hi]] * power[place]
            value[~self.inside[lo:hi]] = 0
            out[at:stop] = np.add.reduceat(value, starts)
            at = stop
        return mix(out + (self.end - self.start).astype(U) * _BASE)

    def owner(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on (documents' borders are not looked at); the last n - 1 places lack."""
    size = max(0, len(words) - n + 1)
    total = np.zeros(size, U)
    for i in range(n):
        total *= _STEP
        total += words[i : i + size]
    return mix(total)


def starts_within(row: np.ndarray, n: int) -> np.ndarray:
    """Places whose ``n`` words lie in one document; ``row`` holds the documents' borders in words."""
    if row[-1] < n:
        return np.zeros(0, np.int64)
    ok = np.ones(row[-1] - n + 1, bool)
    for back in range(1, n):
        at = row[1:-1] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return np.flatnonzero(ok)


def rolling(pick, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` consecutive values, in steps that double."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[:n], out[width - size : width - size + n]) if size < width else out


def minimisers(order: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Places that are lowest in ``order`` among the ``width`` places of a run that begins at one of ``starts``.

    The choice depends on content alone, so equal passages select the same places (all of them, among equals).
    """
    lowest = rolling(np.minimum, order, width)
    if not len(lowest):
        return np.zeros(0, np.int64)
    runs = np.zeros(len(order) + width - 1, U)  # 0, below every value that counts, where no run begins
    runs[width - 1 + starts] = lowest[starts]
    return np.flatnonzero((rolling(np.maximum, runs, width) == order) & (order > 0))
