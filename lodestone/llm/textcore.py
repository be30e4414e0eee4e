"""Vectorised text kernels over Arrow string columns, used inside Spark tasks.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 text is the
regular expression ``[^\\x20\\x09-\\x0D]+``. Texts are never copied into Python strings: a column's
UTF-8 buffer is one ``uint8`` array and documents are spans of it. Hashes are 64 bits wide:
polynomial over the bytes (or words) modulo 2**64, with random byte values and a final mix.
Equal sequences always have equal hashes; different ones collide with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
#: Bytes of text that a kernel hashes at once; only a longer single word makes a larger slice.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASE = 0xD6E8FEB86659FD93 | 1
_BYTE_VALUE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base % 2**64, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 document bounds; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose first bytes are at ``at``; of ill-formed UTF-8 some number, never an error."""
    out = raw[at].astype(np.int64)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        lead = out[wide]
        more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0x3F >> more)
        for k in (1, 2, 3):
            tail = raw[np.minimum(at[wide] + k, len(raw) - 1)] & 0x3F
            value = np.where(more >= k, value << 6 | tail, value)
        out[wide] = value
    return out


class Words:
    """Words of a run of documents: byte spans ``starts``/``ends``; document d has words bounds[d]:bounds[d+1]."""

    def __init__(self, raw: np.ndarray, docs: np.ndarray):
        self.raw, self.docs = raw, docs
        solid = ~SPACES[raw]
        first, last = solid.copy(), solid.copy()
        if len(raw):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            cuts = np.unique(docs[(docs > 0) & (docs < len(raw))])
            first[cuts] = solid[cuts]
            last[cuts - 1] = solid[cuts - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, docs)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts())


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    back = inverse(_BASE)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw[low:high]] * powers(_BASE, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * powers(back, high - low + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(values: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` values within one document, and the index at which each starts."""
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(bounds)
    inside = np.arange(n) + length <= np.repeat(bounds[1:], counts)
    at = np.flatnonzero(inside)
    return windows_at(values, at, length), at


def windows_at(values: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_GRAM_BASE, n), out=sums[1:])
    return mix((sums[at + length] - sums[at]) * powers(inverse(_GRAM_BASE), n + 1)[at] + np.uint64(length))


def spans_hash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each document's whole sequence of values."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_GRAM_BASE, n), out=sums[1:])
    low, high = bounds[:-1], bounds[1:]
    return mix((sums[high] - sums[low]) * powers(inverse(_GRAM_BASE), n + 1)[low] + (high - low).astype(np.uint64))


def _give_back() -> None:
    """Hands freed memory back to the system, which a Python worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        return


def released(task: Callable) -> Callable:
    """A task's function over a stream that gives back its memory when it ends."""

    def run(stream):
        try:
            yield from task(stream)
        finally:
            _give_back()

    return run


def batches(stream: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The stream's rows again, in batches whose texts hold about ``most_bytes`` at most (a longer text comes alone)."""
    held, size = [], 0
    for batch in stream:
        if not batch.num_rows:
            continue
        lengths = np.diff(column_bytes(batch.column(column))[1])
        cut = 0
        while cut < batch.num_rows:
            room = np.searchsorted(np.cumsum(lengths[cut:]), most_bytes - size, "right")
            if room == 0 and held:
                yield join_batches(held)
                held, size = [], 0
                continue
            upto = min(batch.num_rows, cut + max(1, int(room)))
            held.append(batch.slice(cut, upto - cut))
            size += int(lengths[cut:upto].sum())
            cut = upto
            if size >= most_bytes:
                yield join_batches(held)
                held, size = [], 0
    if held:
        yield join_batches(held)


def join_batches(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches(parts).combine_chunks()
    found = table.to_batches()
    return found[0] if len(found) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in table.columns], names=table.schema.names)


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[d]:bounds[d+1]] for each d."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def flat_binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is the next sizes[i] elements of data, little-endian."""
    data = np.ascontiguousarray(data)
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.asarray(sizes, np.int64) * data.itemsize, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
