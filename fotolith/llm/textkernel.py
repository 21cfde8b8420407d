"""numpy kernels over Arrow string columns, shared by the text operators.

A column of texts is one UTF-8 byte buffer with row offsets. Word and line hashes come from one prefix polynomial over
that buffer, modulo the prime 2^61 - 1 (a power of two would let Thue-Morse strings collide), so no Python object is
made per word. The kernels work on slices of at most ``CHUNK_BYTES`` of text (or one longer text), which bounds the
memory of a Python worker by the longest text; ``tidy`` gives memory back at the end of a task.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_PRIME_INT, _ROOT_INT = (1 << 61) - 1, 0x1D2B_6E5F_93A4_C817 % ((1 << 61) - 1)
_PRIME, _ROOT, _ROOT_INV = np.uint64(_PRIME_INT), np.uint64(_ROOT_INT), np.uint64(pow(_ROOT_INT, -1, _PRIME_INT))
_S1, _LOW30, _LOW31, _S61 = np.uint64(1), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64(61)
#: Longer ranges are digested whole, as their sums could overflow.
_LONG_RANGE = 1 << 24
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, a bijection."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _S61)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    mid = a0 * b1 + a1 * b0
    return _fold(((a1 * b1) << _S1) + (mid >> _S30) + ((mid & _LOW30) << _S31) + a0 * b0)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key in _tables and len(_tables[key]) >= n:
        return _tables[key][:n]
    size = 1 << max(16, (n - 1).bit_length())
    out = np.ones(size, np.uint64)
    have, step = 1, int(base)
    while have < size:
        out[have : 2 * have] = _times(out[:have], np.uint64(step))
        have, step = 2 * have, step * step % _PRIME_INT
    if size <= 2 * CHUNK_BYTES:  # that of a very long text is not kept
        _tables[key] = out
    return out[:n]


@functools.cache
def _trimmer() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def trim() -> None:
    """Gives freed memory back to the system, as workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    if (f := _trimmer()) is not None:
        f(0)


def tidy(f: Callable) -> Callable:
    """For functions of mapInArrow: memory goes back when the task ends."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            yield from f(*args, **kwargs)
        finally:
            _tables.clear()
            trim()

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` text bytes, or one row."""
    if not batch.num_rows:
        return
    _, offs = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, o - o[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large binary column of byte ranges of one buffer, without copies per row."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Prefix:
    """Hashes of byte ranges of a buffer in O(1) each."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.n = buf, len(buf)
        power = _powers(_ROOT, self.n)
        own = buf.astype(np.uint64) + _S1
        self.low, self.high = np.zeros(self.n + 1, np.uint64), np.zeros(self.n + 1, np.uint64)
        np.cumsum(own * (power & _LOW31), out=self.low[1:])
        np.cumsum(own * (power >> _S31), out=self.high[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end); ranges of another length or content differ but for chance."""
        inverse = _powers(_ROOT_INV, max(self.n, 1))
        low, high = _fold(self.low[ends] - self.low[starts]), _fold(self.high[ends] - self.high[starts])
        sums = _fold(low + (high >> _S30) + ((high & _LOW30) << _S31))
        h = _times(sums, inverse[np.minimum(starts, max(self.n - 1, 0))])
        for i in np.flatnonzero(ends - starts > _LONG_RANGE).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[starts[i] : ends[i]], digest_size=8).digest()) >> 3
        return mix(h ^ ((ends - starts).astype(np.uint64) * _M2))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a bytewise flag or count for each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of maximal runs of True, cut at row bounds."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(tokens: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of each run of k tokens within one row."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += tokens[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return at, mix(out[at])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found more than once, found before in order) for each key."""
    n = len(keys)
    many, again = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, again


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n tokens lie inside a window of the given width."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Bytes of words that white space separates, and of words of letters and digits (of lower-cased text).
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
