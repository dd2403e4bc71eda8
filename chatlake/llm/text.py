"""Vectorised work on the UTF-8 bytes of a whole Arrow string column.

Everything here takes the flat byte buffer of many documents at once with their offsets, so that
no step needs a Python loop over words or characters.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time; a longer document is taken alone.
CHUNK = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII bytes but letters and digits.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK, each: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `size` bytes each, one document at least. each: what a document costs
    besides its bytes."""
    offsets = offsets + each * np.arange(len(offsets))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to
    trim()


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, several in one until they have about `size` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def trim() -> None:
    """Give memory that is free in this worker back to the system, as workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(31))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _P if kind == "up" else pow(_P, -1, 2**64)
        have = np.full(max(n, CHUNK + (CHUNK >> 1)), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n > 8 * CHUNK:  # a very long document: not kept
            return have[:n]
        _powers[kind] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    x = (_TABLE_LOWER if lower else _TABLE)[data]
    x *= _power("down", n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(x, out=total[1:])
    return mix((total[ends] - total[starts]) * _power("up", n)[starts])


def wide(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as a number; beyond the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def exact_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A key of each span that is the same for spans of equal bytes only: the bytes themselves and their number up
    to 7 bytes, else the hash, with the bytes compared. hashes: of the spans' bytes."""
    n = ends - starts
    at = wide(data)
    key = at[starts] & ~(~np.uint64(0) << (np.minimum(n, 7) * 8).astype(np.uint64)) | (n.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(n > 7)
    if not len(long):
        return key
    start, size = starts[long], n[long]
    key[long] = h = hashes[long] | np.uint64(1 << 63)  # the number of bytes of the others is below that
    order = np.argsort(h, kind="stable")
    lead = np.append(True, h[order][1:] != h[order][:-1])
    like = np.empty(len(long), np.int64)
    like[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]  # the first span of each hash
    differs = size != size[like]
    here = np.flatnonzero((like != np.arange(len(long))) & ~differs)
    j = 0
    while len(here):  # 8 bytes at a time, the last 8 overlap
        a = np.minimum(j, size[here] - 8)
        odd = at[start[here] + a] != at[start[like[here]] + a]
        differs[here[odd]] = True
        j += 8
        here = here[~odd & (size[here] > j)]
    if differs.any():  # equal hashes of different bytes: such spans get numbers of their own
        named: dict[bytes, int] = {}
        for i in np.flatnonzero(differs).tolist():
            span = data[start[i] : start[i] + size[i]].tobytes()
            key[long[i]] = np.uint64(named.setdefault(span, (1 << 62) + len(named)))
    return key


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words `[^\\x20\\x09-\\x0D]+`; none crosses documents.

    apart: which bytes are no part of a word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = apart[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[cuts - 1] = True
    np.logical_not(space, out=space)
    starts = np.flatnonzero(before & space)
    ends = np.flatnonzero(after & space) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive values (of all values, also across documents)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for j in range(1, n):
        out *= _U(_P)
        out += h[j : j + m]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
