"""Vectorised text kernels over Arrow string buffers.

The kernels never build one Python string per word: they work on the UTF-8
bytes of a whole block of documents with numpy, so a task's time follows the
bytes it reads. All separators used here are ASCII, hence byte positions and
character positions agree on where words begin and end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(seed * 0x632BE59BD9B4E019 % 2**64))


_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: U64, n: int) -> np.ndarray:
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        table = np.full(size, base, dtype=U64)
        table[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = have = np.cumprod(table, dtype=U64)
        if size > 1 << 21:  # do not keep the tables of one very long text
            return _powers.pop(key)
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; equal contents give equal hashes."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * _power_table(_BASE, n + 1)[:n], out=total[1:])
        raw = (total[ends] - total[starts]) * _power_table(_BASE_INVERSE, n + 1)[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


def byte_values(seed: int, lower: bool = False, digits: bool = False) -> np.ndarray:
    """A value for each byte; lower folds A-Z, digits folds 0-9."""
    table = stream(seed, 256)
    if lower:
        table[65:91] = table[97:123]
    if digits:
        table[48:58] = table[48]
    return table


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: `[\x20\x09-\x0D]`
SPACES = byte_set((0x09, 0x0D), (0x20, 0x20))
#: `[\x00-\x2F\x3A-\x60\x7B-\x7F]`, after folding A-Z
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which never cross a document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def per_document(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For sorted positions, the index of the first one of each document, and their number at last."""
    return np.searchsorted(positions, offsets, side="left")


def windows(words: np.ndarray, first: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside a document, and where each starts.

    first: index of each document's first word, and the number of words at last.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    factors = stream(salt, width) | U64(1)
    with np.errstate(over="ignore"):
        total = words[:n] * factors[0]
        for i in range(1, width):
            total += words[i : n + i] * factors[i]
    good = np.ones(n, dtype=bool)
    for k in range(1, width):  # a run that starts fewer than `width` words before a boundary would cross it
        cross = first[1:-1] - k
        good[cross[(cross >= 0) & (cross < n)]] = False
    at = np.flatnonzero(good)
    return mix(total[at]), at


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
