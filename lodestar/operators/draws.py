"""Poisson weights of resamples from md5, many at a time: numpy kernels for Arrow batches.

The draws are fixed by their SQL: resample 4b + i + 1 of a unit reads the i-th 28-bit part of md5('seed:b:id'). One md5 for
each unit and block of four resamples can't be saved, so all of a batch are made together, one word operation at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Cumulative probabilities of a Poisson(1) count, to 7 counts.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]

#: Resamples that one md5 serves, with 28 bits each.
SHARE = 4

#: Pairs of a unit and a block that are hashed together: the arrays of a step stay in the cache of a core.
GRID = 16384

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four words of the md5 of padded messages, given as little-endian words that broadcast to the shape."""
    state = [np.full(shape, s, np.uint32) for s in _START]
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            turn = i // 16
            if turn == 0:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                k = i
            elif turn == 1:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                k = (5 * i + 1) % 16
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                k = (3 * i + 5) % 16
            else:
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                k = 7 * i % 16
            np.add(a, f, out=a)
            np.add(a, words[at + k] + np.uint32(_SINES[i]), out=a)
            s = _SHIFTS[turn][i % 4]
            np.left_shift(a, np.uint32(s), out=t)
            np.right_shift(a, np.uint32(32 - s), out=a)
            np.bitwise_or(a, t, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        for s, x in zip(state, (a, b, c, d), strict=True):
            np.add(s, x, out=s)
    return state


def _parts(words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four 28-bit numbers in the hexadecimal digits of each md5."""
    a, b, c, d = (x.byteswap() for x in _md5(words, shape))
    low = lambda x, bits: (x & np.uint32((1 << bits) - 1)) << np.uint32(28 - bits)
    return [a >> np.uint32(4), low(a, 4) | b >> np.uint32(8), low(b, 8) | c >> np.uint32(12), low(c, 12) | d >> np.uint32(16)]


def _words(texts: list[bytes], before: int, size: int, end: bool) -> np.ndarray:
    """Texts of one length at an offset of an otherwise empty message of `size` bytes; the end carries md5's padding."""
    rows = np.zeros((len(texts), size), np.uint8)
    n = len(texts[0])
    rows[:, before : before + n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
    if end:
        rows[:, before + n] = 0x80
        rows[:, -8:] = np.frombuffer(((before + n) * 8).to_bytes(8, "little"), np.uint8)
    return rows.view("<u4")


def _by_length(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, [texts[i] for i in at]


def uniforms(seed: int, ids: list[str], draws: int, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Blocks b (all of the draws', or only some), places of ids, and for each of the four parts the 28-bit numbers (blocks x ids); every pair comes once."""
    named = np.arange(-(-draws // SHARE)) if only is None else only
    heads = [f"{seed}:{b}".encode() for b in named]
    for places, tails in _by_length([b":" + i.encode() for i in ids]):
        for chosen, fronts in _by_length(heads):
            blocks = named[chosen]
            n = len(fronts[0]) + len(tails[0])
            size = (n + 9 + 63) // 64 * 64
            left, right = _words(fronts, 0, size, False), _words(tails, len(fronts[0]), size, True)
            vary = [bool((right[:, k] != right[0, k]).any()) for k in range(size // 4)]
            wide = min(len(places), GRID)
            tall = max(1, GRID // wide)
            for i in range(0, len(places), wide):
                some = right[i : i + wide]
                for j in range(0, len(blocks), tall):
                    front = left[j : j + tall]
                    words = []
                    for k in range(size // 4):
                        own = some[None, :, k] if vary[k] else some[:1, k][None]
                        words.append(own | front[:, k, None] if front[:, k].any() else own)
                    yield blocks[j : j + tall], places[i : i + wide], _parts(words, (len(front), len(some)))


def _whole(steps: list[float]) -> list[int]:
    """The 28-bit numbers from which on u = number / 2^28 reaches each step."""
    return [math.ceil(s * (1 << 28)) for s in steps]


_ONE = [np.uint32(s) for s in _whole(POISSON)]


def once(u: np.ndarray) -> np.ndarray:
    """How often a single unit is drawn: a Poisson(1) count."""
    w = (u >= _ONE[0]).view(np.uint8)
    for s in _ONE[1:]:
        w = w + (u >= s).view(np.uint8)
    return w


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """As stats.log_factorial."""
    x = n + 1.0
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    return series - np.log(product)


def steps(mean: int) -> tuple[int, np.ndarray]:
    """As resample.steps in 28-bit numbers: how many steps are 0, and the others.

    Terms more than 12 sqrt(mean) + 20 below the mean add less than a double's last digit, so their steps round to 0.
    """
    width = 12 * math.sqrt(mean) + 20
    low = max(0, math.floor(mean - width))
    k = np.arange(low, math.ceil(mean + width) + 1, dtype=np.float64)
    sums = np.cumsum(np.exp(k * math.log(mean) - mean - _log_factorial(k)))
    return low, np.ceil(np.round(sums, 12) * (1 << 28)).astype(np.int64)


def often(u: np.ndarray, counts: np.ndarray, known: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """How often each pair (column) of so many equal units is drawn: a Poisson(count) number."""
    w = once(u).astype(np.float64)
    if counts.max() == 1:
        return w
    for c in np.unique(counts[counts > 1]):
        low, at = known.get(int(c)) or known.setdefault(int(c), steps(int(c)))
        mine = np.flatnonzero(counts == c)
        w[:, mine] = low + np.searchsorted(at, u[:, mine].astype(np.int64), "right")
    return w
