"""Rolling hashes over the bytes of whole batches, and the words in them.

The prefix sums ``S[i] = sum(T[b[j]] * B**j, j < i)`` modulo the prime 2**31 - 1, kept for two bases,
give the hash of any range as ``(S[e] - S[s]) * B**-s``, so every word, line or window costs a few
look-ups. T holds a fixed random value per byte. Two different strings of n bytes have one value for
both bases with a probability of at most ``(n / 2**31)**2`` over the choice of the bases, whatever the
strings are, and of about ``2**-62`` for strings that weren't made for these bases. Where more rests on
a hash than the comparisons inside one text, bytes or a second hash are compared as well.
"""

from __future__ import annotations

import numpy as np

PRIME = 2**31 - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLES = _RNG.integers(1, PRIME, (2, 256), dtype=np.uint64)
_BASES = [int(x) for x in _RNG.integers(2**20, PRIME, 2)]
_INVERSES = [pow(x, -1, PRIME) for x in _BASES]
_power: dict[int, np.ndarray] = {}
_STEP = 1 << 15

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_TABLE = LOWER.tobytes()


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo PRIME; kept, and grown in steps of half a million."""
    have = _power.get(base)
    if have is None or len(have) < n:
        out, size = np.ones(1, np.uint32), -(-n >> 19) << 19
        while len(out) < size:
            out = np.concatenate([out, (out[: size - len(out)].astype(np.uint64) * np.uint64(pow(base, len(out), PRIME)) % _P).astype(np.uint32)])
        _power[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """The sums for both bases, a row each; every term is below 2**32, so that they don't wrap."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for table, base, to in zip(_TABLES, _BASES, out, strict=True):
        power = powers(base, len(data))
        for i in range(0, len(data), _STEP):  # in pieces that stay in the processor's cache
            term = table[data[i : i + _STEP]]
            term *= power[i : i + _STEP]
            high = term >> _BITS
            term &= _P
            term += high
            part = to[i + 1 : i + 1 + len(term)]
            np.cumsum(term, out=part)
            part += to[i]
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges ``start:end``; ranges of different lengths differ too."""
    a, b = ((s[end] - s[start]) % _P * powers(i, len(s))[start] % _P for s, i in zip(sums, _INVERSES, strict=True))
    return mix((a | (b << _BITS)) + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_SECOND = np.uint64(0x9E3779B97F4A7C15)


def two_hashes(sums: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of ranges: that of ``range_hash`` and one modulo 2**64."""
    power = np.cumprod(np.full(len(data), _SECOND)) if len(data) else np.zeros(0, np.uint64)
    power *= _TABLES[1][data]
    other = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(power, out=other[1:])
    power = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_SECOND), -1, 2**64))))
    return range_hash(sums, start, end), mix((other[end] - other[start]) * power[start])


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    n = max(0, len(data) - 7)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy() if n else np.zeros(0, np.uint64)


def same_bytes(one: np.ndarray, start: np.ndarray, other: np.ndarray, where: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``one[start:start + size]`` equals ``other[where:where + size]``, for arrays of ranges."""
    stop = np.cumsum(size)
    step = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)
    odd = one[np.repeat(start, size) + step] != other[np.repeat(where, size) + step]
    return np.diff(np.concatenate([[0], np.cumsum(odd)])[np.concatenate([[0], stop])]) == 0


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` that don't cross an offset."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    edge = offsets[(offsets > 0) & (offsets < len(member))]
    first[edge] |= member[edge]
    last[edge - 1] |= member[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the n + 1 positions of each row's words among them."""
    start, end = spans(~SPACE[data], offsets)
    return start, end, np.searchsorted(start, offsets)
