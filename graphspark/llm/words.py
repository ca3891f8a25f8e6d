"""Words and bytes of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: A random 64-bit value for each byte, and odd multipliers; seeded, so the same everywhere.
_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 17)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[base] = held = (out[0], out[1])
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of value * base**i, one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the values in [start, end), alike for alike runs anywhere."""
    return (sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts]


def window_hashes(values: np.ndarray, width: int, base: int = BASE, step: int = 1 << 16) -> np.ndarray:
    """The hash of every run of ``width`` values, ``step`` runs at a time."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, step):
        part = values[a : a + step + width - 1]
        m = len(part) - width + 1
        sums = prefix_sums(part, base)
        np.multiply(sums[width:] - sums[:m], powers(m, base)[1][:m], out=out[a : a + m])
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True, cut at the offsets."""
    n = len(inside)
    wide = np.zeros(n + 2, bool)
    wide[1:-1] = inside
    begin = inside & ~wide[:-2]
    finish = inside & ~wide[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    begin[cuts] = True
    finish[cuts - 1] = True
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the texts' bytes, and each text's first word (one more
    than texts).  Words don't cross texts."""
    starts, ends = spans(~SPACES[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 100_000) -> np.ndarray:
    """A 64-bit hash of each word, ``step`` words at a time."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        sums = prefix_sums(BYTE[data[s[0] : e[-1]]])
        out[a : a + step] = mix(spans_hash(sums, s - s[0], e - s[0]) + (e - s).astype(np.uint64))
    return out
