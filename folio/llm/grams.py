"""Vectorised token and window names over whole groups of documents (numpy only).

Names are polynomials modulo 2**64 and collide for some inputs by construction, so they may choose candidates but never decide equality."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output; works in x itself."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=_U)
        got[0] = 1
        np.cumprod(got, out=got)
        if len(got) <= 1 << 23:  # a worker keeps 64 MB of powers at most
            _powers[base] = got
    return got[:n]


def prefix(tokens: np.ndarray) -> np.ndarray:
    """Prefix sums of the tokens as a polynomial modulo 2**64; one entry more than tokens."""
    out = np.zeros(len(tokens) + 1, _U)
    np.multiply(tokens, _power(_BASE, len(tokens)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the token sequences [start, end)."""
    got = sums[end]
    got -= sums[start]
    got *= _power(_INVERSE, len(sums))[start]
    got += (end - start).astype(_U) * _U(0x9E3779B97F4A7C15)
    return mix(got)


def grams(sums: np.ndarray, n: int) -> np.ndarray:
    """Names of all n-token windows, by start."""
    m = max(0, len(sums) - n)
    got = sums[n:] - sums[:m]
    got *= _power(_INVERSE, m)
    got += _U(n * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(got)


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def cut(data: np.ndarray, ends: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a separator; a document's end, too, ends a run."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = ends[:-1][(ends[:-1] < len(data))]
    begins = begins[begins > 0]
    first[begins] = inside[begins]
    last[begins - 1] = inside[begins - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words_in(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words (runs without ASCII white space) each line [start, end) has."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[starts] = solid[starts]
    total = np.r_[0, np.cumsum(first)]
    return total[ends] - total[starts]


def window_minima(names: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive names."""
    got, have = names, 1
    while have < width and len(got):
        step = min(have, width - have)
        got = np.minimum(got[: max(0, len(got) - step)], got[step:])
        have += step
    return got


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each 64-bit value lies in the sorted array `among`."""
    out = np.zeros(len(values), bool)
    if not len(among) or not len(values):
        return out
    table = np.zeros(1 << 22, bool)
    table[(among >> _U(42)).astype(np.int64)] = True
    some = np.flatnonzero(table[(values >> _U(42)).astype(np.int64)])
    at = np.searchsorted(among, values[some])
    at[at == len(among)] = 0
    out[some[among[at] == values[some]]] = True
    return out
