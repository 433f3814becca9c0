"""Words of many texts at once as arrays: positions and 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.bool_, 0x110000)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first character, end character, hash) of each lower-cased word, in order.

    Words are runs of letters and digits. Characters count from the start of
    the lower-cased text. A hash is never zero.
    """
    lowered = [t.lower() for t in texts]
    codes = code_points("\n".join(lowered))
    if not len(codes):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    inside = alnum_table()[codes]
    edge = np.diff(inside, prepend=False, append=False)
    at = np.flatnonzero(edge)
    begins, ends = at[::2], at[1::2]
    up, down = power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=total[1:])
    hashes = mixed((total[ends] - total[begins]) * down[begins])
    hashes[hashes == 0] = 1
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    offsets = np.cumsum(lengths) - lengths
    which = np.searchsorted(offsets, begins, "right") - 1
    return which, begins - offsets[which], ends - offsets[which], hashes


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; run k begins at word k."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_P) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)
