"""Rank-order n-gram profiles (no Spark here)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import code_points, letter_table, mixed

#: Longest n-gram, and n-grams in a profile.
MAX_N, TOP = 4, 300
_HASH_BITS = 44
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_counts(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram hash, count) of the texts, sorted by group and hash; group gives each text's number, below 2^20.

    Letters are lower-cased; whatever lies between words counts as one blank,
    which an n-gram may have at its ends but not inside.
    """
    lowered = [t.lower() for t in texts]
    codes = code_points("\n" + "\n".join(lowered) + "\n")
    codes = np.where(letter_table()[codes], codes, 0).astype(np.uint64)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    which = np.repeat(np.asarray(group, np.uint64), lengths)
    which = np.r_[which[:1], which]
    keep = (codes != 0) | np.r_[True, codes[:-1] != 0]
    codes, which = codes[keep], which[keep]
    blank = codes == 0
    n, keys = len(codes), []
    value, inner = np.zeros(n, np.uint64), np.zeros(n, np.bool_)
    for size in range(1, MAX_N + 1):
        if n < size:
            break
        if size > 2:  # the last but one is inside now
            inner = inner[: n - size + 1] | blank[size - 2 : n - 1]
        else:
            inner = inner[: n - size + 1]
        value = value[: n - size + 1] * _STEP + codes[size - 1 :] + np.uint64(1)
        ok = ~inner & ~(blank[: n - size + 1] & blank[size - 1 :])
        owner = np.where(blank[: n - size + 1], which[min(1, size - 1) : n - size + 1 + min(1, size - 1)], which[: n - size + 1])
        keys.append((owner[ok] << np.uint64(_HASH_BITS)) | (mixed(value[ok]) >> np.uint64(64 - _HASH_BITS)))
    every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    every.sort()
    at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    distinct = every[at]
    return (distinct >> np.uint64(_HASH_BITS)).astype(np.int64), (distinct & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64), np.diff(np.r_[at, len(every)])


def ranked(group: np.ndarray, grams: np.ndarray, counts: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, rank from 0) of each group's TOP most frequent n-grams; ties go by hash."""
    often = np.bincount(group[counts > 1], minlength=n_groups)
    keep = (counts > 1) | (often[group] < TOP)  # once-only n-grams matter only where others don't fill the profile
    group, grams, counts = group[keep], grams[keep], counts[keep]
    order = np.lexsort((-counts, group))  # stable: the hash order stays among ties
    group, grams = group[order], grams[order]
    begins = np.searchsorted(group, np.arange(n_groups))
    rank = np.arange(len(group)) - begins[group] if len(group) else np.empty(0, np.int64)
    first = rank < TOP
    return group[first], grams[first], rank[first]


@dataclass
class Profiles:
    """Language names and, for each, its n-grams (sorted) with their ranks."""

    names: list[str]
    grams: list[np.ndarray]
    ranks: list[np.ndarray]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Nearest language by out-of-place distance, and 1 less the distance's share of the largest possible one."""
        n = len(texts)
        group, grams, rank = ranked(*gram_counts(texts, np.arange(n)), n)
        size = np.bincount(group, minlength=n)
        if not self.names:
            return ["und"] * n, [0.0] * n
        far = np.empty((len(self.names), n))
        for k, (own, at) in enumerate(zip(self.grams, self.ranks, strict=True)):
            i = np.minimum(np.searchsorted(own, grams), len(own) - 1)
            off = np.where(own[i] == grams, np.minimum(np.abs(at[i] - rank), TOP), TOP)
            far[k] = np.bincount(group, weights=off, minlength=n)
        best = far.argmin(axis=0)
        least = far[best, np.arange(n)]
        score = np.where(size > 0, 1 - least / np.maximum(size * TOP, 1), 0.0)
        return [self.names[b] if s else "und" for b, s in zip(best.tolist(), size.tolist(), strict=True)], np.clip(score, 0, 1).tolist()
