"""SimHash fingerprints and the generalised-pigeonhole plan (no Spark here).

``fingerprint`` follows the contract of ``op7``: ASCII-lower-cased words cut at
ASCII white space, four-word shingles with repeats, XXH64 with seed 42, and a
majority vote per bit. ``sketch`` gives what the pipeline's stage compares: a
fingerprint of the distinct words, which few edits change little, and a wide one
of the distinct five-word shingles, whose equal bits tell the shingles' Jaccard
similarity.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

from .words import mixed

SHINGLE_WORDS = 4
SEED = 42
MAX_DISTANCE = 4
_BLOCK = 1 << 14


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the space-joined runs of size words; of the whole sequence where it is shorter."""
    n = len(words)
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.empty(n, np.int64)
    begins[0] = 0
    begins[1:] = ends[:-1] + 1
    total = n - size + 1
    cuts = zip(begins[:total].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in cuts], repeat(SEED)), np.uint64, total)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of hashes with one or more 64-bit words each (rows): the bits that are set in over half of them, as 64-bit words."""
    table = hashes.reshape(len(hashes), -1)
    votes = np.zeros(64 * table.shape[1], np.int64)
    for k in range(0, len(table), _BLOCK):
        block = np.unpackbits(np.ascontiguousarray(table[k : k + _BLOCK]).view(np.uint8), axis=1, bitorder="little")
        votes += block.sum(axis=0, dtype=np.uint32)
    return np.packbits(votes * 2 > len(table), bitorder="little").view(np.uint64)


def fingerprint(data: bytes | None) -> int:
    """64-bit SimHash of a UTF-8 text; None and texts without a word give zero."""
    words = data.lower().split() if data else []
    return int(_majority(_hashes(words, SHINGLE_WORDS))[0]) if words else 0


#: Words of a shingle of the wide fingerprint, its 64-bit words, and the least similarity that counts as near.
WIDE_WORDS, WIDE, SIMILARITY = 5, 4, 0.8
#: Bits that the word fingerprints of near texts differ in at most.
WORD_DISTANCE = 4


def sketch(data: bytes | None) -> tuple[int, bytes]:
    """The fingerprint of a text's distinct words, and that of its distinct five-word shingles; zeros without a word."""
    words = data.lower().split() if data else []
    if not words:
        return 0, bytes(8 * WIDE)
    each = np.fromiter(map(xxhash.xxh64_intdigest, set(words), repeat(SEED)), np.uint64)
    shingles = np.unique(_hashes(words, WIDE_WORDS))
    wide = np.column_stack([shingles, *(mixed(shingles + np.uint64(k)) for k in range(1, WIDE))])
    return int(_majority(each)[0]), _majority(wide).tobytes()


def wide_distance(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits that the wide fingerprints of two shingle sets of this Jaccard similarity differ in, and one standard deviation more.

    The sets' cosine is 2s / (1 + s), and each bit differs with the angle's share of a half turn.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + np.sqrt(bits * share * (1 - share))))


# --- the plan: correlated bits together, thresholds by dynamic programming ---

#: Relative costs of writing one signature and of comparing one candidate.
COST_SIGNATURE, COST_COMPARE = 200.0, 1.0
_ALL = (1 << 64) - 1


def arrange(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Cuts the 64 bits into parts of near equal width, correlated bits together.

    Each part starts from the free bit with most correlation to the others and
    takes the bits that go with those it has. What varies together then sits in
    one part, and the other parts tell texts apart better.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    spread = bits - bits.mean(axis=0) if len(sample) else np.zeros((1, 64))
    scale = np.sqrt((spread**2).mean(axis=0))
    scale[scale == 0] = np.inf
    tied = np.abs((spread.T @ spread) / max(1, len(spread)) / np.outer(scale, scale))
    np.fill_diagonal(tied, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        chosen = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        free.remove(chosen[0])
        while len(chosen) < width:
            chosen.append(max(free, key=lambda b: (tied[b, chosen].sum(), -b)))
            free.remove(chosen[-1])
        out.append(sorted(chosen))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def within(sample: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0..most of the bits: the larger of what pairs of the sample show and of what independent bits would give."""
    mask = np.uint64(mask_of(bits))
    n = len(sample)
    seen = np.zeros(most + 1)
    shifts = [s for s in range(1, 65) if s < n]
    for s in shifts:
        d = np.bitwise_count((sample ^ np.roll(sample, s)) & mask)
        seen += [(d <= t).sum() for t in range(most + 1)]
    seen /= max(1, n * len(shifts))
    ones = np.array([((sample >> np.uint64(b)) & np.uint64(1)).mean() if n else 0.5 for b in bits])
    differ = 2 * ones * (1 - ones)
    chance = np.zeros(len(bits) + 1)
    chance[0] = 1
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.maximum(seen, np.r_[np.cumsum(chance), np.ones(most + 1)][: most + 1]).tolist()


def n_variants(width: int, threshold: int) -> int:
    """Keys that one fingerprint has in a part: those within the threshold of its own."""
    total, ways = 0, 1
    for t in range(threshold + 1):
        total += ways
        ways = ways * (width - t) // (t + 1)
    return total


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 (-1: the part is left out) with sum(t_i + 1) = tau + 1 and least summed cost.

    By the generalised pigeonhole principle two fingerprints within tau differ
    in at most t_i bits of some part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, tau - used + 1):
                now = cost + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in step or now < step[used + t + 1][0]:
                    step[used + t + 1] = (now, [*chosen, t])
        best = step
    return best[tau + 1]


def plan(sample: np.ndarray, n: int, tau: int = MAX_DISTANCE) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, flips) of each part that is used, for n distinct fingerprints; flips[0] is 0."""
    n = max(n, 1)  # an empty table would make every plan cost nothing, the one with most signatures too
    best = None
    for m in range(2, max(7, tau + 2)):
        parts = arrange(sample, m)
        costs = []
        for bits in parts:
            share = within(sample, bits, tau)
            costs.append([n * n_variants(len(bits), t) * COST_SIGNATURE + n * n * share[t] * COST_COMPARE if t <= len(bits) else np.inf for t in range(tau + 1)])
        cost, chosen = allocate(costs, tau)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0])
    return [(mask_of(bits), t, flips(bits, t)) for bits, t in best[1]]


def flips(bits: list[int], threshold: int) -> list[int]:
    """All masks of at most threshold of the bits, the empty one first."""
    out, last = [0], [(0, 0)]
    for _ in range(threshold):
        last = [(m | 1 << bits[k], k + 1) for m, begin in last for k in range(begin, len(bits))]
        out += [m for m, _ in last]
    return out


# --- verification inside one partition, sorted by key ---

#: Rows of a run that give all their links, pairs compared at once, and links a row from which a run counts as dense.
_SMALL, _PAIRS, _DENSE = 32, 1 << 18, 8


class Verifier:
    """Tells which rows are near: fingerprints within tau and, where there are wide ones, these within wide_tau."""

    def __init__(self, fps: np.ndarray, tau: int, wide: np.ndarray | None = None, wide_tau: int = 0) -> None:
        self.fps, self.tau, self.wide, self.wide_tau = fps, tau, wide, wide_tau

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of row numbers (arrays that broadcast) whether they are near."""
        ok = np.bitwise_count(self.fps[a] ^ self.fps[b]) <= self.tau
        if self.wide is not None and ok.any():
            at = np.nonzero(ok)
            x, y = (np.broadcast_to(k, ok.shape)[at] for k in (a, b))
            ok[at] = np.bitwise_count(self.wide[x] ^ self.wide[y]).sum(axis=1, dtype=np.int64) <= self.wide_tau
        return ok


def links(keys: np.ndarray, own: np.ndarray, nodes: np.ndarray, verify: Verifier) -> tuple[np.ndarray, np.ndarray]:
    """Links between near rows of the same key (keys are sorted), as the rows' nodes.

    own tells the rows that are indexed under their own bits from those that
    probe; of a pair at least one is. Runs of up to 32 rows give all their
    links. Longer ones do, too, unless these are many: then each row looks only
    at rows that no other has reached yet, so a run gives the edges of a
    spanning forest, its components stay whole, and a dense run of s rows gives
    s - 1 edges.
    """
    n = len(keys)
    if n < 2:
        return nodes[:0], nodes[:0]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[begins, n])
    left, right = [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    for k in range(1, min(_SMALL, int(sizes[sizes <= _SMALL].max(initial=0)))):
        at = np.flatnonzero((keys[k:] == keys[:-k]) & small[k:])
        if not len(at):
            break
        at = at[own[at] | own[at + k]]
        at = at[verify.near(at, at + k)]
        left.append(at)
        right.append(at + k)
    for begin, size in zip(begins[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        rows = np.arange(begin, begin + size)
        a, b = _run_links(rows[own[rows]], rows[~own[rows]], verify)
        left.append(a)
        right.append(b)
    if not left:
        return nodes[:0], nodes[:0]
    a, b = nodes[np.concatenate(left)], nodes[np.concatenate(right)]
    return a[a != b], b[a != b]


def _run_links(own: np.ndarray, probes: np.ndarray, verify: Verifier) -> tuple[np.ndarray, np.ndarray]:
    """Links within one run, as pairs of row numbers."""
    rows = np.r_[own, probes]
    left, right, found = [own[:0]], [own[:0]], 0
    step = max(1, _PAIRS // len(rows))
    for k in range(0, len(own), step):
        block = own[k : k + step]
        i, j = np.nonzero(np.triu(verify.near(block[:, None], rows[None, k:]), 1))
        found += len(i)
        if found > _DENSE * len(rows):
            return _forest(own, probes, verify)
        left.append(block[i])
        right.append(rows[k + j])
    return np.concatenate(left), np.concatenate(right)


def _forest(own: np.ndarray, probes: np.ndarray, verify: Verifier) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one run. Each tree begins at a row of its own, since two probes don't link."""
    left, right = [own[:0]], [own[:0]]
    queue: list[tuple[int, bool]] = []
    while queue or len(own):
        if queue:
            x, is_own = queue.pop()
        else:
            x, is_own, own = int(own[0]), True, own[1:]
        near = verify.near(own, np.full(len(own), x))
        queue.extend((k, True) for k in own[near].tolist())
        found, own = own[near], own[~near]
        if is_own:
            near = verify.near(probes, np.full(len(probes), x))
            queue.extend((k, False) for k in probes[near].tolist())
            found, probes = np.r_[found, probes[near]], probes[~near]
        left.append(np.full(len(found), x))
        right.append(found)
    return np.concatenate(left), np.concatenate(right)
