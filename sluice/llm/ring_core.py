"""A consistent-hash ring with virtual nodes and bounded loads (no Spark here)."""

from __future__ import annotations

import hashlib

import numpy as np

VIRTUAL = 64


def virtual_nodes(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Positions (signed 64-bit, rising) and shards of the ring's virtual nodes."""
    at = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def row_bounds(n: int, shards: int) -> list[int]:
    """Most rows that each shard takes: they sum to n and differ by one at most."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def arcs_of(positions: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The virtual node that each position comes to first, clockwise."""
    return np.searchsorted(nodes, positions) % len(nodes)


def deal(counts: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first place in the arc, shard, rows): which keys of each arc go where.

    All keys try the node they come to first; a node's keys enter its shard
    while there is room, arc by arc in ring order. Keys that find it full go on
    to the next node clockwise, round after round, until all have a shard. What
    enters a shard is always a run of neighbouring keys.
    """
    n = len(counts)
    room, placed = list(bounds), []
    waiting = [[(k, 0, counts[k])] if counts[k] else [] for k in range(n)]  # at each node: (arc, first place, rows)
    while any(waiting):
        onward: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for node in range(n):
            for arc, first, rows in waiting[node]:
                taken = min(rows, room[owners[node]])
                room[owners[node]] -= taken
                if taken:
                    placed.append((arc, first, owners[node], taken))
                if rows > taken:
                    onward[(node + 1) % n].append((arc, first + taken, rows - taken))
        waiting = onward
    return sorted(placed)


class Assignment:
    """From a key's place on the whole ring (its rank among all keys, in ring order) to (shard, slot)."""

    def __init__(self, counts: list[int], first_rank: list[int], owners: list[int], shards: int) -> None:
        runs = sorted((first_rank[arc] + first, rows, shard) for arc, first, shard, rows in deal(counts, owners, row_bounds(sum(counts), shards)))
        filled = [0] * shards
        self.begins, self.shards, self.slots = [], [], []
        for begin, rows, shard in runs:
            self.begins.append(begin)
            self.shards.append(shard)
            self.slots.append(filled[shard])
            filled[shard] += rows
        self._arrays = tuple(np.array(x, np.int64) for x in (self.begins, self.shards, self.slots))

    def of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, shards, slots = self._arrays
        k = np.searchsorted(begins, ranks, "right") - 1
        return shards[k], slots[k] + ranks - begins[k]
