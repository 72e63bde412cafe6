"""Best-fit-decreasing over a histogram of sizes.

Items of one size are interchangeable, so a driver needs (size, count) pairs only:
over ``T`` units of total size there are fewer than ``sqrt(2 * T)`` distinct sizes,
whatever the number of items. Items keep their identity on the executors, where
their rank within the size picks the placement.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Node:
    __slots__ = ("key", "prio", "left", "right")

    def __init__(self, key, prio):
        self.key, self.prio, self.left, self.right = key, prio, None, None


class CapacityTree:
    """Treap of (remaining capacity, bin); ``ceiling`` finds the tightest bin that fits."""

    def __init__(self, seed: int = 1):
        self._root, self._rng, self._len = None, np.random.default_rng(seed), 0

    def __len__(self):
        return self._len

    def _split(self, node, key):
        """(keys < key, keys >= key)"""
        if node is None:
            return None, None
        if node.key < key:
            a, b = self._split(node.right, key)
            node.right = a
            return node, b
        a, b = self._split(node.left, key)
        node.left = b
        return a, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.prio > b.prio:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, key) -> None:
        a, b = self._split(self._root, key)
        self._root, self._len = self._merge(self._merge(a, _Node(key, self._rng.random())), b), self._len + 1

    def remove(self, key) -> None:
        """Take out ``key``, which must be present."""
        parent, node = None, self._root
        while node.key != key:
            parent, node = node, node.left if key < node.key else node.right
        rest = self._merge(node.left, node.right)
        if parent is None:
            self._root = rest
        elif parent.left is node:
            parent.left = rest
        else:
            parent.right = rest
        self._len -= 1

    def ceiling(self, key):
        node, best = self._root, None
        while node is not None:
            if node.key >= key:
                best, node = node.key, node.left
            else:
                node = node.right
        return best


@dataclass(frozen=True)
class Placement:
    """Ranks ``lo`` to ``hi`` (exclusive) of the items of ``size`` go to ``bin``."""

    size: int
    lo: int
    hi: int
    bin: int


def fill(hist: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[Placement], int] | None:
    """Best-fit-decreasing into bins of ``capacity``; None once more than ``most`` are needed.

    ``hist`` holds (size, count). After an item enters the tightest bin, that bin is
    tighter still, so further items of the size enter it while they fit: each step
    places a run of equal items. An item over the capacity gets a bin of its own.
    """
    tree, out, bins = CapacityTree(), [], 0
    for size, count in sorted(hist, reverse=True):
        done = 0
        while done < count:
            key = tree.ceiling((size, -1))
            if key is None:
                if most is not None and bins == most:
                    return None
                rem, b, bins = max(capacity, size), bins, bins + 1
            else:
                rem, b = key
                tree.remove(key)
            k = min(count - done, rem // size) if size else count - done
            out.append(Placement(size, done, done + k, b))
            tree.insert((rem - k * size, b))
            done += k
    return out, bins


def even(hist: list[tuple[int, int]], shards: int) -> list[Placement]:
    """All items into ``shards`` bins of the least capacity at which best fit needs no more.

    An item above the even share takes a shard of its own, and the share of the rest is
    worked out again over the shards that are left.
    """
    left, own, taken = dict(hist), [], 0
    total = sum(s * c for s, c in hist)
    ranks: dict[int, int] = {}
    for size in sorted(left, reverse=True):
        while left[size] and shards - taken > 1 and size * (shards - taken) > total:
            own.append(Placement(size, ranks.get(size, 0), ranks.get(size, 0) + 1, taken))
            ranks[size], left[size], total, taken = ranks.get(size, 0) + 1, left[size] - 1, total - size, taken + 1
    rest = [(s, c) for s, c in left.items() if c]
    if not rest:
        return own
    n = shards - taken
    low = max(-(-total // n), max(s for s, _ in rest))
    step, got, bad = 0, fill(rest, low, n), low
    while got is None:
        bad, step = low + step, max(1, step * 4)
        got = fill(rest, low + step, n)
    good = low + step
    while good - bad > max(1, low // 1_000_000):
        mid = (good + bad) // 2
        trial = fill(rest, mid, n)
        good, bad, got = (mid, bad, trial) if trial else (good, mid, got)
    shift = lambda p: ranks.get(p.size, 0)
    return own + [Placement(p.size, p.lo + shift(p), p.hi + shift(p), p.bin + taken) for p in got[0]]
