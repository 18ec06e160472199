"""Parts of sets by which close pairs meet: pigeonhole projections of a Jaccard space."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Radius:
    """Sets are close if percent * |union| <= 100 * |intersection|."""

    percent: int

    @property
    def distance(self) -> float:
        return 1 - self.percent / 100

    def close(self, shared: np.ndarray, union: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * union

    def differing(self, size: int) -> int:
        """Elements in which a close pair can differ, whose smaller set has this size."""
        return size * (100 - self.percent) // self.percent

    def partner(self, size: int) -> int:
        """The largest size of a set close to one of this size."""
        return size * 100 // self.percent


@lru_cache(maxsize=1 << 16)
def size_classes(radius: Radius, size: int) -> list[tuple[int, int]]:
    """The classes of sizes (first, behind the last) in which a set of this size is filed: its own, and the next if a partner can be there.

    Classes grow by a quarter, or by as much as one partner's size: nobody's partner is two classes away.
    """
    low = 1
    while True:
        high = max(low + 1, low * 5 // 4, radius.partner(low) + 1)
        if size < high:
            break
        low = high
    out = [(low, high)]
    if radius.partner(size) >= high:
        out.append((high, max(high + 1, high * 5 // 4, radius.partner(high) + 1)))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def part_keys(hashes: np.ndarray, radius: Radius) -> np.ndarray:
    """Keys of the projected regions of one set: sets within the radius that differ have one in common.

    There is a key for each part that is not empty. A pair that agrees in enough parts might agree in empty ones alone:
    so there are some more parts than needed, and a set with more empty parts than that is filed under a next way of
    dealing too, until it has few enough. Sets too small to differ within the radius have no key.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    out = []
    for low, high in size_classes(radius, len(hashes)):
        needed = radius.differing(high - 1) + 1
        if needed < 2:
            continue
        spare = 1 + needed // 16
        parts, way = needed + spare, 0
        while True:
            salt = np.uint64((low * 1024 + way) * 0x9E3779B97F4A7C15 % (1 << 64))
            h = mixed(hashes + salt)
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part)
            part = part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            out.append(mixed(np.add.reduceat(mixed(h[order] + np.uint64(1)), first) + mixed(part[first] * np.uint64(1 << 40) + salt)))
            if parts - len(first) <= spare:
                break
            way += 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
