"""Suffix arrays over many short passages at once, by rank doubling.

Passages lie one after another in one array of symbols; a passage belongs to a block, and suffixes of different blocks never
match. ``ranks[i]`` numbers the first 2**i symbols of every suffix (a suffix that ends earlier is told apart by its length),
so the order of the last level is the suffix array, and two suffixes' common prefix is read off the levels from the top.
"""

from __future__ import annotations

import numpy as np


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1."""
    return np.unique(key, return_inverse=True)[1].astype(np.int32) + np.int32(1)


class Suffixes:
    """s: symbols, 64-bit ids or bytes; lengths: of the passages in it, none empty; block: the block of each passage, or None
    if all are in one. Ids are ordered by value, bytes alphabetically."""

    def __init__(self, s: np.ndarray, lengths: np.ndarray, block: np.ndarray | None = None) -> None:
        self.base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.passage = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        n, at, h = len(s), np.arange(len(s), dtype=np.int32), 1
        self.ends = self.base + lengths
        self.left = self.ends.astype(np.int32)[self.passage] - at

        def later(x: np.ndarray) -> np.ndarray:
            """x of the suffix h symbols on, 0 past the passage's end."""
            return np.where(self.left > h, x[np.minimum(at + h, n - 1)], 0)

        self.ranks = []
        if s.dtype == np.uint8 and block is None:
            key = s.astype(np.uint64)
            while h < 8:  # up to eight bytes are their own rank
                self.ranks.append(key.astype(f"u{h}"))
                key = key << np.uint64(8 * h) | later(key).astype(np.uint64)
                h *= 2
            rank = _dense(key)
        else:
            rank = _dense(s)
            if block is not None:
                rank = _dense(_dense(block)[self.passage].astype(np.int64) * (n + 1) + rank)
        self.ranks.append(rank)
        while h < int(lengths.max()):
            rank = _dense(rank.astype(np.int64) * (n + 1) + later(rank))
            self.ranks.append(rank)
            h *= 2
        self.order = np.argsort(rank, kind="stable")
        self._near: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, which stay inside their passages."""
        n, size = len(self.left), np.zeros(len(a), np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            same = size + (1 << level) <= most
            same &= rank[np.minimum(a + size, n - 1)] == rank[np.minimum(b + size, n - 1)]
            size += same.astype(np.int64) << level
        return size

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By place: its rank, and the ranks before and after it that are the nearest of other passages."""
        if self._near is None:
            n = len(self.order)
            owner = self.passage[self.order]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
            rank = np.empty(n, np.int64)
            rank[self.order] = np.arange(n)
            self._near = rank, heads[run] - 1, np.append(heads[1:], n)[run]
        return self._near

    def longest_at(self, places: np.ndarray) -> np.ndarray:
        """For each of the places, the length of its longest match with a place of another passage: the nearest neighbours in
        the suffix array that lie in other passages have it."""
        rank, before, after = self._neighbours()
        best = np.zeros(len(places), np.int64)
        for near in (before[rank[places]], after[rank[places]]):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            best[ok] = np.maximum(best[ok], self.common(places[ok], self.order[near[ok]]))
        return best


def factored(index: Suffixes, whole: np.ndarray, window: int) -> np.ndarray:
    """Relative Lempel-Ziv parse of every passage of a block against the block's other passages: which windows repeat.

    From the first symbol not yet parsed, a factor is the longest match with another passage (of a passage in ``whole``,
    which stands elsewhere too, all the rest of it), or one symbol. Matches are only looked up where a factor begins. Windows
    inside a factor repeat. At a factor boundary, a window that crosses it can only repeat if the next factor covers all
    that lies beyond, as that factor's match is at least as long; the windows of which this holds cross no other boundary,
    and are looked up in the index. All other windows are new. The answer is by place; places within ``window`` - 1 of a
    passage's end start no window.
    """
    n = len(index.left)
    size, starts = np.zeros(n, np.int64), np.zeros(n, bool)
    at, stop = index.base.copy(), index.ends
    while len(at):
        starts[at] = True
        size[at] = np.where(whole[index.passage[at]], index.left[at], index.longest_at(at))
        at = at + np.maximum(size[at], 1)
        live = at < stop
        at, stop = at[live], stop[live]
    found = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(size >= window)  # duplicate spans
    found[long] += 1
    found[long + size[long] - window + 1] -= 1
    found = np.cumsum(found[:-1]) > 0
    first = np.flatnonzero(starts)
    before, here = first[:-1], first[1:]
    joined = index.passage[before] == index.passage[here]
    before, here = before[joined], here[joined]
    low, high = np.maximum(before, here - window + 1), np.minimum(here - 1, here + size[here] - window)
    count = np.maximum(high - low + 1, 0)
    crossing = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    found[crossing[index.longest_at(crossing) >= window]] = True
    return found


def _equal_windows(index: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all windows in the order of the suffix array, and where each run of equal windows begins: they lie side by
    side, with common prefixes of ``window`` symbols or more."""
    order = index.order[index.left[index.order] >= window]
    return order, np.flatnonzero(np.append(True, index.common(order[:-1], order[1:]) < window)) if len(order) else order


def _spread_back(index: Suffixes, order: np.ndarray, heads: np.ndarray, flags: np.ndarray) -> np.ndarray:
    found = np.zeros(len(index.left), bool)
    found[order] = np.repeat(flags, np.diff(np.append(heads, len(order))))
    return found


def across(index: Suffixes, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """By place: which windows stand in two documents, where a passage's documents range from lo to hi."""
    order, heads = _equal_windows(index, window)
    owner = index.passage[order]
    return _spread_back(index, order, heads, np.minimum.reduceat(lo[owner], heads) < np.maximum.reduceat(hi[owner], heads) if len(order) else heads)


def twice(index: Suffixes, n: np.ndarray, window: int) -> np.ndarray:
    """By place: which windows stand twice, where a passage stands n times."""
    order, heads = _equal_windows(index, window)
    return _spread_back(index, order, heads, np.add.reduceat(n[index.passage[order]], heads) > 1 if len(order) else heads)
