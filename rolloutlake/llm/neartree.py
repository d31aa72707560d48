"""Pairs of word sets within the similarity, found in groups that are held in memory.

A group that is small enough is compared pair by pair. A larger one is taken apart by the least word of each set in a
random order of all words, its parts by a second order, and so on until they are small (a band): two sets within the
similarity stay together in an order with a chance of 0.7 or more. A part that took k orders is compared in the first 3 / 0.7 ** k
bands, so a pair meets three times on the average (not at all with a chance below 0.05), whatever its parts take. A part whose sets
are nearly all within the similarity of one of them would never fall apart: it is linked through that one, and its other sets are compared with all.

Pairs are told by two bitmaps of 128 bits, on which no more bits differ than words do, then by the words themselves, so a pair
that comes out is within the similarity.
"""

from __future__ import annotations

import math

import numpy as np

#: Edits within a similarity of 0.7: so many times the edits are at most so many times the words of both sets.
EDITS, WORDS = 17, 3
#: Largest part that is compared pair by pair, and up to which several parts are compared together.
LEAF, SHORT = 4000, 48
#: Sets beside the one that links a part.
BESIDE = 256
#: Pairs at a similarity of 0.7 that meet in a small part as often as this, on the average.
MEET = 3
#: Orders one after the other from which parts are compared pair by pair whatever their size.
DEEPEST = 8
#: Pairs whose words are compared at once, and that are compared by bitmap at once.
EXACT, TILE = 20_000, 1 << 16
#: Pairs that are collected before repeated ones among them are dropped.
COLLECTED = 4_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal labels begin, and how long they are."""
    starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    return starts, np.diff(np.append(starts, len(label)))


def bands(length: int) -> int:
    """Bands in which a part that took so many orders is compared."""
    return math.ceil(MEET / 0.7**length)


class Sets:
    """Word sets one after the other: ``flat`` numbers their words (below ``vocabulary``), ``n`` their sizes, none of them zero."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, vocabulary: int):
        self.flat, self.n, self.vocabulary = flat.astype(np.int64), n.astype(np.int64), vocabulary
        self.steps = np.arange(len(flat))
        self.first = np.cumsum(self.n) - self.n
        self.names = np.arange(vocabulary, dtype=np.uint64)
        h = mix(self.names + np.uint64(1))
        self.maps = []
        for shift in (0, 7):
            bit, half = np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63)), (h >> np.uint64(shift + 6)) & np.uint64(1)
            self.maps += [np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0))[flat], self.first) for k in (0, 1)]

    def words(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of some sets one after the other, and where each set begins."""
        n = self.n[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.first[rows] - ends + n, n)
        at += self.steps[: len(at)] if len(at) <= len(self.steps) else np.arange(len(at))
        return self.flat.take(at), ends - n

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) the bitmaps leave."""
        a, b, c, d = self.maps
        room = (WORDS * (self.n[i] + self.n[j])) // EDITS
        at = np.flatnonzero(np.bitwise_count(a[i] ^ a[j]).astype(np.int64) + np.bitwise_count(b[i] ^ b[j]) <= room)
        i, j = i[at], j[at]
        return at[np.bitwise_count(c[i] ^ c[j]).astype(np.int64) + np.bitwise_count(d[i] ^ d[j]) <= room[at]]

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs (i, j) are within the similarity, by their words."""
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), EXACT):
            x, y = i[at : at + EXACT], j[at : at + EXACT]
            sizes = self.n[x], self.n[y]
            pair = np.concatenate([np.repeat(np.arange(len(x)), s) for s in sizes])
            both = np.sort(pair * self.vocabulary + np.concatenate([self.words(x)[0], self.words(y)[0]]))
            shared = np.bincount(both[1:][both[1:] == both[:-1]] // self.vocabulary, minlength=len(x))
            joint = sizes[0] + sizes[1]
            out[at : at + EXACT] = EDITS * (joint - 2 * shared) <= WORDS * joint
        return out


class Finder:
    """Collects the pairs of the groups of some sets."""

    def __init__(self, sets: Sets):
        self.sets, self.found, self.held = sets, [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.found.append(np.minimum(i, j) * len(self.sets.n) + np.maximum(i, j))
            self.held += len(i)
            if self.held > COLLECTED:
                self.found = [np.unique(np.concatenate(self.found))]
                self.held = len(self.found[0]) // 2

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within the similarity so far, each once."""
        if not self.found:
            return np.zeros((2, 0), np.int64)
        every = np.unique(np.concatenate(self.found))
        i, j = np.divmod(every, len(self.sets.n))
        keep = self.sets.similar(i, j)
        return i[keep], j[keep]

    def one_by_one(self, rows: np.ndarray, sizes: np.ndarray) -> None:
        """Compares the pairs of each run of rows; ``sizes`` are those of the runs."""
        ends = np.cumsum(sizes)
        for end, size in zip(ends[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            self.within(rows[end - size : end])
        left = np.where(np.repeat(sizes <= SHORT, sizes), np.repeat(ends, sizes) - np.arange(len(rows)) - 1, 0)
        at, gap = np.flatnonzero(left), 1
        while len(at):
            for lo in range(0, len(at), TILE):
                i, j = rows[at[lo : lo + TILE]], rows[at[lo : lo + TILE] + gap]
                keep = self.sets.near(i, j)
                self.add(i[keep], j[keep])
            gap += 1
            at = at[left[at] >= gap]

    def within(self, rows: np.ndarray) -> None:
        """Compares all rows with each other, in tiles."""
        a, b = (m[rows] for m in self.sets.maps[:2])
        n = self.sets.n[rows]
        room = np.minimum(WORDS * (n + n.max()) // EDITS, 255).astype(np.uint8)
        lo = 0
        while lo < len(rows) - 1:
            until = min(len(rows), lo + max(1, TILE // (len(rows) - lo)))
            for top in range(lo + 1, len(rows), TILE):
                c, d = a[top : top + TILE], b[top : top + TILE]
                apart = np.bitwise_count(a[lo:until, None] ^ c)
                apart += np.bitwise_count(b[lo:until, None] ^ d)
                x, y = np.divmod(np.flatnonzero(apart <= room[lo:until, None]), len(c))
                x, y = x + lo, y + top
                i, j = rows[x[x < y]], rows[y[x < y]]
                keep = self.sets.near(i, j)
                self.add(i[keep], j[keep])
            lo = until

    def with_all(self, some: np.ndarray, rows: np.ndarray) -> None:
        """Compares each of some rows with all rows."""
        step = max(1, TILE // len(rows))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            i, j = np.repeat(part, len(rows)), np.tile(rows, len(part))
            keep = self.sets.near(i, j)
            keep = keep[i[keep] != j[keep]]
            self.add(i[keep], j[keep])

    def through_one(self, rows: np.ndarray, leader: int) -> bool:
        """Links a part through its leader, if nearly all of its sets are within the similarity of that one."""
        here = np.full(len(rows), leader)
        linked = np.zeros(len(rows), bool)
        near = self.sets.near(here, rows)
        linked[near] = self.sets.similar(here[near], rows[near])
        if len(rows) - linked.sum() > BESIDE:
            return False
        own = rows[linked & (rows != leader)]
        self.add(np.full(len(own), leader), own)
        if not linked.all():
            self.with_all(rows[~linked], rows)
        return True

    def small_parts(self, rows: np.ndarray, label: np.ndarray, small: int, compare: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and labels of the parts of more than ``small`` rows that no one set links; the pairs of the others are compared, if asked."""
        order = np.argsort(label, kind="stable")
        rows, label = rows[order], label[order]
        sizes = runs(label)[1]
        few = sizes <= small
        if compare:
            several = few & (sizes > 1)
            self.one_by_one(rows[np.repeat(several, sizes)], sizes[several])
        large = np.repeat(~few, sizes)
        rows, label, sizes = rows[large], label[large], sizes[~few]
        if not len(rows):
            return rows, label
        starts = np.cumsum(sizes) - sizes
        leaders = rows[starts + (mix(starts.astype(np.uint64) + np.uint64(seed)) % sizes.astype(np.uint64)).astype(np.int64)]
        alike = np.zeros(len(rows), np.int64)
        alike[self.sets.near(np.repeat(leaders, sizes), rows)] = 1
        alike = np.add.reduceat(alike, starts)
        done = np.zeros(len(sizes), bool)
        for k in np.flatnonzero((sizes - alike <= BESIDE) & (2 * alike > sizes)):
            done[k] = self.through_one(rows[starts[k] : starts[k] + sizes[k]], leaders[k])
        rest = np.repeat(~done, sizes)
        return rows[rest], label[rest]

    def take_apart(self, rows: np.ndarray, label: np.ndarray, small: int) -> None:
        """Finds the pairs of rows of equal labels; runs of up to ``small`` rows are compared pair by pair."""
        every, labels = self.small_parts(rows, label, small, True, 0)
        band, longest = 0, 1
        while len(every) and band < bands(longest):
            rows, label = every, labels
            flat, first = self.sets.words(rows)
            for length in range(1, DEEPEST + 1):
                own = np.uint64((band + 1) * 64 + length)
                order = (mix(self.sets.names ^ mix(own.reshape(1))) >> np.uint64(32)).astype(np.uint32)
                least = np.minimum.reduceat(order.take(flat), first).astype(np.uint64)
                before = len(rows)
                rows, label = self.small_parts(rows, mix(label ^ mix(least + np.uint64(1))), LEAF if length < DEEPEST else before, band < bands(length), int(own))
                longest = max(longest, length)
                if not len(rows):
                    break
                flat, first = self.sets.words(rows)
            band += 1


def near_pairs(group: np.ndarray, sets: Sets, small: int, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets of one group (64-bit numbers) within the similarity; groups of up to ``small`` sets are compared pair by pair.

    Sets of one class ``cid`` are copies, of which a group takes one.
    """
    order = np.lexsort((cid, group))
    once = np.append(True, (group[order[1:]] != group[order[:-1]]) | (cid[order[1:]] != cid[order[:-1]]))
    rows = order[once]
    finder = Finder(sets)
    finder.take_apart(rows, group[rows].view(np.uint64), small)
    return finder.pairs()
