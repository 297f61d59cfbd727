"""Suffix arrays of byte segments by induced sorting, and permuted common prefixes, vectorised.

Suffixes are classified as smaller (S) or larger (L) than the next one. The leftmost-S substrings are sorted
by one round of induction and named; where names repeat, the string of names is sorted by recursion; a second
round of induction then orders all suffixes. An induction goes through the buckets of first symbols once in
each direction; inside a bucket it goes in waves, each a vector operation, so a shard costs linear work. The
reduced string of names goes through the same steps, level by level; see ``sorted_names``.

Each segment ends with a separator. Separators are smaller than all bytes and ordered by place, later ones first, so that no
common prefix and no comparison goes over a segment's end.
"""

from __future__ import annotations

import numpy as np

SEPARATOR, SYMBOLS = 1, 258  # 0: the end of the text; bytes are 2 to 257


class Shard:
    """Segments joined in the given order; ``data`` holds symbols, ``begin`` where each segment starts."""

    def __init__(self, segments: list[bytes]):
        sizes = np.array([len(s) for s in segments], np.int64)
        raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.begin + sizes  # the separators
        self.data = raw.astype(np.uint16) + np.uint16(2)
        self.data[self.end] = SEPARATOR
        self.data = np.append(self.data, np.uint16(0))
        self.n = len(self.data)
        self.left = np.zeros(self.n, np.int32)  # bytes up to the segment's end
        self.left[:-1] = np.repeat(self.end, sizes + 1) - np.arange(self.n - 1)
        padded = np.append(self.data, np.zeros(4, np.uint16)).astype(np.uint64)
        n = self.n
        self.four = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Common prefix lengths of pairs of suffixes, up to ``limit``; four symbols at a time."""
        out = np.zeros(len(a), np.int32)
        live = np.flatnonzero(limit > 0)
        at = 0
        while len(live):
            x = self.four[np.minimum(a[live] + at, self.n - 1)] ^ self.four[np.minimum(b[live] + at, self.n - 1)]
            same = (x & np.uint64(0xFFFF)) == 0
            step = same.astype(np.int32)
            for mask in (0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
                same = (x & np.uint64(mask)) == 0
                step += same
            out[live] += step
            at += 4
            live = live[(x == 0) & (limit[live] > at)]
        return np.minimum(out, limit)


def classify(data: np.ndarray) -> np.ndarray:
    """True for S suffixes; equal neighbours take the type of what follows them. The end is S."""
    n = len(data)
    rise = np.zeros(n, bool)
    rise[:-1] = data[:-1] < data[1:]
    rise[-1] = True
    firm = np.ones(n, bool)
    firm[:-1] = data[:-1] != data[1:]
    at = np.where(firm, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]]


class Induction:
    """Orders all suffixes from the order of the leftmost S ones."""

    def __init__(self, shard: Shard, small: np.ndarray):
        self.data, self.small = shard.data, small
        self.size = np.bincount(self.data, minlength=SYMBOLS)
        self.start = np.cumsum(self.size) - self.size
        self.used = np.flatnonzero(self.size)

    def order(self, leftmost: np.ndarray) -> np.ndarray:
        sa = np.zeros(len(self.data), np.int32)
        firsts = self.data[leftmost]
        cuts = np.searchsorted(firsts, np.arange(SYMBOLS + 1))  # leftmost comes by first symbol
        head, tail = self.start.copy(), self.start + self.size
        for c in self.used:
            done = self.start[c]
            while head[c] > done:
                wave, done = sa[done : head[c]], head[c]
                self._push(sa, wave, False, head, 1)
            if cuts[c + 1] > cuts[c]:
                self._push(sa, leftmost[cuts[c] : cuts[c + 1]], False, head, 1)
        top = head  # the L suffixes of a bucket end here
        sa[0] = len(self.data) - 1
        for c in self.used[::-1]:
            if c == SEPARATOR:  # ordered by place, the last one first, as the end follows it
                sa[self.start[c] : self.start[c] + self.size[c]] = np.flatnonzero(self.data == SEPARATOR)[::-1]
                continue
            done = self.start[c] + self.size[c]
            while tail[c] < done:
                wave, done = sa[tail[c] : done][::-1], tail[c]
                self._push(sa, wave, True, tail, -1)
            if top[c] > self.start[c]:
                self._push(sa, sa[self.start[c] : top[c]][::-1], True, tail, -1)
        return sa

    def _push(self, sa: np.ndarray, scanned: np.ndarray, small: bool, edge: np.ndarray, way: int) -> None:
        """Puts the suffixes one to the left of ``scanned`` at the edges of their buckets, in scan order."""
        j = scanned[scanned > 0] - 1
        j = j[self.small[j] == small]
        if not len(j):
            return
        c = self.data[j]
        by = np.argsort(c, kind="stable")  # radix sort of 16-bit symbols
        c, j = c[by], j[by]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        n = np.diff(np.r_[new, len(c)])
        kinds = c[new]
        nth = np.arange(len(c)) - np.repeat(new, n)
        if way > 0:
            sa[np.repeat(edge[kinds], n) + nth] = j
        else:
            sa[np.repeat(edge[kinds], n) - 1 - nth] = j
        edge[kinds] += way * n


def _refined(at: np.ndarray, key: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Ranks of the strings of keys from places ``at`` on, each up to its first ``final`` place; equal ones share a rank.

    A string is extended only while others share its rank. Strings that share one end together.
    """
    rank = np.zeros(len(at), np.int64)
    live, step = np.arange(len(at)), 0
    while len(live):
        place = at[live] + step
        own = key[place]
        by = np.argsort(own, kind="stable") if not step else np.lexsort((own, rank[live]))
        held, own = rank[live[by]], own[by]
        fresh = np.r_[True, (held[1:] != held[:-1]) | (own[1:] != own[:-1])]
        start = np.flatnonzero(fresh)
        size = np.diff(np.r_[start, len(by)])
        # a group keeps the ranks from its first one on: a part of it starts behind the parts before
        outer = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        base = np.repeat(outer, np.diff(np.r_[outer, len(by)]))
        rank[live[by]] = held + np.repeat(start, size) - base
        live = live[by[np.repeat(size > 1, size) & ~final[place[by]]]]
        step += 1
    return rank


def sorted_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, whose last one is the least and occurs once.

    The same steps as over bytes: leftmost S substrings are sorted and named, names that repeat are sorted by
    recursion on a string of at most half the length, and the other suffixes follow. With this many symbols
    they are not pushed bucket by bucket: an L suffix is its run of L names and then a leftmost S suffix,
    whose rank is known, and an S suffix is its run of S names and then an L suffix.
    """
    n = len(names)
    small = classify(names)
    is_left = small.copy()
    is_left[0] = False
    is_left[1:] &= ~small[:-1]
    leftmost = np.flatnonzero(is_left)
    kind = names * 2 + small
    final = is_left.copy()
    final[-1] = True
    # a substring goes on to the leftmost S place after it: its own place is no end
    own, rest = kind[leftmost], _refined(leftmost[:-1] + 1, kind, final)
    by = np.lexsort((np.r_[rest, 0], own))
    pair = np.stack([own, np.r_[rest, 0]])[:, by]
    rank = np.zeros(len(leftmost), np.int64)
    rank[by] = np.cumsum(np.r_[False, (pair[:, 1:] != pair[:, :-1]).any(axis=0)])
    if len(leftmost) and rank.max() + 1 < len(leftmost):
        rank[sorted_names(rank)] = np.arange(len(leftmost))
    wide = n + 2
    key = names * wide
    key[leftmost] += 1 + rank
    large = np.flatnonzero(~small)
    large_rank = _refined(large, key, small)
    key = names * wide + n + 1
    key[large] = names[large] * wide + large_rank
    ended = ~small
    ended[-1] = True
    smaller = np.flatnonzero(small)
    small_rank = _refined(smaller, key, ended)
    both = np.r_[large[np.argsort(large_rank)], smaller[np.argsort(small_rank)]]
    return both[np.argsort(names[both], kind="stable")]


def suffix_array(shard: Shard) -> np.ndarray:
    small = classify(shard.data)
    is_left = small.copy()
    is_left[0] = False
    is_left[1:] &= ~small[:-1]
    leftmost = np.flatnonzero(is_left)
    induction = Induction(shard, small)
    rough = induction.order(leftmost[np.argsort(shard.data[leftmost], kind="stable")])
    found = rough[is_left[rough]].astype(np.int64)
    # names: equal substrings up to the next leftmost S; separators and the end are names of their own
    after = np.zeros(shard.n, np.int64)
    after[leftmost] = np.append(leftmost[1:], shard.n - 1)
    length = after[found] - found + 1
    same = np.zeros(len(found), bool)
    a, b = found[1:], found[:-1]
    could = (length[1:] == length[:-1]) & (shard.data[a] > SEPARATOR)
    same[1:][could] = shard.common(a[could], b[could], length[1:][could]) == length[1:][could]
    name = np.cumsum(~same) - 1
    if name[-1] + 1 < len(found):
        by_place = np.zeros(shard.n, np.int64)
        by_place[found] = name
        found = leftmost[sorted_names(by_place[leftmost])]
    return induction.order(found)


def common_prefixes(shard: Shard, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in the suffix array.

    A value follows from its left neighbour's, one less, unless the symbols before the two suffixes differ;
    only those irreducible values are compared, and their sum is small.
    """
    before = np.zeros(shard.n, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(shard.n)
    own = shard.data[np.maximum(i - 1, 0)]
    start = np.zeros(shard.n, bool)
    start[shard.begin] = True
    start[0] = True
    firm = start | start[before] | (own != shard.data[np.maximum(before - 1, 0)]) | (shard.left == 0)
    at = np.flatnonzero(firm)
    value = np.zeros(shard.n, np.int64)
    value[at] = shard.common(at, before[at], np.minimum(shard.left[at], shard.left[before[at]]))
    last = np.maximum.accumulate(np.where(firm, i, 0))
    out = value[last] - (i - last)
    out[sa[0]] = 0
    return np.maximum(out, 0)


def repeated_windows(shard: Shard, width: int) -> np.ndarray:
    """True for each place whose ``width`` bytes also start at an earlier place; windows stay in a segment."""
    sa = suffix_array(shard)
    plcp = common_prefixes(shard, sa)
    group = np.cumsum(plcp[sa] < width)
    whole = shard.left[sa] >= width
    at, group = sa[whole], group[whole]
    out = np.zeros(shard.n, bool)
    if len(at):
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.minimum.reduceat(at, new)
        out[at] = at != np.repeat(least, np.diff(np.r_[new, len(at)]))
    return out
