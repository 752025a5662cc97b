"""Suffix arrays by induced sorting, and permuted common prefixes, on arrays.

A suffix is known by its first symbol, by how often that is repeated, and by the rank of the suffix behind the repeats.
For suffixes larger than the next one that rank lies in a lower bucket, for smaller ones in a higher bucket; so ranks are
induced bucket by bucket, upwards and then downwards.  Neighbouring small buckets are taken together, as one array; where
a rank lies among those that are being made, the array is sorted again until it stands.  Leftmost-smaller substrings are
sorted the same way and named, and the shortened text of their names is sorted by recursion, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Arrays that the suffixes of one type are cut into, at buckets.
PORTIONS = 40


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix: whether it is smaller than the next one, and how often its first symbol is repeated."""
    end = np.append(np.flatnonzero(t[:-1] != t[1:]), len(t) - 1)
    size = np.diff(end, prepend=-1)
    small = np.append(t[end[:-1]] < t[end[:-1] + 1], True)
    return np.repeat(small, size), (np.repeat(end + 1, size) - np.arange(len(t))).astype(np.int32)


class Induction:
    def __init__(self, t: np.ndarray, k: int, small: np.ndarray, run: np.ndarray):
        self.t, self.small, self.run = t, small, run
        count = np.bincount(t, minlength=k)
        self.end = np.cumsum(count)
        self.start = self.end - count
        large = np.flatnonzero(~small).astype(np.int32)
        self.large = self.dealt(large, self.start)
        some = np.flatnonzero(small[:-1]).astype(np.int32)
        self.smaller = self.dealt(some, self.end - np.bincount(t[some], minlength=k))

    def dealt(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes by bucket, their buckets, the places in the suffix array that they have together)."""
        c = self.t[at]
        order = np.argsort(c.astype(np.uint16) if len(self.end) <= 1 << 16 else c, kind="stable")
        c = c[order]
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        rank = np.arange(len(c)) - np.repeat(edge, np.diff(np.append(edge, len(c))))
        return at[order], c, (first[c] + rank).astype(np.int32)

    def portions(self, c: np.ndarray) -> Iterator[tuple[int, int]]:
        """(from, to) of neighbouring buckets, about as many suffixes in each."""
        if len(c):
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
            aim = np.arange(0, len(c), max(1, len(c) // PORTIONS))
            cut = np.unique(np.append(edge[np.searchsorted(edge, aim)], len(c))).tolist()
            yield from zip(cut, cut[1:], strict=False)

    def induce(self, at: np.ndarray, c: np.ndarray, place: np.ndarray, upwards: bool) -> None:
        """Ranks of the suffixes of neighbouring buckets."""
        run = self.run[at]
        after = at + run
        low, high = int(c[0]), int(c[-1])
        among = ~self.small[after] & (self.t[after] >= low) if upwards else self.small[after] & (self.t[after] <= high)
        again = low < high and bool(among.any())
        if again:
            self.pos[at], self.sa[place] = place, at
        bits, longest = len(self.t).bit_length(), int(run.max())
        repeats = (run if upwards else longest - run).astype(np.uint64)
        width = longest.bit_length()
        fits = bits + width + (high - low).bit_length() <= 64
        head = (c - low).astype(np.uint64) << np.uint64(width) | repeats if fits else None
        while True:
            if fits:
                key = np.sort(head << np.uint64(bits) | self.pos[after].astype(np.uint64))
                r = (key >> np.uint64(bits) & np.uint64((1 << width) - 1)).astype(np.int32)
                new = self.sa[(key & np.uint64((1 << bits) - 1)).astype(np.int64)] - (r if upwards else longest - r)
            else:
                new = at[np.lexsort((self.pos[after], repeats, c))]
            same = not again or np.array_equal(new, self.sa[place])
            self.pos[new], self.sa[place] = place, new
            if same:
                return

    def array(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, induced from the leftmost-smaller ones in the order given."""
        n, k = len(self.t), len(self.end)
        self.pos, self.sa = np.zeros(n, np.int32), np.full(n, n - 1, np.int32)
        at, _, place = self.dealt(lms.astype(np.int32), self.end - np.bincount(self.t[lms], minlength=k))
        self.pos[at], self.sa[place] = place, at
        at, c, place = self.large
        for a, b in self.portions(c):
            self.induce(at[a:b], c[a:b], place[a:b], True)
        at, c, place = self.smaller
        for a, b in reversed(list(self.portions(c))):
            self.induce(at[a:b], c[a:b], place[a:b], False)
        return self.sa


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """t: symbols below k, the last one 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    small, run = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induction = Induction(t, k, small, run)
    sa = induction.array(lms)
    if len(lms) < 2:
        return sa
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(len(lms))
    which = place[sa]
    which = which[which >= 0]
    order = lms[which]
    length = np.append(np.diff(lms), 0) + 1
    size = length[which]
    # neighbours are compared symbol by symbol, as far as they agree
    a, b, size = order[:-1], order[1:], size[:-1]
    same = size == length[which[1:]]
    live, d = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + d] == t[b[live] + d]
        same[live[~equal]] = False
        live = live[equal]
        d += 1
        live = live[size[live] > d]
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 < len(lms):
        short = np.empty(len(lms), np.int64)
        short[which] = names
        order = lms[suffix_array(short, int(names[-1]) + 1)]
    return induction.array(order)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix by position: how many symbols it shares with the one before it in the suffix array.

    A value whose left neighbours agree is one less than the value to its left; only the others are compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    free = (phi <= 0) | (at == 0)
    free[~free] = t[at[~free] - 1] != t[phi[~free] - 1]
    first = np.flatnonzero(free)
    value = np.zeros(len(first), np.int64)
    live = np.flatnonzero(phi[first] >= 0)
    words = np.ndarray((n,), "<u8", np.concatenate([t.astype(np.uint16), np.zeros(4, np.uint16)]).tobytes(), strides=(2,))
    a, b = first[live], phi[first[live]]
    while len(live):
        equal = words[a] == words[b]
        ended = live[~equal]
        if len(ended):
            x, y = a[~equal], b[~equal]
            more = np.zeros(len(ended), np.int64)
            going = np.ones(len(ended), bool)
            for d in range(4):
                going &= t[np.minimum(x + d, n - 1)] == t[np.minimum(y + d, n - 1)]
                more += going
            value[ended] += more
        live, a, b = live[equal], a[equal] + 4, b[equal] + 4
        value[live] += 4
    whole = np.repeat(value + first, np.diff(np.append(first, n)))
    return whole - at


def repeated(slices: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each slice the runs [first, last] of positions whose next `width` bytes also start anywhere else in the slices."""
    t = np.zeros(sum(map(len, slices)) + len(slices) + 1, np.int64)
    flat = np.frombuffer(b"\0".join(slices) + b"\0", np.uint8).astype(np.int64) + 2
    sizes = np.array([len(s) for s in slices])
    stops = np.cumsum(sizes + 1) - 1
    flat[stops] = 1
    t[:-1] = flat
    sa = suffix_array(t, 258)
    p = permuted_prefixes(t, sa)
    long = p >= width
    again = long.copy()
    again[sa[:-1]] |= long[sa[1:]]
    left = np.repeat(stops, sizes + 1) - np.arange(len(flat))
    hit = np.concatenate([[False], again[:-1] & (left >= width), [False]])
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    begin, end = edge[0::2], edge[1::2]
    which = np.searchsorted(stops, begin)
    starts = stops - sizes
    out: list[list[tuple[int, int]]] = [[] for _ in slices]
    for w, a, b in zip(which.tolist(), (begin - starts[which]).tolist(), (end - 1 - starts[which]).tolist(), strict=True):
        out[w].append((a, b))
    return out
