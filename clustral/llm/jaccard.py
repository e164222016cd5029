"""Signatures of sets of 64-bit hashes for a Jaccard join: sets that are near each other share a signature, always.

Sets are small or large, by what enumeration costs. A small set has a signature for each subset that is left when as many
elements go as a partner may lack. A large set is cut into segments by the elements' hashes; the content of each segment of
two elements or more is a signature, the key of an inverted list. An element in which two sets differ spoils one segment;
so a set with more such segments than it can differ in from any partner shares one with each. A set that has not as many
is cut again by other hashes, and so on. Of two near sets the one that needs fewer rounds decides: the other one took part
in all of them. What ROUNDS rounds don't bring about single elements do. Segments of one element are left out before: a
phrase that many texts share may be all they have.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np

from .text import U, mix

#: Size from which on sets are large whatever the data: its subsets would be too many.
SMALLEST_LARGE = 64
#: Cuts of a large set after which its elements are signatures.
ROUNDS = 32


def missing(n: int, percent: int) -> int:
    """How many elements a set of n may have that are not in a partner: the common part is at least percent of n."""
    return n - -(-n * percent // 100)


def subsets(n: int, percent: int) -> int:
    """How many subsets a small set of n has as signatures."""
    return sum(comb(n, k) for k in range(missing(n, percent) + 1))


def pieces_of(n: int, percent: int) -> int:
    """How many segments a large set of n is cut into at first."""
    return sum(segments(band, percent) for band, _ in bands_of(n, percent))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The size from which on sets are large, where all signatures of sets of these sizes (size: number) are fewest; the
    smaller at ties. Sets under the boundary over percent have subsets, those from the boundary on segments."""
    cost = lambda limit: sum(many * ((subsets(n, percent) if n * percent < limit * 100 else 0) + (pieces_of(n, percent) if n >= limit else 0)) for n, many in sizes.items() if n < 2 * SMALLEST_LARGE)
    return min(range(2, SMALLEST_LARGE + 1), key=lambda limit: (cost(limit), limit))


@lru_cache
def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of bands of sizes; a partner's size is in the same band or the next."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def differ(n: int, largest: int, percent: int) -> int:
    """In how many elements a set of n can differ from a near one of up to `largest` elements, both ways counted."""
    return (n + min(largest, n * 100 // percent)) * (100 - percent) // (100 + percent)


def bands_of(n: int, percent: int) -> list[tuple[int, int]]:
    """The bands that the larger set of a pair with a set of n may be in, and the largest partner there."""
    edge, most = bands(percent), n * 100 // percent
    own = int(np.searchsorted(edge, n, "right")) - 1
    out = [(own, min(most, int(edge[own + 1]) - 1))]
    return [*out, (own + 1, most)] if most >= edge[own + 1] else out


@lru_cache
def segments(band: int, percent: int) -> int:
    """How many segments sets are cut into, for pairs whose larger set is in this band: the fewest with which sets of all
    sizes there have two deviations more than enough segments of two elements, or the safest number."""
    edge = bands(percent)
    high = int(edge[band + 1]) - 1
    sizes = np.unique(np.linspace(max(1, -(-int(edge[band]) * percent // 100)), high, 9).astype(int))
    need = np.array([differ(int(n), high, percent) + 1 for n in sizes])
    best = None
    for m in np.unique(np.geomspace(need.min(), max(need.min(), high), 120).astype(int)).tolist():
        share = 1 - (1 - 1 / m) ** sizes - sizes / m * (1 - 1 / m) ** (sizes - 1) if m > 1 else (sizes > 1).astype(float)
        spare = float(((m * share - need) / np.sqrt(m * share * (1 - share) + 0.25)).min())
        if spare >= 2:
            return m
        if best is None or spare > best[0]:
            best = spare, m
    return best[1]


def signatures(values: np.ndarray, percent: int, limit: int) -> np.ndarray:
    """The signatures (uint64) of one set of distinct hashes; limit: the size from which on sets are large."""
    n = len(values)
    if not n:
        return np.zeros(0, U)
    out = []
    if n * percent < limit * 100:
        whole = np.bitwise_xor.reduce(mix(values ^ U(0x5851F42D4C957F2D)))
        single = mix(values ^ U(0x5851F42D4C957F2D))
        kept = {(n - k, int(whole ^ np.bitwise_xor.reduce(single[list(c)]))) if k else (n, int(whole)) for k in range(missing(n, percent) + 1) for c in combinations(range(n), k)}
        out.append(mix(np.array([x for _, x in kept], U) + np.array([s for s, _ in kept], U)))
    if n >= limit:
        body = mix(values ^ U(0x14057B7EF767814F))
        for band, largest in bands_of(n, percent):
            m, need = segments(band, percent), differ(n, largest, percent) + 1
            for k in range(ROUNDS):
                at = (mix(values + U(band + (k << 16))) % U(m)).astype(np.int64)
                sizes, order = np.bincount(at, minlength=m), np.argsort(at)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(body[order])])
                ends = np.cumsum(sizes)
                keys = mix(mix(sums[ends] - sums[ends - sizes] + sizes.astype(U)) + U((band << 40) + (k << 32)) + np.arange(m).astype(U))
                out.append(keys[sizes > 1])
                if len(out[-1]) >= need:
                    break
            else:
                out.append(mix(values + U((band << 40) + (1 << 39))))
    return np.concatenate(out)


def overlaps(values: np.ndarray, at: np.ndarray, percent: int, rows: range, others: np.ndarray):
    """For each of rows, those of `others` (a mask) near it, by scanning the inverted lists of the row's elements."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    _, element, lists = np.unique(values, return_inverse=True, return_counts=True)
    shared = lists[element] > 1
    order = np.argsort(element, kind="stable")
    start = np.cumsum(lists) - lists
    for x in rows:
        own = element[at[x] : at[x + 1]][shared[at[x] : at[x + 1]]]
        each = lists[own]
        ends = np.cumsum(each)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[own] - (ends - each), each)
        common = np.bincount(owner[order[places]], minlength=len(size))
        near = others & (common * (100 + percent) >= percent * (size + size[x])) & (common > 0)
        near[x] = False
        yield x, np.flatnonzero(near)


class Forest:
    """Union-find over 0..n-1; the smaller index is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
