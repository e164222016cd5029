"""The genetic algorithm: solutions that are crossed, tuned and selected."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..plans.engine import Points, distances, nearest
from .kmeans import Annealing, Solution, drawn, filled, lloyd, of_codebook, random_init, weighted_init
from .merging import pnn, shrink

#: First generations: random points, centroids of random parts, these with noise, random points tuned, these with noise, and
#: twice as many random points, merged and tuned.
FIRST = ("codebook", "partition", "partition-noise", "tuned", "tuned-noise", "merged")
#: elitist: all pairs of the few best, of which one survives; elitist2: with themselves too, and all the few survive; roulette:
#: by 1 / (1 + error); zigzag: neighbours in rank.
SELECTIONS = ("elitist", "elitist2", "roulette", "zigzag")
CROSSINGS = ("copy", "random", "distance", "adoption", "pairwise", "pnn-old", "pnn", "shrink", "shrink-adaptive")


def population(points: Points, k: int, size: int, how: str = "codebook", tune: int = 2, seed: str = "0", weighted: bool = False, noise: float = 0.0) -> list[Solution]:
    """The first generation, see FIRST; weighted: points are drawn by weight. noise: the amplitude where noise is added."""
    if how not in FIRST:
        raise ValueError(f"no first generation {how!r}")
    draw = weighted_init if weighted else random_init
    out = []
    for i in range(size):
        own = f"{seed}/{i}"
        if how.startswith("partition"):
            c = points.labelled(own, k).centroids(random_init(points, k, own, False))
        elif how == "merged":
            many = draw(points, min(points.size, 2 * k), own)
            s = points.statistics(many)
            c = pnn(s.centroids(many), s.n, k)[0]
        else:
            c = draw(points, k, own)
        if how in ("tuned", "tuned-noise", "merged"):
            c = lloyd(points, c, max(1, tune)).codebook
        if how.endswith("noise"):
            c = Annealing(noise, 0).noisy(c, points.top(), own)
        out.append(of_codebook(points, c))
    return out


def survivors(size: int, method: str) -> int:
    """How many of the best are crossed: the least number s whose pairs are as many as the population."""
    s = 1
    while (s * (s - 1) if method == "elitist" else s * (s + 1)) // 2 < size:
        s += 1
    return s


def select(errors: list[int], size: int, method: str = "elitist", seed: str = "0") -> list[tuple[int, int]]:
    """Pairs of parents (numbers in order of error), as many as `size`."""
    if method not in SELECTIONS:
        raise ValueError(f"no selection {method!r}")
    n = len(errors)
    if method == "roulette":
        p = np.array([1 / (1 + float(e)) for e in errors])
        ends = np.cumsum(p / p.sum())
        spin = lambda x: min(n - 1, int(np.searchsorted(ends, drawn(x, 1 << 52) / (1 << 52), "right")))
        out = []
        for i in range(size):
            a, t = spin(f"{seed}/{i}/0"), 1
            b = spin(f"{seed}/{i}/1")
            while b == a and n > 1:
                t += 1
                b = spin(f"{seed}/{i}/{t}") if t < 100 else (a + 1) % n
            out.append((a, b))
        return out
    if method == "zigzag":
        pairs = [(i, i + d) for d in (1, 2) for i in range(n - d)]
    else:
        s = min(n, survivors(size, method))
        pairs = [(i, j) for j in range(s) for i in range(j + (method == "elitist2"))]
    return [pairs[i % len(pairs)] for i in range(size)] if pairs else [(0, 0)] * size


def by_centroid(c: np.ndarray, n: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """A codebook in order of the distance to a vector, by default its weighted mean; ties stay in order."""
    w = n if n.sum() else np.ones(len(c), np.int64)
    mean = np.array([(2 * int(s) + int(w.sum())) // (2 * int(w.sum())) for s in (c.astype(object) * w[:, None].astype(object)).sum(0)], np.int64) if of is None else of
    return c[np.argsort(distances(c, mean[None])[:, 0], kind="stable")]


def without_twins(c: np.ndarray, reserve: np.ndarray, seed: str = "0") -> np.ndarray:
    """A vector that has a later twin is replaced by one of the reserve that is not there yet, as long as there is one."""
    c = c.copy()
    for i in range(len(c)):
        if (c[i + 1 :] == c[i]).all(1).any():
            there = set(map(tuple, c.tolist()))
            free = [v for v in reserve.tolist() if tuple(v) not in there]
            if free:
                c[i] = free[drawn(f"{seed}/{i}", len(free))]
    return c


def cross(points: Points, a: Solution, b: Solution, method: str = "pnn", seed: str = "0") -> np.ndarray:
    """A codebook of two, see CROSSINGS."""
    if method not in CROSSINGS:
        raise ValueError(f"no crossing {method!r}")
    k, coin = len(a.codebook), lambda what: drawn(f"{seed}/{what}", 2)
    if method == "copy":
        return a.codebook.copy()
    both = np.concatenate([a.codebook, b.codebook])
    if method == "random":  # from either parent in turn, in a random order, no vector twice while there are others
        order = [sorted(range(k), key=lambda j, p=p: drawn(f"{seed}/{p}/{j}", 1 << 52)) for p in (0, 1)]
        out: list[list[int]] = []
        for i in range(2 * k):
            v = (a, b)[i % 2].codebook[order[i % 2][i // 2]].tolist()
            if v not in out and len(out) < k:
                out.append(v)
        return np.array([*out, *both.tolist()][:k], np.int64)
    if method == "distance":
        one, two = (a, b) if coin("first") == 0 else (b, a)
        s = points.statistics(np.zeros((1, points.dim), np.int64))
        mean = s.centroids(np.zeros((1, points.dim), np.int64))[0]
        halves = np.concatenate([by_centroid(one.codebook, one.n, mean)[: k // 2], by_centroid(two.codebook, two.n, mean)[k // 2 :]])
        return without_twins(halves, one.codebook, seed)
    if method == "adoption":  # each centroid of the second takes the place of the nearest, and all are centred again
        c = a.codebook.copy()
        for v in b.codebook:
            c[int(distances(c, v[None])[:, 0].argmin())] = v
            c = points.statistics(c).centroids(c)
        return c
    if method == "pairwise":
        mate = b.codebook[nearest(a.codebook, b.codebook)[0]]
        c = np.array([mate[i] if coin(i) == 0 else a.codebook[i] for i in range(k)], np.int64)
        return filled(points, c, points.statistics(c).n)
    if method == "pnn-old":  # all vectors, with the weights they had
        return pnn(both, np.concatenate([a.n, b.n]), k)[0]
    s = points.statistics(both)
    used = np.flatnonzero(s.n > 0) if (s.n > 0).sum() >= k else np.argsort(-s.n, kind="stable")[:k]
    if method.startswith("shrink"):
        return shrink(points, s.centroids(both)[used], k).codebook
    return pnn(s.centroids(both)[used], s.n[used], k)[0]


def to_bits(c: np.ndarray, width: int) -> str:
    """A codebook as a string of bits, `width` an element, the first vector first."""
    if c.size and (c.min() < 0 or int(c.max()).bit_length() > width):
        raise ValueError(f"an element has no {width} bits")
    return "".join(format(int(x), f"0{width}b") for x in c.ravel())


def from_bits(bits: str, width: int, dim: int) -> np.ndarray:
    """What to_bits has made a string of."""
    if len(bits) % (width * dim):
        raise ValueError("the string is not of whole vectors")
    return np.array([int(bits[i : i + width], 2) for i in range(0, len(bits), width)], np.int64).reshape(-1, dim)


def with_vector(points: Points, s: Solution, j: int, v: np.ndarray) -> Solution:
    """A solution with one vector changed, its points assigned anew."""
    c = s.codebook.copy()
    c[j] = v
    return of_codebook(points, c)


def optimal(points: Points, s: Solution) -> Solution:
    """A solution whose codebook is that of its own partition."""
    return of_codebook(points, points.statistics(s.codebook).centroids(s.codebook))


def genetic(points: Points, k: int, generations: int = 10, size: int = 8, method: str = "pnn", selection: str = "elitist", mutations: int = 0, tune: int = 2, seed: str = "0", first: str = "codebook", tuned: str = "all", weighted: bool = False, noise: float = 0.0, watch: Callable[[int, Solution], None] | None = None) -> Solution:
    """Crosses the best solutions, tunes the offspring and keeps the best. generations 0: until a generation brings nothing.

    tuned: all offspring, or the best few of them (as many as survive). shrink-adaptive: as shrink, and the population
    doubles, up to 100, when a generation brings nothing. watch(generation, best) is told of each generation.
    """
    tuned_at_first = first not in ("tuned", "tuned-noise", "merged")
    now = population(points, k, size, first, tune, seed, weighted, noise)
    now = sorted((lloyd(points, s.codebook, tune) for s in now) if tuned_at_first else now, key=lambda s: s.sse)
    history, g = [now[0].sse], 0
    while True:
        stays = survivors(size, selection) if selection == "elitist2" else 1
        made = now[: min(stays, size - 1)]
        pairs = select([s.sse for s in now], size - len(made), selection, f"{seed}/{g}")
        fresh = []
        for i, (a, b) in enumerate(pairs):
            c = cross(points, now[a], now[b], method, f"{seed}/{g}/{i}")
            for m in range(mutations):
                c[drawn(f"{seed}/{g}/{i}/{m}", len(c))] = points.sample(1, f"{seed}/{g}/{i}/{m}")[0]
            fresh.append(c)
        if tuned == "all":
            fresh_s = [lloyd(points, c, tune) for c in fresh]
        else:
            rough = sorted((of_codebook(points, c) for c in fresh), key=lambda s: s.sse)
            best = max(1, survivors(size, selection))
            fresh_s = [lloyd(points, s.codebook, tune) for s in rough[:best]] + rough[best:]
        now = sorted([*made, *fresh_s], key=lambda s: s.sse)
        g += 1
        history.append(now[0].sse)
        if watch:
            watch(g, now[0])
        nothing = history[-1] >= history[-2]
        if method == "shrink-adaptive" and nothing:
            size = min(100, 2 * size)
        if g >= generations > 0 or not generations and nothing and g > 2:
            return Solution(now[0].codebook, now[0].n, now[0].sse, history)
