"""Pairwise nearest neighbour merging and iterative shrinking: codebooks that get smaller.

A codebook is small and is merged on the driver; costs that depend on the points come from passes over them.
"""

from __future__ import annotations

import heapq

import numpy as np

from ..plans.engine import Local, Points, distances, exactly, nearest
from .kmeans import Solution, lloyd

#: Merge costs: growth of the error by weights and distance (equitz), the error of the merged cluster (amount), the growth
#: of the error over the points (increase).
COSTS = ("equitz", "amount", "increase")
#: How the cheapest pair is found. All but fast give the same merges.
PAIRS = ("kissing", "trivial", "kurita", "lazy", "fast")


def merge_costs(c: np.ndarray, n: np.ndarray, error: np.ndarray | None = None, cost: str = "equitz") -> np.ndarray:
    """The cost of merging each pair; infinite on the diagonal. For amount and increase the clusters' own errors around
    their means are needed: merged, a cluster has both and the growth."""
    if cost not in COSTS:
        raise ValueError(f"no cost {cost!r}")
    w = n.astype(float)
    both = w[:, None] + w[None, :]
    out = np.floor(np.where(both > 0, w[:, None] * w[None, :] / np.maximum(both, 1) * distances(c, c), 0.0) + 0.5)
    if cost == "amount":
        e = (np.zeros(len(c)) if error is None else error).astype(float)
        out = out + e[:, None] + e[None, :]
    np.fill_diagonal(out, np.inf)
    return out


def merged(c: np.ndarray, n: np.ndarray, a: int, b: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The centroid of two clusters, halves up: of their vectors by weight, or of the points' sums."""
    w = int(n[a] + n[b])
    if not w:
        return c[a]
    total = [int(x) + int(y) for x, y in zip(sums[a], sums[b], strict=True)] if sums is not None else [int(n[a]) * int(x) + int(n[b]) * int(y) for x, y in zip(c[a], c[b], strict=True)]
    return np.array([(2 * t + w) // (2 * w) for t in total], np.int64)


def pnn(c: np.ndarray, n: np.ndarray, k: int, cost: str = "equitz", search: str = "kissing", error: np.ndarray | None = None, sums: np.ndarray | None = None, tune: tuple[Points, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merges the cheapest pair (the lowest numbers at ties) until k clusters are left; the last takes the gap's place.

    sums: centroids come from the points' sums instead of the rounded vectors. tune: (points, iterations) of K-means after
    each merge. search: see PAIRS; fast merges half of the buckets of a k-d tree at once and is another result.
    """
    if search not in PAIRS:
        raise ValueError(f"no search {search!r}")
    c, n = c.astype(np.int64).copy(), n.astype(np.int64).copy()
    error = np.zeros(len(c)) if error is None else error.astype(float).copy()
    sums = None if sums is None else np.array(sums, object).copy()
    if search == "fast":
        return fast_pnn(c, n, k)
    if search == "lazy" and cost == "equitz" and sums is None and tune is None:
        return _lazy(c, n, k)
    costs = merge_costs(c, n, error, cost)
    while len(c) > k:
        a, b = sorted(divmod(int(costs.argmin()), len(c)))
        growth = merge_costs(c[[a, b]], n[[a, b]])[0, 1]
        c[a] = merged(c, n, a, b, sums)
        n[a] += n[b]
        error[a] += error[b] + growth
        c[b], n[b], error[b] = c[-1], n[-1], error[-1]
        if sums is not None:
            sums[a] = sums[a] + sums[b]
            sums[b] = sums[-1]
            sums = sums[:-1]
        c, n, error = c[:-1], n[:-1], error[:-1]
        if tune:
            s = lloyd(tune[0], c, tune[1])
            c, n = s.codebook, s.n
            got = tune[0].statistics(c)
            error, sums = got.error.astype(float), None if sums is None else got.sums
            costs = merge_costs(c, n, error, cost)
            continue
        costs[b], costs[:, b] = costs[-1], costs[:, -1]
        costs[b, b] = np.inf
        costs = costs[:-1, :-1].copy()
        if a < len(c):
            both = np.maximum(n + n[a], 1)
            row = np.floor(n * float(n[a]) / both * distances(c, c[a : a + 1])[:, 0] + 0.5)
            costs[a] = costs[:, a] = row + (error + error[a] if cost == "amount" else 0)
            costs[a, a] = np.inf
    return c, n


def _lazy(c: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """pnn by a heap of pairs whose costs are looked at anew only when they come up: costs only rise as clusters grow.
    Where rounding has let a cost fall, the pair was pushed with it."""
    names, age = list(range(len(c))), [0] * len(c)  # place in the codebook to cluster
    place = {m: m for m in names}
    vectors, weights = {m: c[m] for m in names}, {m: int(n[m]) for m in names}
    costs = merge_costs(c, n)
    heap = [(costs[i, j], i, j, i, 0, j, 0) for i in names for j in names if i < j]
    heapq.heapify(heap)
    while len(place) > k:
        cost, i, j, x, ax, y, ay = heapq.heappop(heap)
        if x not in place or y not in place or age[x] != ax or age[y] != ay or (place[x], place[y]) != (i, j):
            continue
        both = merged(np.stack([vectors[x], vectors[y]]), np.array([weights[x], weights[y]]), 0, 1)
        vectors[x], weights[x] = both, weights[x] + weights[y]
        age[x] += 1
        last = max(place, key=lambda m: place[m])
        del place[y]
        moved = [x]
        if last != y:
            place[last] = j
            moved.append(last)
        rest = sorted(place, key=lambda m: place[m])
        book, weight = np.stack([vectors[m] for m in rest]), np.array([weights[m] for m in rest])
        for m in moved:
            if m in place:
                at = place[m]
                w = weight.astype(float)
                row = np.floor(w * w[at] / np.maximum(w + w[at], 1) * distances(book, book[at : at + 1])[:, 0] + 0.5)
                for q, other in enumerate(rest):
                    if other != m:
                        low, high = sorted([(at, m), (q, other)])
                        heapq.heappush(heap, (row[q], low[0], high[0], low[1], age[low[1]], high[1], age[high[1]]))
    rest = sorted(place, key=lambda m: place[m])
    return np.stack([vectors[m] for m in rest]), np.array([weights[m] for m in rest], np.int64)


def buckets(c: np.ndarray, most: int = 8) -> list[np.ndarray]:
    """The codebook's numbers in buckets of a k-d tree: cut at the lower median of the dimension of the largest variance."""
    out, open_ = [], [np.arange(len(c))]
    while open_:
        own = open_.pop()
        if len(own) <= most or not c[own].var(0).any():
            out.append(own)
            continue
        d = int(c[own].var(0).argmax())
        order = own[np.argsort(c[own, d], kind="stable")]
        open_ += [order[: (len(own) + 1) // 2], order[(len(own) + 1) // 2 :]]
    return sorted(out, key=lambda b: b.min())


def fast_pnn(c: np.ndarray, n: np.ndarray, k: int, most: int = 8, least: int = 4, percent: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Merges within k-d buckets: in each the cheapest pair, and in a pass those of the cheapest `percent` of the buckets.
    The tree is built anew when a bucket has fallen under `least`."""
    parts = buckets(c, most)
    while len(c) > k:
        found = []
        for own in parts:
            if len(own) > 1:
                costs = merge_costs(c[own], n[own])
                a, b = sorted(divmod(int(costs.argmin()), len(own)))
                found.append((float(costs[a, b]), int(own[a]), int(own[b])))
        if not found:
            parts = [np.arange(len(c))]
            continue
        gone = []
        for _, a, b in sorted(found)[: min(len(c) - k, max(1, len(found) * percent // 100))]:
            c[a] = merged(c, n, a, b)
            n[a] += n[b]
            gone.append(b)
        stays = np.setdiff1d(np.arange(len(c)), gone)
        renamed = np.full(len(c), -1)
        renamed[stays] = np.arange(len(stays))
        parts = [renamed[own][renamed[own] >= 0] for own in parts]
        c, n = c[stays], n[stays]
        if any(len(own) < min(least, len(c)) for own in parts):
            parts = buckets(c, most)
    return c, n


def pnn_of_points(points: Points, k: int, start: int = 4096, cost: str = "equitz", search: str = "kissing", seed: str = "0", tune: int = 0, counters: bool = False) -> Solution:
    """Pairwise nearest neighbour of a set of points: each point is a cluster if there are at most `start`, else `start`
    clusters are, by a random codebook and a pass. tune: K-means iterations after each merge. counters: centroids come from
    the points' sums."""
    from .kmeans import random_init

    c = random_init(points, min(points.size, start), seed, unique=False)
    s = points.statistics(c)
    c, used = s.centroids(c), np.flatnonzero(s.n > 0)
    used = used if len(used) >= k else np.argsort(-s.n, kind="stable")[:k]
    found = pnn(c[used], s.n[used], k, cost, search, points.statistics(c).error[used], s.sums[used] if counters else None, (points, tune) if tune else None)[0]
    t = points.statistics(found)
    return Solution(found, t.n, t.sse)


# iterative shrinking

#: When a point's second cluster is looked for again: never, when it is gone, when it or the point's own has changed, always.
POLICIES = ("none", "minimum", "standard", "extensive")


def removal_costs(points: Points, c: np.ndarray, n: np.ndarray, how: str = "simple") -> np.ndarray:
    """What removing each cluster costs: its points go to the other cluster that takes each in most cheaply, by the merge
    cost of a point and a cluster, less what they cost now. simple: each point alone. exact: the points that go to one
    cluster go together, as a cluster of their own; they cost what they cost there and what that cluster's merge costs."""
    k, dim = len(c), points.dim

    def second(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of, d2, _ = nearest(x, c)
        cost = merge_each(x, w, c, n)
        cost[np.arange(len(x)), of] = np.inf
        to = cost.argmin(1)
        return of, exactly(d2, w), to, cost[np.arange(len(x)), to]

    if how == "simple":

        def flat(_: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
            of, now, _, cost = second(x, w)
            out = np.zeros(k, object)
            np.add.at(out, of, np.array([int(a) for a in cost], object) - now.astype(object))
            return out

        return points.fold(flat, k)

    def groups(_: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        of, now, to, _ = second(x, w)
        out = np.zeros((k, k, 3 + dim), object)
        for a, b, d, v, weight, e in zip(of.tolist(), to.tolist(), (x * x).sum(1).tolist(), x.tolist(), w.tolist(), now.tolist(), strict=True):
            out[a, b] += np.array([weight, d * weight, e, *(u * weight for u in v)], object)
        return out.ravel()

    cells, out = points.fold(groups, k * k * (3 + dim)).reshape(k, k, -1), np.zeros(k, object)
    for a in range(k):
        for b in range(k):
            weight = int(cells[a, b, 0])
            if weight:
                s = [int(v) for v in cells[a, b, 3:]]
                centre = [(2 * v + weight) // (2 * weight) for v in s]
                inside = int(cells[a, b, 1]) - 2 * sum(u * v for u, v in zip(s, centre, strict=True)) + weight * sum(v * v for v in centre)
                d2 = sum((u - int(v)) ** 2 for u, v in zip(centre, c[b], strict=True))
                both = weight + int(n[b])
                out[a] += inside - int(cells[a, b, 2]) + (2 * weight * int(n[b]) * d2 + both) // (2 * both)
    return out


def merge_each(x: np.ndarray, w: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The merge cost of each point with each cluster, halves up."""
    both = (w[:, None] + n[None, :]).astype(float)
    return np.floor(np.where(both > 0, w[:, None].astype(float) * n[None, :] / np.maximum(both, 1), 0.0) * distances(x, c) + 0.5)


def shrink(points: Points, codebook: np.ndarray, k: int, removal: str = "second", policy: str = "extensive") -> Solution:
    """Removes the cluster that costs least to remove, re-centres, until k are left.

    removal: second (what the points lose at their second centroids), simple or exact (see removal_costs). policy: when
    second clusters are looked for again; a pass looks at all, so they differ only for points in memory, see shrink_held.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")
    if policy != "extensive" and isinstance(points, Local):
        return shrink_held(points, codebook, k, policy)
    c = np.asarray(codebook, np.int64)
    while True:
        s = points.statistics(c)
        if len(c) <= k:
            return Solution(c, s.n, s.sse)
        loss = s.loss if removal == "second" else removal_costs(points, c, s.n, removal)
        cost = [float(x) if n > 0 else -1.0 for x, n in zip(loss, s.n.tolist(), strict=True)]
        c = np.delete(s.centroids(c), int(np.argmin(cost)), 0)


def shrink_held(points: Local, codebook: np.ndarray, k: int, policy: str) -> Solution:
    """shrink that keeps each point's cluster and second cluster from step to step; simple costs. The second is looked for
    again when it is gone (minimum, and none, since a point needs one), when it or its own has changed (standard)."""
    c, x, w = np.asarray(codebook, np.int64).copy(), points.x, points.w
    alive = np.ones(len(c), bool)
    of = nearest(x, c)[0]
    n = np.bincount(of, w, len(c)).astype(np.int64)

    def look(rows: np.ndarray) -> np.ndarray:
        cost = merge_each(x[rows], w[rows], c, n)
        cost[:, ~alive] = np.inf
        cost[np.arange(len(rows)), of[rows]] = np.inf
        return cost.argmin(1)

    second = look(np.arange(len(x)))
    while alive.sum() > k:
        rows = np.arange(len(x))
        d = ((x - c[second]) ** 2).sum(1)
        take = np.floor(w * n[second] / np.maximum(w + n[second], 1) * d + 0.5) - ((x - c[of]) ** 2).sum(1) * w
        cost = np.where(alive, np.bincount(of, take, len(c)), np.inf)
        cost[alive & (n == 0)] = -1
        gone = int(cost.argmin())
        moving = of == gone
        touched = np.zeros(len(c), bool)
        touched[second[moving]] = True
        of[moving] = second[moving]
        alive[gone] = False
        n = np.bincount(of, w, len(c)).astype(np.int64)
        for j in np.flatnonzero(touched):
            own = of == j
            total, weight = exactly(x[own], w[own]).sum(0), int(w[own].sum())
            c[j] = [(2 * int(t) + weight) // (2 * weight) for t in total]
        stale = moving | (second == gone)
        if policy == "standard":
            stale |= touched[second] | touched[of]
        if alive.sum() > 1 and stale.any():
            second[rows[stale]] = look(rows[stale])
    c = c[alive]
    s = points.statistics(c)
    return Solution(c, s.n, s.sse)
