"""Splitting: codebooks that grow, and split-and-merge."""

from __future__ import annotations

import numpy as np

from ..plans.engine import Points
from .kmeans import Solution, drawn, filled, lloyd, random_init
from .merging import pnn

#: Which cluster: of the largest error, size, third moment or spread, a random one, each in turn, or the one whose cut lowers
#: the error most.
CHOICES = ("error", "size", "third", "furthest", "random", "all", "optimal")
#: The two new vectors: the current one and one a deviation away, one a deviation away on either side, the current one and the
#: member furthest from it, the current and a random member, the two furthest members, two random members, the means of the
#: current one with the two furthest, the means of the current one with the furthest and its mirror image, or a cut.
RULES = ("sigma", "sigmas", "far", "random", "two_far", "two_random", "means", "mirror", "cut")
AXES = ("pca", "regression", "furthest")
#: Where the axis is cut: at the centroid, where the error falls most (optimal, also by the names of its two variants), at the
#: unweighted mean of the bins, in the middle of the extremes, where the first three moments are kept, or by scalar 2-means.
PIVOTS = ("centroid", "optimal", "optimal-equitz", "optimal-wu", "weighted", "middle", "moments", "lloyd")


def cut_of(size: np.ndarray, sums: np.ndarray, pivot: str) -> int:
    """The number of bins on the lower side, from 1 to len - 1. size and sums: weights and sums of vectors by bin."""
    w = size.astype(float)
    if pivot.startswith("optimal"):
        left = np.cumsum(w)[:-1]
        s = np.cumsum(sums.astype(float), 0)
        both = np.where((left > 0) & (left < w.sum()), 1.0, np.nan)
        gain = (s[:-1] ** 2).sum(1) / np.maximum(left, 1) + ((s[-1] - s[:-1]) ** 2).sum(1) / np.maximum(w.sum() - left, 1)
        gain = gain * both
        return int(np.nanargmax(gain)) + 1 if np.isfinite(gain).any() else len(w) // 2
    at, used = np.arange(len(w)) + 0.5, w > 0
    if pivot == "centroid":
        cut = (at * w).sum() / w.sum()
    elif pivot == "weighted":
        cut = at[used].mean()
    elif pivot == "middle":
        cut = len(w) / 2
    elif pivot == "moments":
        m1, m2, m3 = ((at**p * w).sum() / w.sum() for p in (1, 2, 3))
        spread = m2 - m1 * m1
        skew = 0.0 if spread <= 0 else (m3 - 3 * m1 * m2 + 2 * m1**3) / spread**1.5
        share = 0.5 * (1 + skew / np.sqrt(4 + skew * skew))  # of the lower level's points
        return int(np.clip(np.searchsorted(np.cumsum(w), share * w.sum()) + 1, 1, len(w) - 1))
    else:
        cut = (at * w).sum() / w.sum()
        for _ in range(100):
            low, high = (at < cut) & used, (at >= cut) & used
            if not low.any() or not high.any():
                break
            new = ((at * w)[low].sum() / w[low].sum() + (at * w)[high].sum() / w[high].sum()) / 2
            if new == cut:
                break
            cut = new
    return int(np.clip(round(cut), 1, len(w) - 1))


def cuts(points: Points, c: np.ndarray, which: list[int], axis: str = "pca", pivot: str = "optimal") -> dict[int, tuple[np.ndarray, float]]:
    """For some clusters the two centroids of a cut across an axis and how much the error falls. All points of a cluster
    count; cuts are at the edges of 256 bins of its extent."""
    if axis not in AXES or pivot not in PIVOTS:
        raise ValueError(f"no axis {axis!r} or pivot {pivot!r}")
    out = {}
    for j, (low, high, size, sums) in points.histograms(c, points.axes(c, which, axis)).items():
        if low == high:
            continue
        at = cut_of(size, sums, pivot)
        parts = [(int(size[p].sum()), [int(x) for x in sums[p].sum(0)]) for p in (slice(at), slice(at, None))]
        if min(n for n, _ in parts) < 1:
            continue
        two = np.array([[(2 * s + n) // (2 * n) for s in total] for n, total in parts], np.int64)
        whole = [a + b for a, b in zip(parts[0][1], parts[1][1], strict=True)]
        gain = sum(sum(float(s) ** 2 for s in total) / n for n, total in parts) - sum(float(s) ** 2 for s in whole) / sum(n for n, _ in parts)
        out[j] = two, gain
    return out


def pair(points: Points, c: np.ndarray, j: int, rule: str, seed: str) -> np.ndarray | None:
    """The two vectors that take the place of centroid j, by a rule that does not cut; None if they would be the same."""
    own, now = points.within(c, j), c[j]
    if own.size < 2:
        return None
    if rule in ("sigma", "sigmas"):
        n = own.weight
        var = own.fold(lambda _, x, w: ((x - now).astype(object) ** 2 * w[:, None].astype(object)).sum(0), own.dim)
        step = np.array([int(np.floor(np.sqrt(float(v) / n) + 0.5)) for v in var], np.int64)
        two = [now, now + step] if rule == "sigma" else [now - step, now + step]
    elif rule == "random":
        two = [now, own.sample(1, seed)[0]]
    elif rule == "two_random":
        two = list(own.sample(2, seed))
    else:
        far = own.unweighted().worst(now[None], 1)[0]
        if rule == "far":
            two = [now, far]
        elif rule == "mirror":
            two = [(now + far + 1) // 2, (3 * now - far + 1) // 2]
        else:
            other = own.unweighted().worst(far[None], 1)[0]
            two = [far, other] if rule == "two_far" else [(now + far + 1) // 2, (now + other + 1) // 2]
    out = np.array(two, np.int64)
    return None if (out[0] == out[1]).all() else out


def order_of(points: Points, c: np.ndarray, choice: str, seed: str) -> list[int]:
    """The clusters in the order in which they are to be split."""
    s = points.statistics(c)
    if choice == "size":
        return np.argsort(-s.n, kind="stable").tolist()
    if choice == "random":
        return sorted(range(len(c)), key=lambda j: drawn(f"{seed}/{j}", 1 << 52))
    if choice == "furthest":
        far = points.furthest(c, c)
        return sorted(range(len(c)), key=lambda j: (-int(((far[j] - c[j]) ** 2).sum()) if j in far else 0, j))
    if choice == "third":
        k = len(c)

        def flat(_: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
            from ..plans.engine import nearest

            of, d2, _ = nearest(x, c)
            out = np.zeros(k, object)
            np.add.at(out, of, np.array([round(d**1.5) * v for d, v in zip(d2.tolist(), w.tolist(), strict=True)], object))
            return out

        third = points.fold(flat, k)
        return sorted(range(k), key=lambda j: (-int(third[j]), j))
    return sorted(range(len(c)), key=lambda j: (-int(s.error[j]), j))


def split(points: Points, codebook: np.ndarray, k: int, choice: str = "optimal", axis: str = "pca", tune: int = 2, seed: str = "0", rule: str = "cut", pivot: str = "optimal", inside: int = 0) -> Solution:
    """Splits clusters in two until there are k.

    choice: which cluster, see CHOICES; optimal looks at all. rule: its two new vectors, see RULES; a cut goes across an axis
    at a pivot. inside: K-means iterations of the two on the cluster's own points (local), after which all points are
    assigned again; tune: K-means iterations of the whole codebook after each split (global).
    """
    if choice not in CHOICES or rule not in RULES:
        raise ValueError(f"no choice {choice!r} or rule {rule!r}")
    c, turn = np.asarray(codebook, np.int64), []
    while len(c) < k:
        best = None
        if choice == "optimal" and rule == "cut":
            found = cuts(points, c, list(range(len(c))), axis, pivot)
            if found:
                j = min(found, key=lambda j: (-found[j][1], j))
                best = j, found[j][0]
        else:
            order = order_of(points, c, choice, f"{seed}/{len(c)}")
            if choice == "all":
                turn = turn[1:] or list(range(len(c)))
                order = [*turn, *(j for j in order if j not in turn)]
            for j in order:
                two = cuts(points, c, [j], axis, pivot).get(j, (None,))[0] if rule == "cut" else pair(points, c, j, rule, f"{seed}/{len(c)}")
                if two is not None:
                    best = j, two
                    break
        if best is None:
            break
        j, two = best
        if inside:
            two = lloyd(points.within(c, j), two, inside).codebook
        c = np.concatenate([c, two[1:]])
        c[j] = two[0]
        if tune:
            c = lloyd(points, c, tune).codebook
    s = points.statistics(c)
    return Solution(c, s.n, s.sse)


ORDERS = ("split-merge", "merge-split", "fifty", "better")


def split_and_merge(points: Points, codebook: np.ndarray, iterations: int = 10, step: int = 2, order: str = "split-merge", tune: int = 2, decay: float = 0.0, seed: str = "0", noise=None, least: int = 1, most: int = 0) -> Solution:
    """Splits some clusters and merges as many, in turn; the best codebook of the nominal size is kept, and restored if the
    last one has another size.

    order: split-merge, merge-split, fifty (one of them at random) or better (both, the better one stays, a coin at ties).
    step: how many, cut so that sizes stay within least and most (0: twice the nominal size), less by the share `decay` each
    time. noise(codebook, iteration) is added before tuning.
    """
    if order not in ORDERS:
        raise ValueError(f"no order {order!r}")
    k, most = len(codebook), most or 2 * len(codebook)
    best = now = lloyd(points, codebook, tune)
    history, size = [best.sse], float(step)

    def up(s: Solution, to: int, i: int) -> Solution:
        return split(points, s.codebook, to, "error", tune=0, seed=f"{seed}/{i}")

    def down(s: Solution, to: int) -> Solution:
        c, _ = pnn(s.codebook, points.statistics(s.codebook).n, to)
        t = points.statistics(c)
        return Solution(c, t.n, t.sse)

    for i in range(iterations):
        h = max(1, int(size))
        grow, fall = min(h, most - k), min(h, k - least)
        first = order == "split-merge" or (order == "fifty" and not drawn(f"{seed}/order/{i}", 2))
        made = []
        if (first or order == "better") and grow > 0:
            made.append(down(up(now, k + grow, i), k))
        if (not first or order == "better") and fall > 0:
            made.append(up(down(now, k - fall), k, i))
        if not made:
            break
        if len(made) == 2 and made[0].sse == made[1].sse and drawn(f"{seed}/coin/{i}", 2):
            made.reverse()
        now = min(made, key=lambda s: s.sse)
        c = noise(now.codebook, i) if noise else now.codebook
        now = lloyd(points, filled(points, c, points.statistics(c).n), tune, True)
        size *= 1 - decay
        best = now if len(now.codebook) == k and now.sse < best.sse else best
        history.append(best.sse)
    return Solution(best.codebook, best.n, best.sse, history)


def initial(points: Points, k: int, seed: str = "0") -> np.ndarray:
    """A random codebook without duplicates."""
    return random_init(points, k, seed)
