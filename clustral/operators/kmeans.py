"""K-means, initial codebooks, random swap and annealing.

Algorithms hold the codebook on the driver and see the points through plans.engine, so they run on Spark and in memory, with
the same results. Random choices are hashes of a seed of the caller's, so runs repeat and can be written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..plans.engine import Local, Points, Products, Stats, distances, nearest, statistics_of
from .relational import hash_number
from .search import SEARCHES, changed, reassign


@dataclass
class Solution:
    """A codebook, its clusters' weights and its squared error. history: the error after each step; moved: the number of
    centroids that each step moved; index: the centroid index against a reference after each step, if asked for."""

    codebook: np.ndarray
    n: np.ndarray
    sse: int
    history: list[int] = field(default_factory=list)
    moved: list[int] = field(default_factory=list)
    index: list[int] = field(default_factory=list)

    def mse(self, points: Points) -> float:
        return self.sse / (points.weight * points.dim)


def of_codebook(points: Points, c: np.ndarray) -> Solution:
    """A codebook as a solution: its points and error, without moving it."""
    s = points.statistics(np.asarray(c, np.int64))
    return Solution(np.asarray(c, np.int64), s.n, s.sse, [s.sse])


def drawn(seed: str, below: int) -> int:
    """A number under `below` that looks random."""
    return hash_number(seed, "draw") * below >> 52


def _check(points: Points, k: int) -> None:
    if not 0 < k <= points.size:
        raise ValueError(f"{k} clusters of {points.size} points")


def medoids(points: Points, c: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the member nearest to it, ties to the smaller id; empty clusters keep theirs."""
    if isinstance(points, Local):
        of, d2, _ = nearest(points.x, c)
        out, order = c.copy(), np.lexsort((points.ids, d2))
        for i in order[::-1].tolist():
            out[of[i]] = points.x[i]
        return out
    from pyspark.sql import functions as F

    out, least = c.copy(), F.min(F.struct("d2", "id", "v")).alias("m")
    for r in points.assigned(c).groupBy("cid").agg(least).collect():  # a row a cluster
        out[r["cid"]] = r["m"]["v"]
    return out


def filled(points: Points, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Empty clusters get the points that cost most, in order of their numbers."""
    empty = np.flatnonzero(n == 0)
    if len(empty):
        c = c.copy()
        worst = points.worst(c, len(empty))
        c[empty[: len(worst)]] = worst
    return c


def lloyd(points: Points, codebook: np.ndarray, iterations: int = 0, fill: bool = False, search: str = "full", members: bool = False, noise: Callable[[np.ndarray, int], np.ndarray] | None = None) -> Solution:
    """Assigns and re-centres until the error falls no more, or so many times (0: no limit).

    fill: empty clusters get the points that cost most, and the clusters that lose them are centred without them first.
    Without it they keep their vectors. search: how the engine in memory looks for the nearest (all with the same result;
    Spark's passes look at all pairs). members: centroids are members of their clusters. noise(codebook, step) is added to
    each new codebook.
    """
    if search not in SEARCHES:
        raise ValueError(f"no search {search!r}")
    c = np.asarray(codebook, np.int64)
    s, history, moved, of = points.statistics(c), [], [], None
    while True:
        history.append(s.sse)
        if iterations and len(history) > iterations:
            break
        new = s.centroids(c)
        if fill and (s.n == 0).any():
            new = filled(points, new, s.n)
        if members:
            new = medoids(points, new)
        if noise:
            new = noise(new, len(history))
        if search != "full" and isinstance(points, Local):
            of = nearest(points.x, c)[0] if of is None else of
            of_new, d2, _ = reassign(points.x, new, c, of, search)
            t = statistics_of(points.x, points.w, len(new), of_new, d2, d2)
        else:
            of_new, t = None, points.statistics(new)
        if t.sse >= s.sse:
            break
        moved.append(len(changed(c, new)))
        c, s, of = new, t, of_new
    return Solution(c, s.n, s.sse, history, moved)


# initial codebooks


def random_init(points: Points, k: int, seed: str = "0", unique: bool = True) -> np.ndarray:
    """k points by a hash; without duplicate vectors if unique, as long as there are k different ones."""
    _check(points, k)
    many = k
    while True:
        many = min(points.size, 4 * many + 100) if unique else k
        x = points.sample(many, seed)
        seen: dict[tuple, int] = {}
        for i, v in enumerate(map(tuple, x.tolist())):
            seen.setdefault(v, i)
        if not unique or len(seen) >= k or many == points.size:
            break
    if not unique:
        return x
    first = [*seen.values()][:k]
    rest = sorted(set(range(len(x))) - set(first))
    return x[[*first, *rest][:k]]


def weighted_init(points: Points, k: int, seed: str = "0") -> np.ndarray:
    """k points by weight, each drawn anew while it is one that was drawn, 100 times at most."""
    _check(points, k)
    out: list[tuple] = []
    for i in range(k):
        for t in range(100):
            v = tuple(points.pick(drawn(f"{seed}/{i}/{t}", 1 << 52) / (1 << 52)).tolist())
            if v not in out:
                break
        out.append(v)
    return np.array(out, np.int64)


def plus_plus_init(points: Points, k: int, seed: str = "0", tries: int = 1) -> np.ndarray:
    """D-squared sampling: each point is drawn by its weight times its squared distance to those drawn before; of some
    tries the one that leaves the least error."""
    _check(points, k)
    u = lambda i, t: drawn(f"{seed}/{i}/{t}", 1 << 52) / (1 << 52)
    c = points.pick(u(0, 0))[None]
    while len(c) < k:
        made = [np.concatenate([c, points.pick(u(len(c), t), c)[None]]) for t in range(tries)]
        c = made[0] if tries == 1 else min(made, key=lambda x: points.statistics(x).sse)
    return c


def maxmin_init(points: Points, k: int, from_mean: bool = True, seed: str = "0") -> np.ndarray:
    """Furthest first: from the mean of all points or from a random one, then what is furthest from those chosen."""
    _check(points, k)
    zero = np.zeros((1, points.dim), np.int64)
    c = points.statistics(zero).centroids(zero) if from_mean else points.sample(1, seed)
    plain = points.unweighted()
    while len(c) < k:
        c = np.concatenate([c, plain.worst(c, 1)])
    return c


def bradley_init(points: Points, k: int, subsets: int = 10, share: int = 10, seed: str = "0") -> np.ndarray:
    """K-means on as many sub-samples, each of a tenth of the points, then on the pooled centroids from each sub-sample's
    solution; the best on the pool."""
    _check(points, k)
    found = []
    for j in range(subsets):
        own = part(points, share, f"{seed}/{j}")
        own = own if own.size >= k else Local(points.sample(k, f"{seed}/{j}"))
        found.append(lloyd(own, random_init(own, k, seed), 50, True).codebook)
    pool = Local(np.concatenate(found))
    return min((lloyd(pool, c, 50) for c in found), key=lambda s: s.sse).codebook


def part(points: Points, share: int, seed: str) -> Points:
    """About one of `share` points, by a hash, unweighted, in the same engine: on Spark they stay on the executors."""
    if isinstance(points, Local):
        own = np.array([hash_number(seed, i) % share == 0 for i in points.ids.tolist()], bool)
        return Local(points.x[own], None, points.ids[own])
    from pyspark.sql import functions as F

    from ..plans.engine import Spark
    from .relational import by_hash

    number = F.conv(F.substring(by_hash(points.points, seed), 1, 13), 16, 10).cast("bigint")
    return Spark(points.points.where(number % share == 0).withColumn("freq", F.lit(1).cast("bigint")))


def projection_init(points: Points, k: int, furthest: bool = False, seed: str = "0") -> np.ndarray:
    """All points in order of their projection on an axis, every so manieth taken. The axis goes through two random points,
    or through one and what is furthest from it."""
    _check(points, k)
    two = points.sample(2, seed)
    other = points.unweighted().worst(two[:1], 1)[0] if furthest else two[-1]
    return points.ranked("dot", two[0] - other, [i * (points.size // k) for i in range(k)])


def sorting_init(points: Points, k: int, seed: str = "0") -> np.ndarray:
    """All points in order of their distance to a random one, the middle of each of k parts."""
    _check(points, k)
    return points.ranked("d2", points.sample(1, seed)[0], [(i * points.size + points.size // 2) // k for i in range(k)])


def stratified_init(points: Points, k: int, seed: str = "0") -> np.ndarray:
    """One point of each of k equal parts of all points in an order by hashes; the last part is open."""
    _check(points, k)
    size = points.size // k
    ranks = [i * size + drawn(f"{seed}/{i}", size if i < k - 1 else points.size - i * size) for i in range(k)]
    return points.ranked("hash", seed, ranks)


def partition_init(points: Points, k: int, tries: int = 5, seed: str = "0") -> np.ndarray:
    """Random labels for all points, their centroids; the best of some tries. A part without points gets a random one."""
    _check(points, k)
    spare = random_init(points, k, seed, False)
    found = [points.labelled(f"{seed}/{t}", k).centroids(spare) for t in range(tries)]
    return min(found, key=lambda c: points.statistics(c).sse)


def luxburg_init(points: Points, k: int, seed: str = "0") -> np.ndarray:
    """k log2 k random points, one K-means step, small clusters dropped, then furthest first among those left."""
    _check(points, k)
    many = min(points.size, max(k, int(k * np.log2(max(k, 2)))))
    c = random_init(points, many, seed)
    s = points.statistics(c)
    c = s.centroids(c)
    order = np.argsort(-s.n, kind="stable")
    c = c[order[: max(k, int((s.n * many >= points.weight).sum()))]]
    chosen = [drawn(seed, len(c))]
    while len(chosen) < k:
        d = distances(c, c[chosen]).min(1)
        d[chosen] = -1
        chosen.append(int(d.argmax()))
    return c[chosen]


def splitting_init(points: Points, k: int, iterations: int = 5, seed: str = "0") -> np.ndarray:
    """The largest cluster is split by 2-means on all its points until there are k."""
    _check(points, k)
    zero = np.zeros((1, points.dim), np.int64)
    c = points.statistics(zero).centroids(zero)
    while len(c) < k:
        s = points.statistics(c)
        for j in np.argsort(-s.n, kind="stable").tolist():
            own = points.within(c, j)
            two = random_init(own, 2, f"{seed}/{len(c)}") if own.size > 1 else c[:0]
            if len(two) and (two[0] != two[1]).any():
                two = lloyd(own, two, iterations).codebook if iterations else two
                c = np.concatenate([c[:j], two[:1], c[j + 1 :], two[1:]])
                break
        else:
            return np.concatenate([c, random_init(points, k - len(c), seed, False)])
    return c


#: Densities: of nearest neighbours by dimension, of the exact neighbour graph, of a window by dimension, random.
DENSITIES = ("axis", "graph", "window", "random")
#: What peaks are chosen by: the distance to a denser point, that times the density, the density.
DELTAS = ("plain", "gamma", "density")


def density_init(points: Points, k: int, neighbours: int = 0, seed: str = "0", density: str = "graph", delta: str = "gamma") -> np.ndarray:
    """Density peaks of all points; ties to the smaller id. Points meet every denser one, in blocks."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import graphs

    _check(points, k)
    if density not in DENSITIES or delta not in DELTAS:
        raise ValueError(f"no density {density!r} or delta {delta!r}")
    near = neighbours or min(50, max(2, points.size // k // 2))
    if isinstance(points, Local):
        spark = SparkSession.active()
        rows = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(points.ids, points.x, strict=True)], "id long, v array<long>, freq long")
    else:
        rows = points.points
    top = graphs.density_peaks(rows, graphs.densities(rows, density, near, seed), delta).orderBy(F.desc("peak"), "id").limit(k)
    found = rows.join(F.broadcast(top), "id").orderBy(F.desc("peak"), "id").collect()  # k rows
    return np.array([r["v"] for r in found], np.int64).reshape(-1, points.dim)


def hybrid_init(points: Points, k: int, times: int = 20, neighbours: int = 0, seed: str = "0") -> np.ndarray:
    """Density peaks of a sample of `times` k points, by a hash."""
    _check(points, k)
    return density_init(Local(points.sample(min(points.size, times * k), seed)), k, neighbours, seed)


def overlap_init(points: Points, k: int, variant: float = 2.0, seed: str = "0") -> np.ndarray:
    """K-means on all points with mixtures of pairs added, which draws clusters together: (variant - 1) mixtures a point, of
    it and of a random one of 1,024 others."""
    _check(points, k)
    others = points.sample(min(points.size, 1024), f"{seed}/others")
    more = max(0, round(1000 * (variant - 1)))

    def mixtures(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of the mixtures of some points; a rest of more / 1000 has one for as many points."""
        out_ids, out = [], []
        for i, v in zip(ids.tolist(), x, strict=True):
            for j in range(more // 1000 + (hash_number(f"{seed}/some", i) % 1000 < more % 1000)):
                t = hash_number(f"{seed}/share/{j}", i) % 1001
                other = others[hash_number(f"{seed}/other/{j}", i) % len(others)]
                out_ids.append(hash_number(f"{seed}/id/{j}", i))
                out.append((2 * (v * t + other * (1000 - t)) + 1000) // 2000)
        return np.array(out_ids, np.int64), np.array(out, np.int64).reshape(-1, x.shape[1])

    if isinstance(points, Local):
        ids, x = mixtures(points.ids, points.x)
        mixed: Points = Local(np.concatenate([points.x, x]), None, np.concatenate([points.ids, ids]))
    else:
        import pyarrow as pa
        from pyspark.sql import functions as F

        from ..plans.engine import Spark

        dim = points.dim

        def rows(batches):
            for b in batches:
                ids, x = mixtures(b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(-1, dim))
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "v": pa.array(x.tolist(), pa.list_(pa.int64())), "freq": pa.array(np.ones(len(ids), np.int64))})

        own = points.points.withColumn("freq", F.lit(1).cast("bigint"))
        mixed = Spark(own.union(own.mapInArrow(rows, "id long, v array<long>, freq long")))
    return lloyd(mixed, random_init(mixed, k, seed), 50, True).codebook


def exhaustive_init(points: Points, k: int, seed: str = "0", most: int = 100_000) -> np.ndarray:
    """The best of all combinations of k distinct points; an error where there are more than `most`."""
    from itertools import combinations
    from math import comb

    _check(points, k)
    x = np.unique(points.sample(points.size if points.size <= most else most + 1, seed), axis=0)
    if comb(len(x), k) > most:
        raise ValueError("too many combinations")
    best = min(combinations(range(len(x)), k), key=lambda own: points.statistics(x[list(own)]).sse)
    return x[list(best)]


INITS = {"random": random_init, "weighted": weighted_init, "kmeans++": plus_plus_init, "bradley": bradley_init, "projection": projection_init, "luxburg": luxburg_init, "maxmin": maxmin_init, "partition": partition_init, "splitting": splitting_init, "sorting": sorting_init, "density": density_init, "hybrid": hybrid_init, "stratified": stratified_init, "overlap": overlap_init}


def kmeans(points: Points, k: int, init: str = "random", repeats: int = 1, iterations: int = 0, seed: str = "0", start: np.ndarray | None = None, search: str = "full") -> Solution:
    """The best of some runs; the first from `start` if given."""
    best = None
    for r in range(repeats):
        c = start if start is not None and not r else INITS[init](points, k, seed=f"{seed}/{r}")
        s = lloyd(points, c, iterations, search=search)
        best = s if best is None or s.sse < best.sse else best
    return best


# random swap


def swapped(points: Local, c: np.ndarray, of: np.ndarray, j: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid j replaced by v, and local repartition: the points of j go to their nearest, v attracts what is nearer to it.
    (codebook, cid, d2), as a full search would assign them."""
    new = c.copy()
    new[j] = v
    return new, *reassign(points.x, new, c, of, "local")[:2]


def random_swap(points: Points, k: int, trials: int = 5000, iterations: int = 2, deterministic: bool = False, seed: str = "0", start: np.ndarray | None = None, reference: np.ndarray | None = None) -> Solution:
    """Replaces a centroid by a point, repartitions, tunes with a few K-means iterations, keeps what is strictly better.

    deterministic: the centroid that costs least to remove goes, chosen anew after a success. trials 0: ends when the gain
    of two trials together is under 1e-5, after 50000 at most. A swap looks only at the points of the cluster that goes and
    at the new centroid. Trials that follow each other are made together from the same codebook; those behind a success are
    made again from the new one, so that all is as if they came one by one. With a reference codebook the centroid index is
    noted after each trial.
    """
    best = lloyd(points, random_init(points, k, seed) if start is None else start, iterations)
    history, index, gains, victim = [best.sse], [], [1.0, 1.0], None
    size, pools, limit, trial = min(points.size, 1000), {}, trials or 50_000, 0
    top = max(points.top(), int(np.abs(best.codebook).max(initial=0)))
    products = Products(len(best.codebook), points.dim, top, points.weight)
    most = 1 if not products.fits else 2 if not trials else 8 if isinstance(points, Local) else max(8, min(128, (1 << 17) // (k * (points.dim + 1))))
    squares, many = points.squares() if products.fits else 0, min(8, most)
    try:
        while trial < limit:
            swaps: list[tuple[int, np.ndarray] | None] = []
            for t in range(trial, min(limit, trial + many)):
                if t // size not in pools:
                    pools = {t // size: points.sample(size, f"{seed}/swap/{t}" if t else f"{seed}/swap")} | {q: p for q, p in pools.items() if q == t // size - 1}
                v = pools[t // size][t % size]
                if (best.codebook == v).all(1).any():
                    swaps.append(None)
                    continue
                if deterministic and victim is None:
                    victim = int(points.statistics(best.codebook).loss.argmin())
                swaps.append((victim if deterministic else drawn(f"{seed}/victim/{t}", k), v))
            made = iter(_swapped(points, best, [s for s in swaps if s], iterations, products, squares))
            for swap in swaps:
                s, trial = next(made) if swap else None, trial + 1
                better = s is not None and s.sse < best.sse
                if s is not None:
                    gains = [gains[-1], (best.sse - s.sse) / max(1, best.sse) if better else 0.0]
                if better:
                    best, victim = s, None
                history.append(best.sse)
                if reference is not None:
                    index.append(centroid_index(best.codebook, reference))
                if better or not trials and sum(gains) < 1e-5:
                    break
            if not trials and sum(gains) < 1e-5:
                break
            many = max(min(8, most), many // 2) if better else min(most, 2 * many)
        if best.n is None:
            best.n = points.together(products, products.job(best.codebook[None], True))[0, :, -1]
    finally:
        points.forget()
    return Solution(best.codebook, best.n, best.sse, history, [], index)


def _swapped(points: Points, best: Solution, swaps: list[tuple[int, np.ndarray]], iterations: int, products: Products, squares: int) -> list[Solution]:
    """What lloyd makes of the codebook with each of the swaps; the weights n are missing where only the error was needed."""
    if not swaps:
        return []
    if not products.fits:
        (j, v), *_ = swaps
        if isinstance(points, Local):
            c, cid, d2 = swapped(points, best.codebook, nearest(points.x, best.codebook)[0], j, v)
            return [_tuned(points, c, cid, d2, iterations)[0]]
        c = best.codebook.copy()
        c[j] = v
        return [lloyd(points, c, iterations)]
    at, v = np.array([j for j, _ in swaps]), np.array([v for _, v in swaps], np.int64)
    books = np.repeat(best.codebook[None], len(swaps), 0)
    books[np.arange(len(swaps)), at] = v
    sums, done = points.together(products, products.swaps(best.codebook, at, v)), 0
    out = [Solution(c, s[:, -1], _error(c, s, squares)) for c, s in zip(books, sums, strict=True)]
    going = list(range(len(out)))
    while going and (not iterations or done < iterations):
        done += 1
        new = np.array([Stats(s[:, -1], s[:, :-1], s, s).centroids(out[i].codebook) for i, s in zip(going, sums, strict=True)])
        last = done == iterations
        sums = points.together(products, products.job(new, not last))
        made = [Solution(c, None, squares + int(s)) if last else Solution(c, s[:, -1], _error(c, s, squares)) for c, s in zip(new, sums, strict=True)]
        less = [a for a, i in enumerate(going) if made[a].sse < out[i].sse]
        for a in less:
            out[going[a]] = made[a]
        going, sums = [going[a] for a in less], sums[less]
    return out


def _error(c: np.ndarray, sums: np.ndarray, squares: int) -> int:
    """The squared error of a codebook from its clusters' sums and weights."""
    c = c.astype(object)
    return squares + int((sums[:, -1] * (c * c).sum(1) - 2 * (sums[:, :-1] * c).sum(1)).sum())


def _tuned(points: Local, c: np.ndarray, of: np.ndarray, d2: np.ndarray, iterations: int) -> tuple[Solution, np.ndarray]:
    """lloyd from an assignment, by local searches; and the last assignment."""
    s, done = statistics_of(points.x, points.w, len(c), of, d2, d2), 0
    while not iterations or done < iterations:
        new = s.centroids(c)
        now, d2, _ = reassign(points.x, new, c, of, "local")
        t = statistics_of(points.x, points.w, len(c), now, d2, d2)
        if t.sse >= s.sse:
            break
        c, s, of, done = new, t, now, done + 1
    return Solution(c, s.n, s.sse), of


def success_histogram(history: list[int], parts: int = 10) -> list[int]:
    """How many steps of each part of a run lowered the error."""
    gains = [b < a for a, b in zip(history, history[1:], strict=False)]
    return [sum(gains[i * len(gains) // parts : (i + 1) * len(gains) // parts]) for i in range(parts)]


def centroid_index(a: np.ndarray, b: np.ndarray) -> int:
    """How many centroids of one codebook are nearest to none of the other, the larger of both ways."""
    orphans = lambda x, y: len(y) - len(set(nearest(x, y)[0].tolist()))
    return max(orphans(a, b), orphans(b, a))


# annealing


@dataclass
class Annealing:
    """Noise for codebooks whose amplitude falls step by step: linear, or by a share (change / 10000), not under 0. kind:
    uniform, or gaussian with the amplitude as its deviation."""

    amplitude: float
    change: float
    linear: bool = True
    kind: str = "uniform"

    def cool(self) -> None:
        self.amplitude = max(0.0, self.amplitude - self.change if self.linear else self.amplitude * (1 - self.change / 10_000))

    def noisy(self, c: np.ndarray, top: int, seed: str = "0") -> np.ndarray:
        """Each element moved by noise, halves up, kept in [0, top]."""
        if self.kind not in ("uniform", "gaussian"):
            raise ValueError(f"no noise {self.kind!r}")
        rng = np.random.default_rng(hash_number(seed, "noise"))
        shift = rng.uniform(-self.amplitude, self.amplitude, c.shape) if self.kind == "uniform" else rng.normal(0, self.amplitude, c.shape)
        return np.clip(np.floor(c + shift + 0.5), 0, top).astype(np.int64)


def anneal(points: Points, codebook: np.ndarray, schedule: Annealing, rounds: int, top: int, seed: str = "0") -> Solution:
    """K-means iterations with noise in between."""
    best = now = lloyd(points, codebook, 1)
    for r in range(rounds):
        now = lloyd(points, schedule.noisy(now.codebook, top, f"{seed}/{r}"), 1)
        schedule.cool()
        best = now if now.sse < best.sse else best
    return lloyd(points, best.codebook)
