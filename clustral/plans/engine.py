"""What the search algorithms need of a set of points, over Spark or in memory, with the same results.

A pass over the points folds them into a number of integers that does not depend on how many points there are: clusters'
weights, sums and errors, histograms, extremes. All sums are of integers and exact, whatever their size, and all choices go
by ids or hashes of ids, so results don't depend on partitions nor on the engine. The engine in memory is for sets of bounded
size, where a pass costs less than starting a job.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.relational import BIG, at_ranks, by_hash, hash_number

EXACT = 1 << 53
#: Sums below this are made in 64 bits.
SAFE = 1 << 62
#: Ranges of ids that a pick looks through.
RANGES = 1024


@dataclass(frozen=True)
class Stats:
    """n, sums, error: by cluster; sse: their total; loss: what each cluster's points lose at their second centroid."""

    n: np.ndarray
    sums: np.ndarray
    error: np.ndarray
    loss: np.ndarray

    @property
    def sse(self) -> int:
        return int(sum(self.error.tolist()))

    def centroids(self, old: np.ndarray) -> np.ndarray:
        """Rounded means, halves up; empty clusters keep their vectors."""
        out = old.copy()
        for k in np.flatnonzero(self.n > 0).tolist():
            n = int(self.n[k])
            out[k] = [(2 * int(s) + n) // (2 * n) for s in self.sums[k]]
        return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of all pairs."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - c[None, :, d]) ** 2
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cid, d2, second d2) of each point, a block at a time."""
    of, d2, second = (np.zeros(len(x), np.int64) for _ in range(3))
    step = max(1, 4_000_000 // max(1, len(c)))
    for i in range(0, len(x), step):
        d = distances(x[i : i + step], c)
        rows = np.arange(len(d))
        of[i : i + step] = own = d.argmin(1)
        d2[i : i + step] = d[rows, own]
        if len(c) > 1:
            d[rows, own] = np.iinfo(np.int64).max
            second[i : i + step] = d.min(1)
    return of, d2, second


def exactly(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """values * weights (weights by row) in a type in which also the products' sum is exact."""
    top = int(np.abs(values).max(initial=0)) * int(weights.sum() if len(weights) else 0)
    kind = np.int64 if top < SAFE else object
    return values.astype(kind) * (weights if values.ndim == 1 else weights[:, None]).astype(kind)


def added(to: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """The sums of values (by row) by their number in `to`."""
    out = np.zeros((many, *values.shape[1:]), values.dtype)
    np.add.at(out, to, values)
    return out


def statistics(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> Stats:
    return statistics_of(x, w, len(c), *nearest(x, c))


def statistics_of(x: np.ndarray, w: np.ndarray, k: int, of: np.ndarray, d2: np.ndarray, second: np.ndarray) -> Stats:
    return Stats(added(of, w, k), added(of, exactly(x, w), k), added(of, exactly(d2, w), k), added(of, exactly(second - d2, w), k))


Fold = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Products:
    """Many codebooks of k clusters at once, by matrix products that are exact in doubles: a key of point and centroid is what
    their squared distance adds to the point's own square, times a power of two, plus the centroid's number, so that the least
    key tells the nearest centroid, the lowest of several. fits: whether no element is too large for that."""

    def __init__(self, k: int, dim: int, top: int, weight: int) -> None:
        self.k, self.bits = k, max(1, (k - 1).bit_length())
        self.fits = (4 * max(1, dim) * top * top + 1) << self.bits < EXACT and max(1, top) * weight < EXACT and (3 * max(1, dim) * top * top >> 20) * weight < SAFE and weight << 20 < SAFE

    @staticmethod
    def block(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points as the products need them."""
        x = x.astype(np.float64)
        return np.concatenate([x.T, np.ones((1, len(x)))]), np.concatenate([x * w[:, None], w[:, None]], 1), w.astype(np.int64)

    def rows(self, c: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """What a block's points are multiplied by to get the keys of centroids of these numbers."""
        return np.concatenate([-2 * c << self.bits, ((c * c).sum(-1) << self.bits)[..., None] + numbers[..., None]], -1).astype(np.float64)

    def job(self, codebooks: np.ndarray, sums: bool) -> tuple:
        return None, self.rows(codebooks, np.broadcast_to(np.arange(self.k), codebooks.shape[:2])), None, sums

    def swaps(self, c: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple:
        """Codebooks that each have one centroid of c replaced: a point goes to the new one or stays with its own, or if that
        has gone with its second."""
        return self.rows(c, np.arange(self.k)), self.rows(v, at)[:, None], at, True

    def run(self, job: tuple, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """By codebook, of a block's points: by cluster the weighted sums of vectors and the weights; or the errors less the
        points' own squares."""
        base, rows, at, sums = job
        left, right, w = block
        n, k = left.shape[1], self.k
        if base is not None:
            keys = base @ left
            own = keys.min(0)
            now = own.astype(np.int64) & ((1 << self.bits) - 1)
            keys[now, np.arange(n)] = np.inf
            second = keys.min(0)
        out = np.zeros((len(rows), k, left.shape[0]), np.int64) if sums else np.zeros(len(rows), object)
        step = max(1, (1 << 18) // (k * max(1, n)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            keys = (part.reshape(-1, part.shape[2]) @ left).reshape(len(part), -1, n)
            best = keys.min(1)
            if base is not None:
                best = np.minimum(best, np.where(now == at[i : i + step, None], second, own))
            best = best.astype(np.int64)
            if sums:
                there = (best & ((1 << self.bits) - 1))[:, None] == np.arange(k)[:, None]
                out[i : i + step] = (there.astype(np.float64).reshape(-1, n) @ right).reshape(len(part), k, -1)
            else:
                d = best >> self.bits  # in two parts, so that sums stay in 64 bits
                out[i : i + step] = (((d >> 20) * w).sum(1).astype(object) << 20) + ((d & ((1 << 20) - 1)) * w).sum(1)
        return out


class Engine:
    """What both engines do in the same way, by folds: fold(f, size) sums f(ids, x, w), an array of `size` integers, over
    all points; how: sum, min or max."""

    size: int
    weight: int
    dim: int

    def fold(self, f: Fold, size: int, how: str = "sum") -> np.ndarray:
        raise NotImplementedError

    def together(self, products: Products, job: tuple) -> np.ndarray:
        """What Products.run tells of all points."""
        raise NotImplementedError

    def squares(self) -> int:
        """The weighted sum of the points' squared lengths."""
        return int(self.fold(lambda _, x, w: np.array([sum(exactly(distances(x, np.zeros((1, x.shape[1]), np.int64))[:, 0], w).tolist())], object), 1)[0])

    def statistics(self, c: np.ndarray) -> Stats:
        k, d = len(c), self.dim

        def flat(_: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
            s = statistics(x, w, c)
            return np.concatenate([s.n.astype(object), s.error.astype(object), s.loss.astype(object), s.sums.astype(object).ravel()])

        out = self.fold(flat, k * (3 + d))
        return Stats(out[:k].astype(np.int64), out[3 * k :].reshape(k, d), out[k : 2 * k], out[2 * k : 3 * k])

    def labelled(self, seed: str, k: int) -> Stats:
        """Weights and sums of k parts that points are dealt to by a hash."""

        def flat(ids: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
            of = np.array([hash_number(seed, i) % k for i in ids.tolist()], np.int64)
            return np.concatenate([added(of, w, k).astype(object), added(of, exactly(x, w), k).astype(object).ravel()])

        out = self.fold(flat, k * (1 + self.dim))
        return Stats(out[:k].astype(np.int64), out[k:].reshape(k, self.dim), np.zeros(k, object), np.zeros(k, object))

    def top(self) -> int:
        """The largest absolute element."""
        return int(self.fold(lambda _, x, __: np.array([int(np.abs(x).max(initial=0))], object), 1, "max")[0])

    def axes(self, c: np.ndarray, which: list[int], kind: str) -> dict[int, np.ndarray]:
        """For some clusters an axis of integers: pca (the largest spread), regression (of all dimensions on the one that
        spreads most) or furthest (from the member furthest from the centroid to that furthest from it)."""
        if kind == "furthest":
            one = self.furthest(c, c)
            two = self.furthest(c, np.array([one.get(j, c[j]) for j in range(len(c))], np.int64))
            return {j: two[j] - one[j] for j in which if j in one}
        d, shift = self.dim, max(0, self.top().bit_length() - 16)
        at = {j: i for i, j in enumerate(which)}

        def flat(_: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
            of, y = nearest(x, c)[0], x >> shift
            out = np.zeros((len(which), 1 + d + d * d), object)
            for j, i in at.items():
                own, v = y[of == j], w[of == j]
                if len(own):
                    out[i, 0] = int(v.sum())
                    out[i, 1 : d + 1] = exactly(own, v).sum(0)
                    out[i, d + 1 :] = [int(s) for a in range(d) for s in exactly(own * own[:, a : a + 1], v).sum(0)]
            return out.ravel()

        sums, out = self.fold(flat, len(which) * (1 + d + d * d)).reshape(len(which), -1), {}
        for j, i in at.items():
            n = int(sums[i, 0])
            if n:
                s = [int(a) for a in sums[i, 1 : d + 1]]
                cov = np.array([[(n * int(sums[i, d + 1 + a * d + b]) - s[a] * s[b]) / n / n for b in range(d)] for a in range(d)])
                if kind == "regression":
                    a = int(np.diag(cov).argmax())
                    line = cov[a] / cov[a, a] if cov[a, a] else np.eye(d)[0]
                else:
                    line = np.linalg.eigh(cov)[1][:, -1]
                line = line * (1 if line[np.abs(line).argmax()] > 0 else -1)
                out[j] = np.floor(line / np.abs(line).max() * 1000 + 0.5).astype(np.int64)
        return out

    def histograms(self, c: np.ndarray, axes: dict[int, np.ndarray], bins: int = 256) -> dict[int, tuple[int, int, np.ndarray, np.ndarray]]:
        """For some clusters, along their axes: the least and largest projection, and by bin of equal width the weights and
        the weighted sums of vectors. Bins are found in integers."""
        at, d = {j: i for i, j in enumerate(axes)}, self.dim

        def edges(sign: int) -> Fold:
            def flat(_: np.ndarray, x: np.ndarray, __: np.ndarray) -> np.ndarray:
                of, out = nearest(x, c)[0], np.full(len(at), None, object)
                for j, i in at.items():
                    t = x[of == j] @ axes[j]
                    out[i] = int((sign * t).max()) if len(t) else None
                return out

            return flat

        high, low = self.fold(edges(1), len(at), "max"), self.fold(edges(-1), len(at), "max")

        def flat(_: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
            of, out = nearest(x, c)[0], np.zeros((len(at), bins, 1 + d), object)
            for j, i in at.items():
                if high[i] is not None:
                    own, v = x[of == j], w[of == j]
                    b = (own @ axes[j] + int(low[i])) * bins // (int(high[i]) + int(low[i]) + 1)
                    out[i, :, 0] = added(b, v, bins)
                    out[i, :, 1:] = added(b, exactly(own, v), bins)
            return out.ravel()

        cells = self.fold(flat, len(at) * bins * (1 + d)).reshape(len(at), bins, 1 + d)
        return {j: (-int(low[i]), int(high[i]), cells[i, :, 0].astype(np.int64), cells[i, :, 1:]) for j, i in at.items() if high[i] is not None}


class Local(Engine):
    """Points in memory: codebooks, samples and other sets of bounded size."""

    def __init__(self, x: np.ndarray, w: np.ndarray | None = None, ids: np.ndarray | None = None) -> None:
        self.x = np.ascontiguousarray(x, np.int64)
        self.w = np.ones(len(x), np.int64) if w is None else np.asarray(w, np.int64)
        self.ids = np.arange(len(x)) if ids is None else ids
        self.blocks: list | None = None

    def forget(self) -> None:
        """Drops what `together` keeps."""
        self.blocks = None

    @property
    def size(self) -> int:
        return len(self.x)

    @property
    def weight(self) -> int:
        return int(self.w.sum())

    @property
    def dim(self) -> int:
        return self.x.shape[1]

    def fold(self, f: Fold, size: int, how: str = "sum") -> np.ndarray:
        return f(self.ids, self.x, self.w) if len(self.x) else np.zeros(size, object) if how == "sum" else np.full(size, None, object)

    def together(self, products: Products, job: tuple) -> np.ndarray:
        if self.blocks is None:
            self.blocks = [products.block(self.x[i : i + 4096], self.w[i : i + 4096]) for i in range(0, len(self.x), 4096)]
        return sum(products.run(job, b) for b in self.blocks)

    def sample(self, m: int, seed: str) -> np.ndarray:
        order = sorted(range(len(self.x)), key=lambda i: (hashlib.md5(f"{seed}|{self.ids[i]}".encode()).hexdigest(), self.ids[i]))
        return self.x[order[:m]]

    def worst(self, c: np.ndarray, m: int) -> np.ndarray:
        mass = exactly(nearest(self.x, c)[1], self.w).tolist()
        return self.x[sorted(range(len(mass)), key=lambda i: (-mass[i], self.ids[i]))[:m]]

    def furthest(self, c: np.ndarray, to: np.ndarray) -> dict[int, np.ndarray]:
        """For each cluster with points the member furthest from to[cluster], ties to the smaller id."""
        of = nearest(self.x, c)[0]
        d = ((self.x - to[of]) ** 2).sum(1)
        out: dict[int, np.ndarray] = {}
        for i in np.lexsort((self.ids, -d)).tolist():
            out.setdefault(int(of[i]), self.x[i])
        return out

    def pick(self, part: float, c: np.ndarray | None = None) -> np.ndarray:
        """The point, in order of ids, at which the weights (times the distances to codebook c) first sum to more than
        `part` of their total; the last point if all are 0."""
        mass, order = self.w if c is None else exactly(nearest(self.x, c)[1], self.w), np.argsort(self.ids, kind="stable")
        target, run = int(sum(mass.tolist())) * int(part * EXACT) // EXACT, 0
        for i in order.tolist():
            run += int(mass[i])
            if run > target:
                return self.x[i]
        return self.x[order[-1]]

    def ranked(self, by: str, at: object, ranks: list[int]) -> np.ndarray:
        """The points of these ranks, ascending, in the order by the dot product with a vector (dot), by the distance to
        it (d2) or by a hash with a seed (hash); ties by id."""
        x = self.x @ at if by == "dot" else distances(self.x, np.asarray(at)[None])[:, 0] if by == "d2" else np.array([hash_number(at, i) for i in self.ids.tolist()], np.int64)
        return self.x[np.lexsort((self.ids, x))[ranks]]

    def within(self, c: np.ndarray, k: int) -> Local:
        """The points of one cluster."""
        own = np.flatnonzero(nearest(self.x, c)[0] == k)
        return Local(self.x[own], self.w[own], self.ids[own])

    def unweighted(self) -> Local:
        return Local(self.x, None, self.ids)


class Spark(Engine):
    """Points in a DataFrame (id, v, freq). Every call is a pass or two; cache the DataFrame for many."""

    def __init__(self, points: DataFrame) -> None:
        self.points = points.select("id", "v", "freq")
        about = self.points.agg(F.count("*").alias("n"), F.sum("freq").alias("w"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("e"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        if about["n"] and about["d"] != about["e"]:
            raise ValueError("the vectors differ in length")
        self.size, self.weight, self.dim = about["n"], int(about["w"] or 0), about["d"] or 0
        self.low, self.width = about["low"] or 0, ((about["high"] or 0) - (about["low"] or 0)) // RANGES + 1
        self.blocks: DataFrame | None = None

    def together(self, products: Products, job: tuple) -> np.ndarray:
        """The points are kept by the executors as blocks of packed integers; a task sends one sum, whatever it has read."""
        spark, dim = self.points.sparkSession, self.dim
        if self.blocks is None:

            def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x, w = b.column("v").flatten().to_numpy().reshape(-1, dim), b.column("freq").to_numpy()
                    for i in range(0, len(x), 1024):
                        kind = np.result_type(np.min_scalar_type(x[i : i + 1024].min(initial=0)), np.min_scalar_type(x[i : i + 1024].max(initial=0)))
                        yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps((x[i : i + 1024].astype(kind), w[i : i + 1024]))], pa.binary())})

            tasks = 2 * spark.sparkContext.defaultParallelism
            self.blocks = self.points.mapInArrow(packed, "block binary").repartition(tasks).persist()
        given = spark.sparkContext.broadcast((products, job))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for row in b.column("block"):
                    one = products.run(given.value[1], products.block(*pickle.loads(row.as_py())))
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

        found = self.blocks.mapInArrow(own, "sums binary").collect()  # a row a task, and as many tasks as twice the cores
        given.destroy()
        return sum(pickle.loads(r["sums"]) for r in found)

    def forget(self) -> None:
        """Drops what `together` keeps."""
        if self.blocks is not None:
            self.blocks.unpersist()
            self.blocks = None

    def fold(self, f: Fold, size: int, how: str = "sum") -> np.ndarray:
        """Tasks send the cells that they have; of each the driver gets one."""
        dim = self.dim
        better = {"sum": lambda a, b: a + b, "max": lambda a, b: max(a, b), "min": lambda a, b: min(a, b)}[how]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list | None = None
            for b in batches:
                if b.num_rows:
                    own = f(b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(-1, dim), b.column("freq").to_numpy()).tolist()
                    total = own if total is None else [y if x is None else x if y is None else better(x, y) for x, y in zip(total, own, strict=True)]
            if total is not None:
                at = [i for i, x in enumerate(total) if x is not None and (x or how != "sum")]
                yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "x": pa.array([int(total[i]) for i in at], pa.decimal128(38, 0))})

        cells = self.points.mapInArrow(partial, f"i int, x {BIG}").groupBy("i").agg({"sum": F.sum, "max": F.max, "min": F.min}[how]("x").cast(BIG).alias("x"))
        out = np.zeros(size, object) if how == "sum" else np.full(size, None, object)
        for r in cells.collect():  # `size` rows at most
            out[r["i"]] = int(r["x"])
        return out

    def sample(self, m: int, seed: str) -> np.ndarray:
        rows = self.points.orderBy(by_hash(self.points, seed), "id").limit(m).collect()  # m rows
        return np.array([r["v"] for r in rows], np.int64).reshape(-1, self.dim)

    def assigned(self, c: np.ndarray) -> DataFrame:
        """id, v, freq, cid, d2 by a pass over Arrow batches."""
        shared, dim = self.points.sparkSession.sparkContext.broadcast(c), self.dim

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of, d2, _ = nearest(b.column("v").flatten().to_numpy().reshape(-1, dim), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32)), pa.array(d2)], names=[*b.schema.names, "cid", "d2"])

        return self.points.mapInArrow(own, "id long, v array<long>, freq long, cid int, d2 long")

    def worst(self, c: np.ndarray, m: int) -> np.ndarray:
        rows = self.assigned(c).orderBy(F.desc(F.col("d2").cast(BIG) * F.col("freq")), "id").limit(m).collect()  # m rows
        return np.array([r["v"] for r in rows], np.int64).reshape(-1, self.dim)

    def furthest(self, c: np.ndarray, to: np.ndarray) -> dict[int, np.ndarray]:
        from_ = F.element_at(F.array(*(F.array(*(F.lit(int(x)).cast("bigint") for x in v)) for v in to)), F.col("cid") + 1)
        most = F.max(F.struct(V.squared(F.col("v"), from_).alias("d"), (-F.col("id")).alias("id"), "v")).alias("m")
        return {r["cid"]: np.array(r["m"]["v"], np.int64) for r in self.assigned(c).groupBy("cid").agg(most).collect()}  # a row a cluster

    def pick(self, part: float, c: np.ndarray | None = None) -> np.ndarray:
        rows = self.points.withColumn("mass", F.col("freq").cast(BIG)) if c is None else self.assigned(c).withColumn("mass", (F.col("d2").cast(BIG) * F.col("freq")).cast(BIG))
        rows = rows.withColumn("part", F.floor((F.col("id") - F.lit(self.low)) / F.lit(self.width)))
        sums = sorted((r["part"], int(r["s"])) for r in rows.groupBy("part").agg(F.sum("mass").cast(BIG).alias("s")).collect())  # RANGES rows
        target, run = sum(s for _, s in sums) * int(part * EXACT) // EXACT, 0
        for own, s in sums:
            if run + s > target:
                break
            run += s
        else:
            return np.array(self.points.orderBy(F.desc("id")).first()["v"], np.int64)
        in_order = rows.where(F.col("part") == own).withColumn("run", F.sum("mass").over(Window.partitionBy("part").orderBy("id")))
        return np.array(in_order.where(F.col("run") > F.lit(target - run).cast(BIG)).orderBy("id").first()["v"], np.int64)

    def ranked(self, by: str, at: object, ranks: list[int]) -> np.ndarray:
        vector = lambda: F.array(*(F.lit(int(x)).cast("bigint") for x in at))
        x = V.dot(F.col("v"), vector()) if by == "dot" else V.squared(F.col("v"), vector()) if by == "d2" else F.conv(F.substring(by_hash(self.points, str(at)), 1, 13), 16, 10).cast("bigint")
        rows = at_ranks(self.points.select("id", "v", x.alias("x")), ranks).orderBy("rank").collect()  # as many rows as ranks
        by_rank = {r["rank"]: r["v"] for r in rows}
        return np.array([by_rank[r] for r in ranks], np.int64).reshape(-1, self.dim)

    def within(self, c: np.ndarray, k: int) -> Spark:
        return Spark(self.assigned(c).where(F.col("cid") == k))

    def unweighted(self) -> Spark:
        return Spark(self.points.withColumn("freq", F.lit(1).cast("bigint")))


Points = Local | Spark
#: Elements (points times dimensions) that `of` holds in memory.
IN_MEMORY = 4_000_000


def of(points: DataFrame, elements: int = IN_MEMORY) -> Points:
    """The engine for a set: in memory up to so many elements, where a pass costs less than starting a job."""
    engine = Spark(points)
    if engine.size * engine.dim > elements:
        return engine
    rows = engine.points.orderBy("id").toArrow()  # of the size just checked
    x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, engine.dim) if engine.size else np.zeros((0, 1), np.int64)
    return Local(x, rows.column("freq").to_numpy(), rows.column("id").to_numpy())
