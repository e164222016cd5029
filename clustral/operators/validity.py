"""Cluster validity: internal indices from one pass per pair of inputs, external ones from the contingency table.

Published definitions throughout. points: id, v, freq. assigned: also cid, d2. codebook: cid, c, freq.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.engine import distances
from .relational import _with_codebook, assign, distance_matrix, global_centroid


def _spread(assigned: DataFrame) -> DataFrame:
    """cid, n, sse, mean distance to the centroid."""
    w = F.col("freq")
    return assigned.groupBy("cid").agg(F.sum(w).cast("double").alias("n"), F.sum(F.col("d2") * w).cast("double").alias("sse"), (F.sum(F.sqrt(F.col("d2").cast("double")) * w) / F.sum(w)).alias("mean"))


def ssb(codebook: DataFrame) -> DataFrame:
    """Sum of squared distances of all pairs of centroids."""
    return distance_matrix(codebook).agg(F.sum("d2").cast("double").alias("ssb"))


def davies_bouldin(assigned: DataFrame, codebook: DataFrame, compat: bool = False) -> DataFrame:
    """Mean over clusters with points of the largest (mean_i + mean_j) / distance of centroids. compat: of each cluster only
    those after it are looked at, and the mean is over all clusters with points."""
    s = _spread(assigned).select("cid", "mean")
    d = distance_matrix(codebook)
    both = d if compat else d.union(d.select("b", "a", "d2"))
    one, two = s.select(F.col("cid").alias("a"), F.col("mean").alias("ma")), s.select(F.col("cid").alias("b"), F.col("mean").alias("mb"))
    ratio = (F.col("ma") + F.col("mb")) / F.sqrt(F.col("d2").cast("double"))
    worst = both.join(one, "a").join(two, "b").where("d2 > 0").groupBy("a").agg(F.max(ratio).alias("r"))
    if compat:
        worst = s.join(worst, F.col("cid") == F.col("a"), "left").select(F.coalesce("r", F.lit(0.0)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def xie_beni(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """Mean squared error over the least squared distance of centroids."""
    least = distance_matrix(codebook).agg(F.min("d2").cast("double").alias("least"))
    own = assigned.agg((F.sum(F.col("d2") * F.col("freq")) / F.sum("freq")).cast("double").alias("mse"))
    return own.crossJoin(F.broadcast(least)).select((F.col("mse") / F.col("least")).alias("xie_beni"))  # a row each


def f_ratio(assigned: DataFrame, codebook: DataFrame, centre: Column | None = None) -> DataFrame:
    """K times the error within clusters over that of the centroids around `centre`, by default the mean of all points."""
    if centre is None:
        mean = F.broadcast(global_centroid(assigned.select("v", "freq")).select(F.col("c").alias("all_mean")))  # one row
        codebook, centre = codebook.crossJoin(mean), F.col("all_mean")
    within = _spread(assigned)
    joined = within.join(codebook, "cid")
    between = F.sum(F.col("n") * V.squared(F.col("c"), centre))
    return joined.agg((F.count("*") * F.sum("sse") / between).alias("f_ratio"))


def f_test(assigned: DataFrame, codebook: DataFrame, compat: bool = False) -> DataFrame:
    """Variance between the centroids, by weight, over that within clusters, each by its degrees of freedom: larger is
    better. compat: a thousand times the inverse, the variance between divided by the dimension too."""
    mean = F.broadcast(global_centroid(assigned.select("v", "freq")).select(F.col("c").alias("all_mean")))  # one row
    within = _spread(assigned)
    rows = within.join(codebook.select("cid", "c").crossJoin(mean), "cid")
    sums = rows.agg(F.sum(F.col("n") * V.squared(F.col("c"), F.col("all_mean"))).alias("between"), F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.max(F.size("c")).alias("dim"))
    k = codebook.agg(F.count("*").cast("double").alias("k"))
    one = sums.crossJoin(F.broadcast(k))  # a row each
    inside, between = F.col("sse") / (F.col("n") - F.col("k")), F.col("between") / (F.col("k") - 1)
    return one.select((1000 * inside / (between / F.col("dim")) if compat else between / inside).alias("f_test"))


def silhouette_ci(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """By cluster the distance to the nearest other centroid over the mean distance of its points to its own, weighted by the
    clusters' shares of the points."""
    near = distance_matrix(codebook).where("d2 > 0")
    near = near.select("a", "d2").union(near.select("b", "d2")).groupBy(F.col("a").alias("cid")).agg(F.sqrt(F.min("d2").cast("double")).alias("near"))
    rows = _spread(assigned).join(near, "cid").where("mean > 0")
    return rows.agg((F.sum(F.col("near") / F.col("mean") * F.col("n")) / F.sum("n")).alias("silhouette_ci"))


def explained(assigned: DataFrame) -> DataFrame:
    """rmsstd (root of the variance within clusters by dimension) and r2 (the share of the variance that clusters explain),
    around the clusters' exact means."""
    dims = variances_with_weight(assigned, ["cid"])
    whole = variances_with_weight(assigned, []).agg(F.sum(F.col("var") * F.col("n")).alias("total"))
    size = assigned.agg(F.countDistinct("cid").cast("double").alias("k"), F.sum("freq").cast("double").alias("n"), F.max(F.size("v")).alias("dim"))
    one = dims.agg(F.sum(F.col("var") * F.col("n")).alias("inside")).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(size))  # a row each
    return one.select(F.sqrt(F.col("inside") / (F.col("dim") * (F.col("n") - F.col("k")))).alias("rmsstd"), (1 - F.col("inside") / F.col("total")).alias("r2"))


def bic(assigned: DataFrame, dim: int) -> DataFrame:
    """Bayesian information criterion of spherical clusters of one variance; larger is better."""
    w = _spread(assigned)
    all_ = w.agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    n, k = F.col("n"), F.col("k")
    variance = F.col("sse") / (dim * (n - k))
    like = F.col("nlogn") - n * F.log(n) - n * dim / 2 * F.log(2 * F.pi() * variance) - dim * (n - k) / 2
    return all_.select((like - k * (dim + 1) / 2 * F.log(n)).alias("bic"))


def block_sums(points: DataFrame, f, schema: str, block: int = 4096) -> DataFrame:
    """f(a, b) on every pair of blocks of the points (id, v, freq, cid), each block with itself too: it gets Arrow tables, the
    second's columns named with a 2, and gives sums, never pairs. All pairs are looked at, as these indices are defined; use samples or distinct points."""
    n = max(1, -(-points.count() // block))
    rows = points.select("id", "v", "freq", "cid", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    left = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = rows.select(*(F.col(c).alias(f"{c}2") for c in ("id", "v", "freq", "cid")), F.col("b").alias("o2")).withColumn("b2", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.groupBy("b", "o").cogroup(right.groupBy("b2", "o2")).applyInArrow(f, schema)


def _columns(t: pa.Table, end: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return t.column(f"id{end}").to_numpy(), np.array(t.column(f"v{end}").to_pylist(), np.int64), t.column(f"freq{end}").to_numpy(), t.column(f"cid{end}").to_numpy()


def dunn(points_by_cluster: DataFrame, block: int = 4096) -> DataFrame:
    """Least squared distance between clusters over the largest within one, exactly, over all pairs in blocks."""

    def extremes(a: pa.Table, b: pa.Table) -> pa.Table:
        low = high = None
        if a.num_rows and b.num_rows:
            (i, x, _, p), (j, y, _, q) = _columns(a), _columns(b, "2")
            for s in range(0, len(i), 512):
                d = distances(x[s : s + 512], y).astype(float)
                same, other = p[s : s + 512, None] == q[None], i[s : s + 512, None] != j[None]
                out, in_ = d[~same], d[same & other]
                low = min(x_ for x_ in (low, out.min() if len(out) else None) if x_ is not None) if low is not None or len(out) else None
                high = max(x_ for x_ in (high, in_.max() if len(in_) else None) if x_ is not None) if high is not None or len(in_) else None
        return pa.table({"low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    return block_sums(points_by_cluster, extremes, "low double, high double", block).agg((F.min("low") / F.max("high")).alias("dunn"))


def silhouette(points_by_cluster: DataFrame, block: int = 4096, compat: bool = False) -> DataFrame:
    """Mean silhouette by exact distances to all points; a point's copies count as others. compat: the mean distance within
    the own cluster is over all its points, the point itself too."""

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "cid": [], "freq": [], "cid_b": [], "sum": [], "n": []}
        if a.num_rows and b.num_rows:
            (i, x, w, p), (j, y, v, q) = _columns(a), _columns(b, "2")
            kinds, of = np.unique(q, return_inverse=True)
            to = np.zeros((len(q), len(kinds)))
            to[np.arange(len(q)), of] = v
            for s in range(0, len(i), 512):
                d = np.sqrt(distances(x[s : s + 512], y).astype(float))
                met = np.ones(d.shape)
                met[i[s : s + 512, None] == j[None]] = 0
                total, n = (d * met) @ to, met @ to
                for name, value in zip(out, (np.repeat(i[s : s + 512], len(kinds)), np.repeat(p[s : s + 512], len(kinds)), np.repeat(w[s : s + 512], len(kinds)), np.tile(kinds, len(d)), total.ravel(), n.ravel()), strict=True):
                    out[name].append(value)
        kind = {"id": np.int64, "cid": np.int32, "freq": np.int64, "cid_b": np.int32, "sum": float, "n": float}
        return pa.table({k: np.concatenate([np.zeros(0, kind[k]), *v]).astype(kind[k]) for k, v in out.items()})

    d = block_sums(points_by_cluster, sums, "id long, cid int, freq long, cid_b int, sum double, n double", block).where("n > 0").groupBy("id", "cid", "freq", "cid_b").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("cid") == F.col("cid_b"), F.col("sum") / F.greatest(F.col("n") + F.col("freq") - (0 if compat else 1), F.lit(1))))
    other = F.min(F.when(F.col("cid") != F.col("cid_b"), F.col("sum") / F.col("n")))
    each = d.groupBy("id", "cid", "freq").agg(own.alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg((F.sum(s * F.col("freq")) / F.sum("freq")).alias("silhouette"))


def simplified_silhouette(two: DataFrame) -> DataFrame:
    """Another index than silhouette_ci: the mean of (b - a) / b with the distances to the two nearest centroids; two: relational.two_nearest."""
    a, b = F.sqrt(F.col("d2").cast("double")), F.sqrt(F.col("d2_2").cast("double"))
    return two.agg((F.sum(F.when(b > 0, (b - a) / b).otherwise(0.0) * F.col("freq")) / F.sum("freq")).alias("simplified_silhouette"))


def variances(points: DataFrame, by: list[str]) -> DataFrame:
    """The variance of each dimension (populations of weighted points), as rows (by, dim, var)."""
    rows = points.select(*by, "freq", F.posexplode("v").alias("dim", "x"))
    n, s, q = F.sum("freq"), F.sum(F.col("x") * F.col("freq")).cast("double"), F.sum((F.col("x") * F.col("x") * F.col("freq")).cast("decimal(38,0)")).cast("double")
    return rows.groupBy(*by, "dim").agg((q / n - (s / n) * (s / n)).alias("var"))


def variances_with_weight(points: DataFrame, by: list[str]) -> DataFrame:
    """variances with the weight n of each row."""
    weights = points.groupBy(*by).agg(F.sum("freq").cast("double").alias("n"))
    rows = variances(points, by)
    return rows.join(weights, by) if by else rows.crossJoin(F.broadcast(weights))  # one row without `by`


def scatter(assigned: DataFrame) -> DataFrame:
    """Mean length of the clusters' variance vectors over that of all points."""
    inside = variances(assigned, ["cid"]).groupBy("cid").agg(F.sqrt(F.sum(F.col("var") * F.col("var"))).alias("len")).agg(F.avg("len").alias("inside"))
    whole = variances(assigned, []).agg(F.sqrt(F.sum(F.col("var") * F.col("var"))).alias("whole"))
    return inside.crossJoin(F.broadcast(whole)).select((F.col("inside") / F.col("whole")).alias("scatter"))  # a row each


def s_dbw(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """Scatter plus the mean density at the midpoints of pairs of centroids, relative to the denser end."""
    deviation = variances(assigned, ["cid"]).groupBy("cid").agg(F.sqrt(F.sum(F.col("var") * F.col("var"))).alias("len")).agg((F.sqrt(F.sum("len")) / F.count("*")).alias("sd"))
    sd = deviation.first()["sd"] or 0.0  # one row
    near = lambda c: F.sum(F.when(F.sqrt(V.squared(F.col("v"), c).cast("double")) <= sd, F.col("freq")).otherwise(0))
    # a point meets the pairs of its own cluster: only the codebook, whose size is checked, is broadcast
    mine, other = F.filter("cb", lambda k: k["cid"] == F.col("cid")), F.filter("cb", lambda k: k["cid"] != F.col("cid"))
    each = _with_codebook(assigned.select("cid", "v", "freq"), codebook).select("cid", "v", "freq", F.get(mine, F.lit(0))["c"].alias("own"), F.explode(other).alias("k")).where("own is not null")
    first = F.col("cid") < F.col("k.cid")
    ends = each.select("v", "freq", "own", "k", F.least("cid", "k.cid").alias("a"), F.greatest("cid", "k.cid").alias("b"), F.when(first, F.col("own")).otherwise(F.col("k.c")).alias("ca"), F.when(first, F.col("k.c")).otherwise(F.col("own")).alias("cb"))
    met = ends.withColumn("mid", V.midpoint(F.col("ca"), F.col("cb"))).groupBy("a", "b").agg(near(F.col("mid")).alias("m"), near(F.col("ca")).alias("na"), near(F.col("cb")).alias("nb"))
    density = met.agg(F.avg(F.when(F.greatest("na", "nb") > 0, F.col("m") / F.greatest("na", "nb")).otherwise(0.0)).alias("density"))
    return scatter(assigned).crossJoin(F.broadcast(density)).select((F.col("scatter") + F.coalesce("density", F.lit(0.0))).alias("s_dbw"))  # a row each


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n for the pairs of labels that occur."""
    return labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def external(labels: DataFrame, a: str, b: str, compat: bool = False) -> DataFrame:
    """rand, adjusted_rand, variation (of information, in nats) and nmi of two labellings of the same rows. compat: the
    variation stands in nmi's place too."""
    table = contingency(labels, a, b)
    pairs = lambda c: (F.sum(c * (c - 1) / 2)).cast("double")
    entropy = lambda c: F.sum(c * F.log(c.cast("double")))
    n = F.col("n")
    cells = table.agg(pairs(n).alias("both"), F.sum("n").cast("double").alias("n"), entropy(n).alias("hab"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(n).alias("pa"), entropy(n).alias("ha"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(n).alias("pb"), entropy(n).alias("hb"))
    one = cells.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # a row each
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("pa") * F.col("pb") / total
    h = lambda c: F.log(F.col("n")) - F.col(c) / F.col("n")
    shared = h("ha") + h("hb") - h("hab")
    return one.select(
        ((total + 2 * F.col("both") - F.col("pa") - F.col("pb")) / total).alias("rand"),
        ((F.col("both") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).alias("adjusted_rand"),
        (2 * h("hab") - h("ha") - h("hb")).alias("variation"),
        (2 * h("hab") - h("ha") - h("hb") if compat else 2 * shared / (h("ha") + h("hb"))).alias("nmi"),
    )


def orphans(one: DataFrame, other: DataFrame) -> DataFrame:
    """How many centroids of `other` are nearest to none of `one`."""
    near = assign(one.select(F.col("cid").cast("bigint").alias("id"), F.col("c").alias("v"), "freq"), other)
    return other.select("cid").join(near.select("cid").distinct(), "cid", "left_anti").agg(F.count("*").alias("orphans"))


def centroid_index(one: DataFrame, other: DataFrame) -> DataFrame:
    """The larger number of orphans of both ways."""
    return orphans(one, other).union(orphans(other, one)).agg(F.max("orphans").alias("centroid_index"))
