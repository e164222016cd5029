"""Assignment, aggregation, selection and set operators on points and codebooks.

points: id BIGINT, v ARRAY<BIGINT>, freq BIGINT. codebook: cid INT, c ARRAY<BIGINT>, freq BIGINT, numbered from 0 without
gaps, small: it travels as one broadcast row. assignment: id, v, freq, cid, d2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Rows of a codebook that a broadcast may hold.
LARGEST = 65_536
BIG = "decimal(38,0)"
Metric = Callable[[Column, Column], Column]


def _with_codebook(points: DataFrame, codebook: DataFrame) -> DataFrame:
    row = codebook.limit(LARGEST + 1).agg(F.array_sort(F.collect_list(F.struct("cid", "c", "freq"))).alias("cb"))
    row = row.select(F.when(F.size("cb") > LARGEST, F.raise_error(F.lit("the codebook is too large to broadcast"))).otherwise(F.col("cb")).alias("cb"))
    return points.crossJoin(F.broadcast(row))  # one row of a checked size


def assign(points: DataFrame, codebook: DataFrame, metric: Metric = V.squared, incumbent: str | None = None) -> DataFrame:
    """Each point's nearest centroid (cid, d2). The lowest cid wins a tie, or the cluster in column `incumbent`."""
    kept = (lambda k: (k["cid"] != F.col(incumbent)).cast("int")) if incumbent else (lambda k: F.lit(0))
    best = F.array_min(F.transform("cb", lambda k: F.struct(metric(F.col("v"), k["c"]).alias("d2"), kept(k).alias("other"), k["cid"].alias("cid"))))
    rest = [c for c in points.columns if c not in ("cid", "d2")]
    return _with_codebook(points, codebook).select(*rest, best.alias("best")).select(*rest, F.col("best.cid").alias("cid"), F.col("best.d2").alias("d2"))


def two_nearest(points: DataFrame, codebook: DataFrame, metric: Metric = V.squared) -> DataFrame:
    """The nearest and second nearest centroids: cid, d2, cid2, d2_2 (null for a codebook of one)."""
    order = F.array_sort(F.transform("cb", lambda k: F.struct(metric(F.col("v"), k["c"]).alias("d2"), k["cid"].alias("cid"))))
    two = _with_codebook(points, codebook).select("id", "v", "freq", F.slice(order, 1, 2).alias("two"))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return two.select("id", "v", "freq", first["cid"].alias("cid"), first["d2"].alias("d2"), second["cid"].alias("cid2"), second["d2"].alias("d2_2"))


def nearest_by_merge_cost(assigned: DataFrame, codebook: DataFrame, barred: int | None = None) -> DataFrame:
    """For each point the other cluster, not `barred` either, that takes it in most cheaply: cid2 and cost."""
    allowed = lambda k: (k["cid"] != F.col("cid")) & (k["cid"] != F.lit(-1 if barred is None else barred))
    cost = F.transform(F.filter("cb", allowed), lambda k: F.struct(V.merge_cost(F.col("freq"), k["freq"], V.squared(F.col("v"), k["c"])).alias("cost"), k["cid"].alias("cid2")))
    return _with_codebook(assigned, codebook).withColumn("best", F.array_min(cost)).select(*assigned.columns, "best.cid2", "best.cost")


def reassign_cluster(assigned: DataFrame, codebook: DataFrame, cid: int) -> DataFrame:
    """Gives the points of one cluster away to their nearest centroids; the others stay as they are."""
    moved = assign(assigned.where(F.col("cid") == cid), codebook, incumbent="cid")
    return moved.unionByName(assigned.where(F.col("cid") != cid).select(*moved.columns))


def attract(assigned: DataFrame, codebook: DataFrame, fresh: list[int]) -> DataFrame:
    """Moves points to the centroids in `fresh` that are strictly nearer than their own."""
    near = F.array_min(F.transform(F.filter("cb", lambda k: k["cid"].isin(fresh)), lambda k: F.struct(V.squared(F.col("v"), k["c"]).alias("d2"), k["cid"].alias("cid"))))
    rest = [c for c in assigned.columns if c not in ("cid", "d2")]
    joined = _with_codebook(assigned, codebook).withColumn("near", near)
    nearer = F.col("near.d2") < F.col("d2")
    return joined.select(*rest, F.when(nearer, F.col("near.cid")).otherwise(F.col("cid")).alias("cid"), F.when(nearer, F.col("near.d2")).otherwise(F.col("d2")).alias("d2"))


def local_repartition(assigned: DataFrame, codebook: DataFrame, cid: int) -> DataFrame:
    """After centroid `cid` was replaced: its points go to their nearest, and it attracts those that are nearer to it. As a
    full search assigns them, if `assigned` was the nearest before; only the ties may differ, which the own cluster wins."""
    rejected = assign(assigned.where(F.col("cid") == cid), codebook)
    others = attract(assigned.where(F.col("cid") != cid), codebook, [cid])
    return rejected.unionByName(others.select(*rejected.columns))


def with_centroid(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """assigned with its cluster's centroid c."""
    return assigned.join(codebook.select("cid", "c"), "cid")


def counters(assigned: DataFrame) -> DataFrame:
    """cid, uniques, n (weight) and s (weighted sums by dimension) of each cluster that has points."""
    dims = assigned.select("cid", "freq", F.posexplode("v").alias("dim", "x"))
    sums = dims.groupBy("cid", "dim").agg(F.sum((F.col("x") * F.col("freq")).cast(BIG)).cast(BIG).alias("s"), F.sum("freq").alias("n"), F.count("*").alias("uniques"))
    return sums.groupBy("cid").agg(F.max("uniques").alias("uniques"), F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"))


def counter_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What adding and taking away the points that moved changes of the counters: cid, n, s, signed; from two assignments of
    the same points."""
    moved = before.select("id", "v", "freq", F.col("cid").alias("old")).join(after.select("id", F.col("cid").alias("new")), "id").where("old <> new")
    signed = moved.select(F.col("old").alias("cid"), "v", (-F.col("freq")).alias("freq")).union(moved.select(F.col("new").alias("cid"), "v", "freq"))
    dims = signed.select("cid", "freq", F.posexplode("v").alias("dim", "x")).groupBy("cid", "dim").agg(F.sum((F.col("x") * F.col("freq")).cast(BIG)).cast(BIG).alias("s"), F.sum("freq").alias("n"))
    return dims.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"))


def with_changes(counted: DataFrame, changes: DataFrame) -> DataFrame:
    """counters (cid, n, s) with changes added; clusters without points left out."""
    both = counted.select("cid", "n", "s").union(changes.select("cid", "n", "s"))
    dims = both.select("cid", "n", F.posexplode("s").alias("dim", "x")).groupBy("cid", "dim").agg(F.sum("n").alias("n"), F.sum("x").cast(BIG).alias("s"))
    out = dims.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"))
    return out.where("n > 0")


def centroids(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """The clusters' weighted means, halves up; an empty cluster keeps its vector, with freq 0."""
    mean = F.transform("s", lambda x: F.floor((2 * x + F.col("n")) / (2 * F.col("n"))).cast("bigint"))
    found = counters(assigned).select("cid", F.col("n"), mean.alias("mean"))
    return codebook.select("cid", F.col("c").alias("old")).join(found, "cid", "left").select("cid", F.coalesce("mean", "old").alias("c"), F.coalesce("n", F.lit(0)).cast("bigint").alias("freq"))


def global_centroid(points: DataFrame) -> DataFrame:
    """One row: the weighted mean of all points, halves up."""
    one = points.withColumn("cid", F.lit(0))
    return counters(one).select(F.transform("s", lambda x: F.floor((2 * x + F.col("n")) / (2 * F.col("n"))).cast("bigint")).alias("c"), F.col("n").alias("freq"))


def cluster_errors(assigned: DataFrame) -> DataFrame:
    """cid, n, error (weighted squared) of each cluster."""
    return assigned.groupBy("cid").agg(F.sum("freq").alias("n"), F.sum((F.col("d2") * F.col("freq")).cast(BIG)).cast(BIG).alias("error"))


def total_error(assigned: DataFrame) -> DataFrame:
    """sse, n and mse (by weight and dimension); weights count."""
    out = assigned.agg(F.sum((F.col("d2") * F.col("freq")).cast(BIG)).cast(BIG).alias("sse"), F.sum("freq").alias("n"), F.max(F.size("v")).alias("dim"))
    return out.select("sse", "n", (F.col("sse").cast("double") / (F.col("n") * F.col("dim"))).alias("mse"))


def mean_error(assigned: DataFrame, codebook: DataFrame, error: str = "mse", use_freq: bool = True) -> DataFrame:
    """One row: the mean distance to the own centroid by an error function (mse: by dimension too). use_freq: weights count."""
    w = F.col("freq") if use_freq else F.lit(1)
    d = (V.metric(error)(F.col("v"), F.col("c")) * w).cast(BIG)
    out = with_centroid(assigned, codebook).agg(F.sum(d).cast("double").alias("sum"), F.sum(w).alias("n"), F.max(F.size("v")).alias("dim"))
    return out.select((F.col("sum") / (F.col("n") * (F.col("dim") if error == "mse" else F.lit(1)))).alias("error"))


def partition_error(labelled: DataFrame, error: str = "mse") -> DataFrame:
    """The mean error of a partition (id, v, freq, cid): of its points to the means of their clusters."""
    means = centroids(labelled, labelled.select("cid").distinct().withColumn("c", F.lit(None).cast("array<bigint>")))
    return mean_error(labelled, means, error)


def codebook_error(points: DataFrame, codebook: DataFrame, error: str = "mse", use_freq: bool = True) -> DataFrame:
    """The mean error of a codebook, each point at its nearest vector by the same metric."""
    return mean_error(assign(points, codebook, V.metric(error)), codebook, error, use_freq)


def dimension_statistics(points: DataFrame) -> DataFrame:
    """dim, variance (of the population), median (the lower one, exact), low, high of each dimension. Ranks are counted by
    value, of which there may be as many as points."""
    rows = points.select(F.posexplode("v").alias("dim", "x"))
    byx = rows.groupBy("dim", "x").agg(F.count("*").alias("n"))
    about = rows.groupBy("dim").agg(F.var_pop("x").alias("variance"), F.count("*").alias("size"), F.min("x").alias("low"), F.max("x").alias("high"))
    run = F.sum("n").over(Window.partitionBy("dim").orderBy("x"))
    median = byx.withColumn("run", run).join(F.broadcast(about.select("dim", "size")), "dim").where(F.col("run") > F.floor((F.col("size") - 1) / 2)).groupBy("dim").agg(F.min("x").alias("median"))
    return about.drop("size").join(median, "dim")


def worst_points(assigned: DataFrame, m: int) -> DataFrame:
    """The m points that cost most (d2 * freq), ties to the smaller id."""
    return assigned.orderBy(F.desc(F.col("d2") * F.col("freq")), "id").limit(m)


def empty_clusters(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    return codebook.select("cid").join(assigned.select("cid").distinct(), "cid", "left_anti")


def duplicates(codebook: DataFrame) -> DataFrame:
    """How many vectors have a later twin."""
    return codebook.agg((F.count("*") - F.countDistinct("c")).alias("duplicates"))


def stochastic_complexity(assigned: DataFrame, clusters: int) -> DataFrame:
    """Bits a point that describing binary vectors by these clusters takes: the clusters' sizes, then each bit in each."""
    lf = V.log2_factorial
    ones = assigned.select("cid", "freq", F.posexplode("v").alias("dim", "x")).groupBy("cid", "dim").agg(F.sum("freq").alias("n"), F.sum(F.when(F.col("x") > 0, F.col("freq")).otherwise(0)).alias("f"))
    bits = ones.agg(F.sum(lf(F.col("n") + 1) - lf(F.col("f")) - lf(F.col("n") - F.col("f"))).alias("bits"))
    sizes = assigned.groupBy("cid").agg(F.sum("freq").alias("n")).agg(F.sum("n").alias("n"), F.sum(lf(F.col("n"))).alias("inside"))
    n, k = F.col("n"), F.lit(clusters)
    first = lf(n) - F.col("inside") + lf(n + k - 1) - lf(n - 1) - lf(k - 1)
    return sizes.crossJoin(F.broadcast(bits)).select(((first + F.col("bits")) / n).alias("sc"))  # a row each


def at_ranks(keyed: DataFrame, ranks: list[int]) -> DataFrame:
    """The rows of these ranks, from 0, in order of column x, ties by id; with a column rank. Ranks are counted in ranges of
    the order, so no task sorts all rows."""
    edges = sorted(set(keyed.select(F.col("x").cast("double").alias("x")).approxQuantile("x", [i / 64 for i in range(1, 64)], 0.001)))
    part = F.lit(0)
    for e in edges:
        part = part + (F.col("x").cast("double") > e).cast("int")
    parts = keyed.withColumn("part", part)
    counts = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())  # 64 rows at most
    before, used, run = F.lit(None).cast("bigint"), [], 0
    for own, n in counts:
        if any(run <= r < run + n for r in ranks):
            used.append(own)
            before = F.when(F.col("part") == own, F.lit(run).cast("bigint")).otherwise(before)
        run += n
    rank = F.row_number().over(Window.partitionBy("part").orderBy("x", "id"))
    ranked = parts.where(F.col("part").isin(used)).withColumn("rank", before + rank - 1)
    return ranked.where(F.col("rank").isin([int(r) for r in ranks])).drop("part")


def equal_width_picks(points: DataFrame, order: Column, k: int) -> DataFrame:
    """Of points put in order (ties by id), the middle one of each of k parts: rank, id."""
    keyed, size = points.select("id", order.alias("x")), points.count()
    return at_ranks(keyed, [(i * size + size // 2) // k for i in range(k)] if size else []).select("id", "rank")


def distinct_points(vectors: DataFrame, column: str = "v") -> DataFrame:
    """Equal vectors as one with their number as freq."""
    return vectors.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("freq"))


def unrolled(points: DataFrame) -> DataFrame:
    """A row for each unit of freq."""
    return points.select("id", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("freq"))).alias("copy")).where("copy >= 1")


def by_hash(points: DataFrame, seed: str) -> Column:
    """Order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(seed), F.lit("|"), points["id"].cast("string")))


def hash_number(seed: object, key: object) -> int:
    """The number in Python that begins by_hash: 52 bits."""
    import hashlib

    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16)


def sample(points: DataFrame, m: int, seed: str = "0") -> DataFrame:
    """m points, as if at random."""
    return points.orderBy(by_hash(points, seed), "id").limit(m)


def shuffled(points: DataFrame, seed: str = "0") -> DataFrame:
    """points with a column place, from 0: an order that looks random. Places are counted in ranges of the hash."""
    number = F.conv(F.substring(by_hash(points, seed), 1, 13), 16, 10).cast("bigint")
    rows = points.withColumn("h", number).withColumn("p", F.shiftright("h", 42))
    counts = rows.groupBy("p").agg(F.count("*").alias("n"))  # 1024 rows at most
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("p").orderBy("h", "id")) - 1
    return rows.withColumn("r", place).join(F.broadcast(before.limit(1024)), "p").select(*points.columns, (F.col("start") + F.col("r")).alias("place"))


def weighted_pick(points: DataFrame, target: int) -> DataFrame:
    """The first point, in order of id, up to which the weights sum to more than target.

    Weights are summed by ranges of ids first, so only the range that holds the target is put in order.
    """
    parts = points.withColumn("part", F.floor(F.col("id") / F.lit(1 << 16)))
    sums = parts.groupBy("part").agg(F.sum("freq").alias("w"))
    before = F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    hit = sums.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") <= target) & (F.col("before") + F.col("w") > target))
    running = F.sum("freq").over(Window.partitionBy("part").orderBy("id"))
    own = parts.join(F.broadcast(hit.select("part", "before")), "part").withColumn("sum", F.col("before") + running)
    return own.where(F.col("sum") > target).orderBy("id").limit(1).select("id", "v", "freq")


def subset(assigned: DataFrame, cid: int) -> DataFrame:
    return assigned.where(F.col("cid") == cid).select("id", "v", F.lit(1).cast("bigint").alias("freq"))


def nearest_member(assigned: DataFrame, cid: int, v: Column) -> DataFrame:
    """The point of a cluster nearest to a vector, ties to the smaller id."""
    return assigned.where(F.col("cid") == cid).select("id", V.squared(F.col("v"), v).alias("d2")).orderBy("d2", "id").limit(1)


def medoids(assigned: DataFrame, codebook: DataFrame) -> DataFrame:
    """For each cluster the member nearest to its centroid."""
    near = with_centroid(assigned, codebook).select("cid", F.struct(V.squared(F.col("v"), F.col("c")).alias("d2"), "id", "v").alias("m"))
    return near.groupBy("cid").agg(F.min("m").alias("m")).select("cid", "m.id", "m.v", "m.d2")


def join_clusters(assigned: DataFrame, a: int, b: int, last: int) -> DataFrame:
    """Cluster b's points go to a; the last cluster takes b's number."""
    cid = F.col("cid")
    return assigned.withColumn("cid", F.when(cid == b, F.lit(a)).when((cid == last) & F.lit(b != last), F.lit(b)).otherwise(cid))


def union_codebooks(first: DataFrame, second: DataFrame, size: int) -> DataFrame:
    """All vectors of both, those of the second numbered from size."""
    return first.unionByName(second.withColumn("cid", (F.col("cid") + size).cast("int")))


def without_empty(codebook: DataFrame) -> DataFrame:
    """The clusters that have points, numbered anew; a codebook is small, its order is made in one task."""
    return codebook.where("freq > 0").select((F.row_number().over(Window.orderBy("cid")) - 1).cast("int").alias("cid"), "c", "freq")


def combined(first: DataFrame, second: DataFrame, size: int) -> DataFrame:
    """Of two assignments of the same points the nearer centroid of each, the first at ties; the second's ids from size."""
    other = second.select("id", F.col("cid").alias("cid_b"), F.col("d2").alias("d2_b"))
    nearer = F.col("d2_b") < F.col("d2")
    return first.join(other, "id").select("id", "v", "freq", F.when(nearer, F.col("cid_b") + size).otherwise(F.col("cid")).cast("int").alias("cid"), F.least("d2", "d2_b").alias("d2"))


def second_costs(two: DataFrame, codebook: DataFrame) -> DataFrame:
    """For each cluster what its points lose when they go to their second nearest centroids: cid, n, cost."""
    loss = ((F.col("d2_2") - F.col("d2")) * F.col("freq")).cast(BIG)
    found = two.groupBy("cid").agg(F.sum("freq").alias("n"), F.sum(loss).cast(BIG).alias("cost"))
    return codebook.select("cid").join(found, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("cost", F.lit(0).cast(BIG)).alias("cost"))


def removal_costs(assigned: DataFrame, codebook: DataFrame, exact: bool = False) -> DataFrame:
    """cid, n, cost: what removing each cluster costs. Its points go to the other cluster that takes each in most cheaply, by
    the merge cost; what they cost now is taken off. exact: the points that go to one cluster go together, as a cluster of
    their own mean; their error there and that cluster's merge cost count. codebook's freq: the clusters' weights."""
    second = nearest_by_merge_cost(assigned, codebook)
    now = (F.col("d2") * F.col("freq")).cast(BIG)
    if not exact:
        found = second.groupBy("cid").agg(F.sum("freq").alias("n"), (F.sum(F.col("cost")) - F.sum(now)).cast(BIG).alias("cost"))
    else:
        square = F.aggregate("v", F.lit(0).cast(BIG), lambda a, x: (a + (x * x).cast(BIG)).cast(BIG))
        about = second.groupBy("cid", "cid2").agg(F.sum("freq").alias("w"), F.sum(now).cast(BIG).alias("now"), F.sum((square * F.col("freq")).cast(BIG)).cast(BIG).alias("q"))
        sums = second.select("cid", "cid2", "freq", F.posexplode("v").alias("dim", "x")).groupBy("cid", "cid2", "dim").agg(F.sum((F.col("x") * F.col("freq")).cast(BIG)).cast(BIG).alias("s"))
        sums = sums.groupBy("cid", "cid2").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"))
        to = codebook.select(F.col("cid").alias("cid2"), F.col("c").alias("to"), F.col("freq").alias("n2"))
        w = F.col("w")
        g = about.join(sums, ["cid", "cid2"]).join(to, "cid2").withColumn("m", F.transform("s", lambda x: F.floor((2 * x + w) / (2 * w)).cast("bigint")))
        cross = F.aggregate(F.zip_with("s", "m", lambda x, y: (x * y).cast(BIG)), F.lit(0).cast(BIG), lambda a, x: (a + x).cast(BIG))
        own = F.aggregate("m", F.lit(0).cast(BIG), lambda a, x: (a + (x * x).cast(BIG)).cast(BIG))
        inside = (F.col("q") - 2 * cross + (own * w).cast(BIG)).cast(BIG)
        merge = V.merge_cost(w, F.col("n2"), V.squared(F.col("m"), F.col("to")))
        found = g.groupBy("cid").agg(F.sum("w").alias("n"), F.sum((inside - F.col("now") + merge).cast(BIG)).cast(BIG).alias("cost"))
    return codebook.select("cid").join(found, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("cost", F.lit(0).cast(BIG)).alias("cost"))


def distance_matrix(codebook: DataFrame) -> DataFrame:
    """a < b and d2 for all pairs of centroids."""
    one, two = codebook.select(F.col("cid").alias("a"), F.col("c").alias("ca")), codebook.select(F.col("cid").alias("b"), F.col("c").alias("cb"))
    return one.join(two, F.col("a") < F.col("b")).select("a", "b", V.squared(F.col("ca"), F.col("cb")).alias("d2"))


def gabriel_neighbours(codebook: DataFrame) -> DataFrame:
    """Pairs of centroids whose midpoint has no nearer centroid than the two."""
    one, two = codebook.select(F.col("cid").alias("a"), F.col("c").alias("ca")), codebook.select(F.col("cid").alias("b"), F.col("c").alias("cb_"))
    pairs = one.join(two, F.col("a") < F.col("b")).withColumn("v", V.midpoint(F.col("ca"), F.col("cb_")))
    pairs = pairs.select(F.struct("a", "b").alias("id"), "v", F.lit(1).alias("freq"))
    return assign(pairs, codebook).where((F.col("cid") == F.col("id.a")) | (F.col("cid") == F.col("id.b"))).select("id.a", "id.b")


def single_link(assigned: DataFrame, a: int, b: int, block: int = 4096) -> DataFrame:
    """The least squared distance between points of two clusters, and the pair; the smaller ids at ties. Points meet as
    pairs of blocks of bounded size, of which each task tells its least."""
    import numpy as np
    import pyarrow as pa

    from ..plans.engine import distances

    sizes = {r["cid"]: r["n"] for r in assigned.where(F.col("cid").isin(a, b)).groupBy("cid").agg(F.count("*").alias("n")).collect()}  # two rows
    many = lambda k: max(1, -(-sizes.get(k, 0) // block))
    own = F.pmod(F.xxhash64("id"), F.lit(many(a)))
    one = assigned.where(F.col("cid") == a).select("id", "v", own.alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many(b) - 1).cast("bigint"))).alias("q"))
    own = F.pmod(F.xxhash64("id"), F.lit(many(b)))
    two = assigned.where(F.col("cid") == b).select(F.col("id").alias("id2"), F.col("v").alias("v2"), own.alias("q2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many(a) - 1).cast("bigint"))).alias("p2"))

    def least(x: pa.Table, y: pa.Table) -> pa.Table:
        best = None
        if x.num_rows and y.num_rows:
            i, j = x.column("id").to_numpy(), y.column("id2").to_numpy()
            u, v = np.array(x.column("v").to_pylist(), np.int64), np.array(y.column("v2").to_pylist(), np.int64)
            for s in range(0, len(i), 512):
                d = distances(u[s : s + 512], v)
                r, c = np.nonzero(d == d.min())
                found = min((int(d.min()), int(i[s + p]), int(j[q])) for p, q in zip(r.tolist(), c.tolist(), strict=True))
                best = found if best is None else min(best, found)
        names = ("d2", "a", "b")
        return pa.table({k: pa.array([best[p]] if best else [], pa.int64()) for p, k in enumerate(names)})

    found = one.groupBy("p", "q").cogroup(two.groupBy("p2", "q2")).applyInArrow(least, "d2 long, a long, b long")
    return found.agg(F.min(F.struct("d2", "a", "b")).alias("m")).where("m is not null").select("m.a", "m.b", "m.d2")
