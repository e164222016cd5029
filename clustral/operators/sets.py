"""Codebooks, partitions and sets of float vectors as tables: small operators that programs are made of.

codebook: cid, c, freq, numbered from 0 without gaps. partition: id, cid. sets: id, x array<double>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .relational import _with_codebook

# codebooks


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """(cid, c, freq) numbered anew in an order; a codebook is small, one task puts it in order."""
    return rows.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("int").alias("cid"), "c", "freq")


def add_vector(codebook: DataFrame, c: Column, freq: int = 0) -> DataFrame:
    """The codebook with one vector more, numbered last."""
    one = codebook.agg(F.count("*").cast("int").alias("cid")).select("cid", c.alias("c"), F.lit(freq).cast("bigint").alias("freq"))
    return codebook.select("cid", "c", "freq").union(one)


def remove_vector(codebook: DataFrame, cid: int) -> DataFrame:
    """The codebook without one vector; the last takes its number."""
    last = codebook.agg((F.count("*") - 1).cast("int").alias("last"))
    rows = codebook.select("cid", "c", "freq").crossJoin(F.broadcast(last))  # one row
    return rows.where(F.col("cid") != cid).select(F.when((F.col("cid") == F.col("last")) & (F.col("last") > cid), F.lit(cid)).otherwise(F.col("cid")).cast("int").alias("cid"), "c", "freq")


def sorted_codebook(codebook: DataFrame, by: str = "data", descending: bool = False) -> DataFrame:
    """Numbered anew by the vectors (data), the weights (freq) or the vectors' means (mean); ties by the old number."""
    keys = {"data": F.col("c"), "freq": F.col("freq"), "mean": V.mean(F.col("c"))}
    if by not in keys:
        raise ValueError(f"no order {by!r}")
    return numbered(codebook, keys[by].desc() if descending else keys[by].asc(), F.col("cid"))


def by_centroid_distance(codebook: DataFrame, centre: DataFrame) -> DataFrame:
    """Numbered anew by the squared distance to the one vector c of `centre`; ties by the old number."""
    one = F.broadcast(centre.limit(1).select(F.col("c").alias("centre")))  # one row
    return numbered(codebook.crossJoin(one).withColumn("d", V.squared(F.col("c"), F.col("centre"))), "d", "cid")


def order_matrix(codebook: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(a, rank, b, d2): for each vector all others by distance, ties by number; of b only those in `only`."""
    rows = codebook.select(F.col("cid").alias("a"), F.col("c").alias("v"))
    others = F.filter("cb", lambda k: (k["cid"] != F.col("a")) & (k["cid"].isin(only) if only is not None else F.lit(True)))
    near = F.array_sort(F.transform(others, lambda k: F.struct(V.squared(F.col("v"), k["c"]).alias("d2"), k["cid"].alias("b"))))
    met = _with_codebook(rows, codebook).select("a", F.posexplode(near).alias("i", "n"))
    return met.select("a", (F.col("i") + 1).alias("rank"), "n.b", "n.d2")


def replace_duplicates(codebook: DataFrame, reserve: DataFrame) -> DataFrame:
    """A vector that has a later twin is replaced by one of the reserve (id, v) that the codebook lacks, in order of both."""
    later = codebook.groupBy("c").agg(F.max("cid").alias("last"))
    marked = codebook.join(later, "c").select("cid", "c", "freq", (F.col("cid") < F.col("last")).alias("twin"))
    free = reserve.select("id", F.col("v").alias("c")).join(codebook.select("c"), "c", "left_anti").groupBy("c").agg(F.min("id").alias("id"))
    size = codebook.count()
    free = free.orderBy("id").limit(size).select(F.row_number().over(Window.orderBy("id")).alias("r"), F.col("c").alias("fresh"))  # as many rows as the codebook
    twins = marked.where("twin").select("cid", F.row_number().over(Window.orderBy("cid")).alias("r"))
    put = twins.join(free, "r").select("cid", "fresh")
    return marked.join(put, "cid", "left").select("cid", F.coalesce("fresh", "c").alias("c"), "freq")


def moved_centroids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(cid, moved, d2) of two codebooks of the same numbers: the active clusters are those that moved."""
    both = old.select("cid", "c").join(new.select("cid", F.col("c").alias("n")), "cid")
    d2 = V.squared(F.col("c"), F.col("n"))
    return both.select("cid", (d2 > 0).alias("moved"), d2.alias("d2"))


# partitions


def all_in_first(points: DataFrame) -> DataFrame:
    """One cluster."""
    return points.withColumn("cid", F.lit(0))


def all_in_own(points: DataFrame) -> DataFrame:
    """Each point a cluster, numbered in order of ids; numbers are counted in ranges, see shuffled."""
    parts = points.withColumn("p", F.floor(F.col("id") / F.lit(1 << 16)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("p").agg(F.count("*").alias("n")).select("p", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    return parts.withColumn("r", rank).join(starts, "p").select(*points.columns, (F.col("start") + F.col("r")).cast("int").alias("cid"))


def moved_item(partition: DataFrame, item: int, to: int) -> DataFrame:
    """One point put into another cluster."""
    return partition.withColumn("cid", F.when(F.col("id") == item, F.lit(to)).otherwise(F.col("cid")).cast("int"))


def resized(partition: DataFrame, clusters: int) -> DataFrame:
    """At most so many clusters: points of later ones go to the last that stays. More clusters are empty ones."""
    return partition.withColumn("cid", F.least("cid", F.lit(clusters - 1)))


# sets of float vectors


def sub_dimensions(rows: DataFrame, dims: list[int]) -> DataFrame:
    return rows.withColumn("x", F.array(*(F.get("x", F.lit(d)) for d in dims)))


def column_profile(rows: DataFrame) -> DataFrame:
    """dim, mean, low, high, kinds (distinct values), binary (only 0 and 1) of each column."""
    each = rows.select(F.posexplode("x").alias("dim", "x"))
    return each.groupBy("dim").agg(F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.count_distinct("x").alias("kinds"), F.min(F.col("x").isin(0.0, 1.0)).alias("binary"))


def range_of(rows: DataFrame) -> DataFrame:
    """One row: low, high of all elements, binary."""
    return rows.agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"), F.min(F.forall("x", lambda e: e.isin(0.0, 1.0))).alias("binary"))


def nth(rows: DataFrame, dim: int, rank: int) -> DataFrame:
    """The value of a rank, from 0, in a column's ascending order."""
    from .relational import at_ranks

    return at_ranks(rows.select("id", F.get("x", F.lit(dim)).alias("x")), [rank]).select(F.col("x").alias("value"))


def by_dimensions(rows: DataFrame, dims: list[int]) -> DataFrame:
    """In order of some columns, the first of them first; ties by id."""
    return rows.orderBy(*(F.get("x", F.lit(d)) for d in dims), "id")


def unique_values(rows: DataFrame, dim: int) -> DataFrame:
    """value, n of a column."""
    return rows.groupBy(F.get("x", F.lit(dim)).alias("value")).agg(F.count("*").alias("n"))
