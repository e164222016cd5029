"""Queries over the clustering operators on the driver's tables, and the same in DuckDB SQL.

Points are the distinct (quantity, discount, tax) of lineitem with their multiplicity. The codebook is the first 16 of
them by a hash. Both definitions are deterministic, so every result is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graphs as G
from ..operators import relational as R
from ..operators import validity as VA

K = 16
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v, freq; the id is made of the coordinates, so no order of all rows is needed."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    v = F.array(F.round("l_quantity").cast("bigint"), cents("l_discount"), cents("l_tax"))
    rows = R.distinct_points(items.select(v.alias("v")))
    return rows.select((F.col("v")[0] * 10_000 + F.col("v")[1] * 100 + F.col("v")[2]).alias("id"), "v", "freq")


def codebook(spark: SparkSession, sf_dir: str, k: int = K, seed: str = "cb") -> DataFrame:
    """The k points that come first by a hash, numbered by id; found once, so that no use of them scans the points again."""
    few = sorted((r["id"], r["v"]) for r in R.sample(points(spark, sf_dir), k, seed).collect())  # k rows
    return spark.createDataFrame([(i, v, 1) for i, (_, v) in enumerate(few)], "cid int, c array<bigint>, freq bigint")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assign(points(spark, sf_dir), codebook(spark, sf_dir))


def _d2(a: str, b: str) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in (1, 2, 3))


def _cb(name: str, k: int, seed: str) -> str:
    return f"""{name} AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cid, v AS c
        FROM (SELECT * FROM pts ORDER BY md5('{seed}|' || id), id LIMIT {k}))"""


BASE = f"""
    WITH RECURSIVE raw AS (SELECT round(l_quantity)::BIGINT q, round(l_discount * 100)::BIGINT d, round(l_tax * 100)::BIGINT t FROM lineitem),
    pts AS MATERIALIZED (SELECT q * 10000 + d * 100 + t AS id, [q, d, t] AS v, count(*) AS freq FROM raw GROUP BY q, d, t),
    {_cb("cb", K, "cb")},
    alld AS (SELECT id, v, freq, cid, c, {_d2("v", "c")} AS d2 FROM pts, cb),
    ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cid) AS r FROM alld),
    asg AS (SELECT id, v, freq, cid, d2 FROM ord WHERE r = 1),
    cen AS (
        SELECT cb.cid, CASE WHEN n IS NULL THEN c ELSE [(2 * s1 + n) // (2 * n), (2 * s2 + n) // (2 * n), (2 * s3 + n) // (2 * n)]::BIGINT[] END AS c,
               coalesce(n, 0)::BIGINT AS freq
        FROM cb LEFT JOIN (SELECT cid, sum(freq)::BIGINT AS n, sum(v[1] * freq)::BIGINT AS s1, sum(v[2] * freq)::BIGINT AS s2, sum(v[3] * freq)::BIGINT AS s3 FROM asg GROUP BY cid) a ON a.cid = cb.cid)
"""
FLAT = "v[1] AS v0, v[2] AS v1, v[3] AS v2"


def flat(df: DataFrame, column: str = "v", name: str = "v") -> DataFrame:
    """The vector as three columns, for comparison."""
    return df.select("*", *(F.col(column)[i].alias(f"{name}{i}") for i in range(3))).drop(column)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query, with the SQL that follows BASE."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return register


@query(f"SELECT id, {FLAT}, freq FROM pts")
def agg15_distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(points(spark, sf_dir))


@query("SELECT id, cid, d2 FROM asg")
def jn1_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("id", "cid", "d2")


@query("SELECT sum(d2 * freq)::DOUBLE AS sse, sum(freq)::BIGINT AS n, round(sum(d2 * freq)::DOUBLE / (sum(freq) * 3), 9) AS mse FROM asg")
def jn2_total_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.total_error(assigned(spark, sf_dir)).select(F.col("sse").cast("double").alias("sse"), "n", F.round("mse", 9).alias("mse"))


@query("SELECT id, max(CASE WHEN r = 1 THEN cid END) AS cid, max(CASE WHEN r = 1 THEN d2 END) AS d2, max(CASE WHEN r = 2 THEN cid END) AS cid2, max(CASE WHEN r = 2 THEN d2 END) AS d2_2 FROM ord WHERE r <= 2 GROUP BY id")
def jn3_second_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.two_nearest(points(spark, sf_dir), codebook(spark, sf_dir)).select("id", "cid", "d2", "cid2", "d2_2")


@query("""SELECT id, cid2, cost::DOUBLE AS cost FROM (
    SELECT a.id, cen.cid AS cid2, CASE WHEN a.freq * cen.freq = 0 THEN 0 ELSE (2 * a.freq * cen.freq * ({}) + a.freq + cen.freq) // (2 * (a.freq + cen.freq)) END AS cost,
           row_number() OVER (PARTITION BY a.id ORDER BY cost, cen.cid) AS r
    FROM asg a JOIN cen ON cen.cid <> a.cid) WHERE r = 1""".format(_d2("a.v", "cen.c")))
def jn4_nearest_by_merge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    out = R.nearest_by_merge_cost(own, R.centroids(own, codebook(spark, sf_dir)))
    return out.select("id", "cid2", F.col("cost").cast("double").alias("cost"))


@query("""SELECT id, cid, d2 FROM asg WHERE cid <> 3 UNION ALL SELECT id, cid, d2 FROM (
    SELECT a.id, cen.cid, {0} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {0}, cen.cid <> a.cid, cen.cid) AS r FROM asg a, cen WHERE a.cid = 3) WHERE r = 1""".format(_d2("a.v", "cen.c")))
def jn5_reassign_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    return R.reassign_cluster(own, R.centroids(own, codebook(spark, sf_dir)), 3).select("id", "cid", "d2")


@query("""SELECT a.id, CASE WHEN n.d < a.d2 THEN n.cid ELSE a.cid END AS cid, least(n.d, a.d2) AS d2 FROM asg a JOIN (
    SELECT a.id, cen.cid, {} AS d, row_number() OVER (PARTITION BY a.id ORDER BY d, cen.cid) AS r FROM asg a, cen WHERE cen.cid IN (2, 5)) n ON n.id = a.id AND n.r = 1""".format(_d2("a.v", "cen.c")))
def jn6_attract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    return R.attract(own, R.centroids(own, codebook(spark, sf_dir)), [2, 5]).select("id", "cid", "d2")


@query(f"SELECT a.id, a.cid, {_d2('a.v', 'cen.c')} AS d2 FROM asg a JOIN cen ON cen.cid = a.cid")
def jn7_owner_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    return R.with_centroid(own, R.centroids(own, codebook(spark, sf_dir))).select("id", "cid", V.squared(F.col("v"), F.col("c")).alias("d2"))


@query(f"SELECT id, {_d2('v', '[25, 5, 4]')} AS d2 FROM asg WHERE cid = 0 ORDER BY d2, id LIMIT 1")
def jn8_nearest_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_member(assigned(spark, sf_dir), 0, F.array(*(F.lit(x).cast("bigint") for x in (25, 5, 4))))


@query(f"SELECT a.id AS a, b.id AS b, {_d2('a.v', 'b.v')} AS d2 FROM asg a, asg b WHERE a.cid = 0 AND b.cid = 1 ORDER BY d2, a, b LIMIT 1")
def jn9_single_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.single_link(assigned(spark, sf_dir), 0, 1)


@query(f"SELECT x.cid AS a, y.cid AS b, {_d2('x.c', 'y.c')} AS d2 FROM cen x JOIN cen y ON x.cid < y.cid")
def jn12_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distance_matrix(R.centroids(assigned(spark, sf_dir), codebook(spark, sf_dir)))


@query("""SELECT a, b FROM (
    SELECT x.cid AS a, y.cid AS b, z.cid AS near, row_number() OVER (PARTITION BY x.cid, y.cid ORDER BY {}, z.cid) AS r
    FROM cb x JOIN cb y ON x.cid < y.cid, cb z) WHERE r = 1 AND near IN (a, b)""".format(" + ".join(f"((x.c[{i}] + y.c[{i}]) // 2 - z.c[{i}]) ** 2" for i in (1, 2, 3))))
def jn13_gabriel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gabriel_neighbours(codebook(spark, sf_dir))


@query(f"""SELECT a.id, CASE WHEN b.d2 < a.d2 THEN b.cid + {K} ELSE a.cid END::INT AS cid, least(a.d2, b.d2) AS d2 FROM asg a JOIN (
    SELECT pts.id, o.cid, {_d2('pts.v', 'o.c')} AS d2, row_number() OVER (PARTITION BY pts.id ORDER BY {_d2('pts.v', 'o.c')}, o.cid) AS r
    FROM pts, (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cid, v AS c FROM (SELECT * FROM pts ORDER BY md5('other|' || id), id LIMIT {K})) o) b ON b.id = a.id AND b.r = 1""")
def jn15_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = R.assign(points(spark, sf_dir), codebook(spark, sf_dir, K, "other"))
    return R.combined(assigned(spark, sf_dir), other, K).select("id", "cid", "d2")


@query("SELECT cid, count(*) AS uniques, sum(freq)::BIGINT AS n, sum(v[1] * freq)::DOUBLE AS s0, sum(v[2] * freq)::DOUBLE AS s1, sum(v[3] * freq)::DOUBLE AS s2 FROM asg GROUP BY cid")
def agg1_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counters(assigned(spark, sf_dir)).select("cid", "uniques", "n", *(F.col("s")[i].cast("double").alias(f"s{i}") for i in range(3)))


@query("SELECT cid, c[1] AS c0, c[2] AS c1, c[3] AS c2, freq FROM cen")
def agg2_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(R.centroids(assigned(spark, sf_dir), codebook(spark, sf_dir)), "c", "c")


@query("SELECT cid, sum(freq)::BIGINT AS n, sum(d2 * freq)::DOUBLE AS error FROM asg GROUP BY cid")
def agg3_cluster_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_errors(assigned(spark, sf_dir)).withColumn("error", F.col("error").cast("double"))


@query("SELECT id, cid, d2 FROM asg ORDER BY d2 * freq DESC, id LIMIT 5")
def srt5_worst_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worst_points(assigned(spark, sf_dir), 5).select("id", "cid", "d2")


@query("SELECT count(*) - count(DISTINCT v) AS duplicates FROM (SELECT v FROM pts UNION ALL SELECT c FROM cb)")
def agg10_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = points(spark, sf_dir).select(F.col("v").alias("c")).union(codebook(spark, sf_dir).select("c"))
    return R.duplicates(both)


@query("SELECT cb.cid FROM cb WHERE cid NOT IN (SELECT cid FROM asg WHERE v[1] > 10)")
def agg11_empty_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.empty_clusters(assigned(spark, sf_dir).where("v[0] > 10"), codebook(spark, sf_dir))


@query("SELECT sum(v[1] * freq)::DOUBLE AS s, ((2 * sum(v[1] * freq) + sum(freq)) // (2 * sum(freq)))::BIGINT AS c0, ((2 * sum(v[2] * freq) + sum(freq)) // (2 * sum(freq)))::BIGINT AS c1, ((2 * sum(v[3] * freq) + sum(freq)) // (2 * sum(freq)))::BIGINT AS c2 FROM pts")
def vec11_global_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    total = own.agg(F.sum(F.col("v")[0] * F.col("freq")).cast("double").alias("s"))
    return flat(R.global_centroid(own), "c", "c").drop("freq").crossJoin(F.broadcast(total))  # a row each


@query("SELECT id, count(*) AS copies FROM pts, range(1, freq + 1) r(copy) GROUP BY id")
def vec10_unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unrolled(points(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("copies"))


@query(f"""SELECT id, v[1] * 3 + v[2] * 5 + v[3] * 7 AS dot, v[1] + v[2] + v[3] AS total, floor((v[1] + v[2] + v[3]) / 3.0 + 0.5)::BIGINT AS mean,
    (v[1] + 3) // 2 AS mid0, v[2] - 5 AS minus1, {_d2('v', '[3, 5, 7]')} AS d2, floor(sqrt({_d2('v', '[3, 5, 7]')}))::BIGINT AS euclid,
    abs(v[1] - 3) + abs(v[2] - 5) + abs(v[3] - 7) AS manhattan, v > [3, 5, 7] AS greater FROM pts""")
def vec_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("v"), F.array(*(F.lit(x).cast("bigint") for x in (3, 5, 7)))
    return points(spark, sf_dir).select("id", V.dot(v, c).alias("dot"), V.total(v).alias("total"), V.mean(v).alias("mean"), V.midpoint(v, c)[0].alias("mid0"), V.minus(v, c)[1].alias("minus1"), V.squared(v, c).alias("d2"), V.euclid(v, c).alias("euclid"), V.manhattan(v, c).alias("manhattan"), (v > c).alias("greater"))




@query("""SELECT id, CASE WHEN m + b = 0 THEN 0 ELSE floor(1000000.0 * m / (m + b) + 0.5) END::BIGINT AS jaccard,
    CASE WHEN m + b = 0 THEN 0 ELSE floor(1000000.0 * m / (m + 2 * b) + 0.5) END::BIGINT AS dice FROM (
    SELECT id, (v[1] <= 25)::INT + (v[2] <= 5)::INT + (v[3] > 4)::INT AS m, (v[1] > 25)::INT + (v[2] > 5)::INT AS b FROM pts)""")
def dst_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    bits = F.array(*((v[i] > x).cast("bigint") for i, x in ((0, 25), (1, 5), (2, 4))))
    c = F.array(*(F.lit(x).cast("bigint") for x in (1, 1, 0)))
    return points(spark, sf_dir).select("id", V.jaccard(bits, c).alias("jaccard"), V.dice(bits, c).alias("dice"))


@query("SELECT o_orderkey AS id, floor((o_totalprice - lo) * (65535.0::DOUBLE / (hi - lo)) + 0.5)::BIGINT AS q FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)")
def vec1_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"))
    scale = F.broadcast(orders.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row
    return orders.crossJoin(scale).select(F.col("o_orderkey").alias("id"), V.quantise(F.array("x"), F.col("lo"), F.col("hi"), 65_535)[0].alias("q"))


@query("SELECT id FROM pts ORDER BY md5('s1|' || id), id LIMIT 50")
def flt3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample(points(spark, sf_dir), 50, "s1").select("id")


@query("SELECT id, freq FROM (SELECT id, freq, sum(freq) OVER (ORDER BY id) AS s FROM pts) WHERE s > (SELECT sum(freq) // 2 FROM pts) ORDER BY id LIMIT 1")
def flt5_weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    half = own.agg(F.sum("freq")).first()[0] // 2
    return R.weighted_pick(own, half).select("id", "freq")


@query(f"SELECT id, {FLAT} FROM asg WHERE cid = 2")
def flt1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(R.subset(assigned(spark, sf_dir), 2)).drop("freq")


@query("SELECT (row_number() OVER (ORDER BY cid) - 1)::INT AS cid, freq FROM cen WHERE freq > 0")
def flt7_without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_empty(R.centroids(assigned(spark, sf_dir), codebook(spark, sf_dir))).select("cid", "freq")


@query("SELECT CASE WHEN cid = 4 THEN 1 WHEN cid = 15 THEN 4 ELSE cid END::INT AS cid, count(*) AS n FROM asg GROUP BY 1")
def set3_join_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.join_clusters(assigned(spark, sf_dir), 1, 4, K - 1).groupBy("cid").agg(F.count("*").alias("n"))


@query("SELECT cid, c[1] AS c0 FROM cen UNION ALL SELECT cid + 16, c[1] FROM cb")
def set1_union_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cb = codebook(spark, sf_dir)
    return R.union_codebooks(R.centroids(assigned(spark, sf_dir), cb), cb, K).select("cid", F.col("c")[0].alias("c0"))


@query("""SELECT cid, id, d2 FROM (SELECT a.cid, a.id, {0} AS d2, row_number() OVER (PARTITION BY a.cid ORDER BY {0}, a.id) AS r
    FROM asg a JOIN cen ON cen.cid = a.cid) WHERE r = 1""".format(_d2("a.v", "cen.c")))
def gla8_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    return R.medoids(own, R.centroids(own, codebook(spark, sf_dir))).select("cid", "id", "d2")


@query("SELECT a.cid, sum(a.freq)::BIGINT AS n, sum((b.d2 - a.d2) * a.freq)::DOUBLE AS cost FROM asg a JOIN ord b ON b.id = a.id AND b.r = 2 GROUP BY a.cid")
def rs5_second_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cb = codebook(spark, sf_dir)
    return R.second_costs(R.two_nearest(points(spark, sf_dir), cb), cb).withColumn("cost", F.col("cost").cast("double"))


# validity, graphs, search


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v, freq and the true label; elements quantised from [-1, 1] to 65535 steps."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    v = V.quantise(F.col("embedding"), F.lit(-1.0), F.lit(1.0), 65_535)
    return rows.select(F.col("vec_id").alias("id"), v.alias("v"), F.lit(1).cast("bigint").alias("freq"), "label")


@query(f"SELECT sum({_d2('x.c', 'y.c')})::DOUBLE AS ssb FROM cen x JOIN cen y ON x.cid < y.cid")
def val3_ssb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.ssb(R.centroids(assigned(spark, sf_dir), codebook(spark, sf_dir)))


_SP = "sp AS (SELECT cid, sum(sqrt(d2) * freq) / sum(freq) AS m FROM asg GROUP BY cid)"


@query(f""", {_SP} SELECT round(avg(r), 9) AS davies_bouldin FROM (
    SELECT x.cid, max((a.m + b.m) / sqrt({_d2('x.c', 'y.c')})) AS r FROM cb x JOIN cb y ON x.cid <> y.cid JOIN sp a ON a.cid = x.cid JOIN sp b ON b.cid = y.cid GROUP BY x.cid)""")
def val5_davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.davies_bouldin(assigned(spark, sf_dir), codebook(spark, sf_dir)).select(F.round("davies_bouldin", 9).alias("davies_bouldin"))


@query(f""", {_SP} SELECT round(avg(coalesce(r, 0)), 9) AS davies_bouldin FROM (
    SELECT a.cid, max((a.m + b.m) / sqrt({_d2('x.c', 'y.c')})) AS r FROM sp a JOIN cb x ON a.cid = x.cid LEFT JOIN (cb y JOIN sp b ON b.cid = y.cid) ON y.cid > x.cid GROUP BY a.cid)""")
def val5_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.davies_bouldin(assigned(spark, sf_dir), codebook(spark, sf_dir), compat=True).select(F.round("davies_bouldin", 9).alias("davies_bouldin"))


@query(f"SELECT round((SELECT sum(d2 * freq)::DOUBLE / sum(freq) FROM asg) / (SELECT min({_d2('x.c', 'y.c')}) FROM cb x JOIN cb y ON x.cid < y.cid), 6) AS xie_beni")
def val10_xie_beni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.xie_beni(assigned(spark, sf_dir), codebook(spark, sf_dir)).select(F.round("xie_beni", 6).alias("xie_beni"))


_MEAN = "mean AS (SELECT [(2 * sum(v[1] * freq) + sum(freq)) // (2 * sum(freq)), (2 * sum(v[2] * freq) + sum(freq)) // (2 * sum(freq)), (2 * sum(v[3] * freq) + sum(freq)) // (2 * sum(freq))]::BIGINT[] AS m FROM pts)"


@query(f""", {_MEAN} SELECT round(count(*) * sum(e) / sum(n * ({_d2('c', 'm')})), 9) AS f_ratio FROM (
    SELECT cid, sum(freq) AS n, sum(d2 * freq)::DOUBLE AS e FROM asg GROUP BY cid) a JOIN cb ON cb.cid = a.cid, mean""")
def val6_f_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.f_ratio(assigned(spark, sf_dir), codebook(spark, sf_dir)).select(F.round("f_ratio", 9).alias("f_ratio"))


@query("""SELECT round(l - n * ln(n) - n * 3 / 2 * ln(2 * pi() * e / (3 * (n - k))) - 3 * (n - k) / 2 - k * 4 / 2 * ln(n), 3) AS bic FROM (
    SELECT sum(n)::DOUBLE AS n, sum(e)::DOUBLE AS e, count(*)::DOUBLE AS k, sum(n * ln(n)) AS l FROM (SELECT cid, sum(freq) AS n, sum(d2 * freq) AS e FROM asg GROUP BY cid))""")
def val11_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.bic(assigned(spark, sf_dir), 3).select(F.round("bic", 3).alias("bic"))


_VAR = " + ".join(f"(sum(v[{i}] * v[{i}] * freq)::DOUBLE / sum(freq) - (sum(v[{i}] * freq)::DOUBLE / sum(freq)) ** 2) ** 2" for i in (1, 2, 3))


@query(f"SELECT round((SELECT avg(l) FROM (SELECT sqrt({_VAR}) AS l FROM asg GROUP BY cid)) / (SELECT sqrt({_VAR}) FROM asg), 9) AS scatter")
def val12_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.scatter(assigned(spark, sf_dir)).select(F.round("scatter", 9).alias("scatter"))


_NEAR = lambda c: f"sum(CASE WHEN sqrt({_d2('a.v', c)}) <= sd THEN a.freq ELSE 0 END)"


@query(f""", va AS (SELECT cid, sqrt({_VAR}) AS l FROM asg GROUP BY cid), dev AS (SELECT sqrt(sum(l)) / count(*) AS sd FROM va),
    pr AS (SELECT x.cid AS a, y.cid AS b, x.c AS ca, y.c AS cb, [(x.c[1] + y.c[1]) // 2, (x.c[2] + y.c[2]) // 2, (x.c[3] + y.c[3]) // 2] AS m FROM cb x JOIN cb y ON x.cid < y.cid),
    den AS (SELECT pr.a, pr.b, {_NEAR("pr.m")} AS m, greatest({_NEAR("pr.ca")}, {_NEAR("pr.cb")}) AS g FROM pr JOIN asg a ON a.cid = pr.a OR a.cid = pr.b, dev GROUP BY pr.a, pr.b)
    SELECT round((SELECT avg(l) FROM va) / (SELECT sqrt({_VAR}) FROM asg) + (SELECT avg(CASE WHEN g > 0 THEN m / g ELSE 0 END) FROM den), 9) AS s_dbw""")
def val14_s_dbw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.s_dbw(assigned(spark, sf_dir), codebook(spark, sf_dir)).select(F.round("s_dbw", 9).alias("s_dbw"))


@query("SELECT round(sum(CASE WHEN b.d2 > 0 THEN (sqrt(b.d2) - sqrt(a.d2)) / sqrt(b.d2) ELSE 0 END * a.freq) / sum(a.freq), 9) AS simplified_silhouette FROM asg a JOIN ord b ON b.id = a.id AND b.r = 2")
def val8_simplified_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.simplified_silhouette(R.two_nearest(points(spark, sf_dir), codebook(spark, sf_dir))).select(F.round("simplified_silhouette", 9).alias("simplified_silhouette"))


@query(f"""SELECT round(sum(near / m * n) / sum(n), 9) AS silhouette_ci FROM (
    SELECT cid, sum(freq) AS n, sum(sqrt(d2) * freq) / sum(freq) AS m FROM asg GROUP BY cid) a JOIN (
    SELECT x.cid, min(sqrt({_d2('x.c', 'y.c')})) AS near FROM cb x JOIN cb y ON x.cid <> y.cid GROUP BY x.cid) b ON a.cid = b.cid WHERE m > 0""")
def val9_silhouette_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.silhouette_ci(assigned(spark, sf_dir), codebook(spark, sf_dir)).select(F.round("silhouette_ci", 9).alias("silhouette_ci"))


@query(f""", {_MEAN}, w AS (SELECT sum(n * ({_d2('c', 'm')}))::DOUBLE AS b, sum(e)::DOUBLE AS e, sum(n)::DOUBLE AS n FROM (
    SELECT cid, sum(freq) AS n, sum(d2 * freq) AS e FROM asg GROUP BY cid) a JOIN cb ON cb.cid = a.cid, mean)
    SELECT round((b / 15) / (e / (n - 16)), 6) AS f_test, round(1000 * (e / (n - 16)) / ((b / 15) / 3), 6) AS compat FROM w""")
def val7_f_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, cb = assigned(spark, sf_dir), codebook(spark, sf_dir)
    old = VA.f_test(own, cb, compat=True).select(F.round("f_test", 6).alias("compat"))
    return VA.f_test(own, cb).select(F.round("f_test", 6).alias("f_test")).crossJoin(F.broadcast(old))  # a row each


_SS = " + ".join(f"sum(v[{i}] * v[{i}] * freq) - sum(v[{i}] * freq)::DOUBLE ** 2 / sum(freq)" for i in (1, 2, 3))


@query(f"""SELECT round(sqrt(i / (3 * (n - k))), 6) AS rmsstd, round(1 - i / t, 6) AS r2 FROM
    (SELECT sum(s) AS i, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT {_SS} AS s, sum(freq) AS n FROM asg GROUP BY cid)), (SELECT {_SS} AS t FROM asg)""")
def val19_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.explained(assigned(spark, sf_dir)).select(F.round("rmsstd", 6).alias("rmsstd"), F.round("r2", 6).alias("r2"))


_ORPHANS = "(SELECT count(*) FROM {1} y WHERE y.cid NOT IN (SELECT near FROM (SELECT x.cid, y.cid AS near, row_number() OVER (PARTITION BY x.cid ORDER BY {2}, y.cid) AS r FROM {0} x, {1} y) WHERE r = 1))"


@query(f"""SELECT greatest({_ORPHANS.format("cb", "oth", _d2("x.c", "y.c"))}, {_ORPHANS.format("oth", "cb", _d2("x.c", "y.c"))}) AS centroid_index
    FROM (SELECT 1)""")
def val18_centroid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.centroid_index(codebook(spark, sf_dir), codebook(spark, sf_dir, K, "other"))


ORACLES["val18_centroid_index"] = ORACLES["val18_centroid_index"].replace("SELECT greatest", f", {_cb('oth', K, 'other')} SELECT greatest", 1)


def external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labellings of orders: by key and by price."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.pmod(F.col("o_orderkey"), F.lit(7)).alias("x"), F.pmod(F.floor(F.col("o_totalprice")), F.lit(5)).alias("y"))


@query("""SELECT round((t + 2 * c - a - b) / t, 9) AS rand, round((c - a * b / t) / ((a + b) / 2 - a * b / t), 9) AS adjusted_rand,
    round(2 * hab - ha - hb, 9) AS variation, round(2 * (ha + hb - hab) / (ha + hb), 9) AS nmi FROM (
    SELECT n * (n - 1) / 2 AS t, c, a, b, ln(n) - eab / n AS hab, ln(n) - ea / n AS ha, ln(n) - eb / n AS hb FROM
    (SELECT sum(k)::DOUBLE AS n, sum(k * (k - 1) / 2)::DOUBLE AS c, sum(k * ln(k)) AS eab FROM (SELECT count(*) AS k FROM orders GROUP BY o_orderkey % 7, floor(o_totalprice)::BIGINT % 5)),
    (SELECT sum(k * (k - 1) / 2)::DOUBLE AS a, sum(k * ln(k)) AS ea FROM (SELECT count(*) AS k FROM orders GROUP BY o_orderkey % 7)),
    (SELECT sum(k * (k - 1) / 2)::DOUBLE AS b, sum(k * ln(k)) AS eb FROM (SELECT count(*) AS k FROM orders GROUP BY floor(o_totalprice)::BIGINT % 5)))""")
def val15_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = VA.external(external_labels(spark, sf_dir), "x", "y")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(f"""SELECT src, dst, rank, dist FROM (SELECT a.id AS src, b.id AS dst, floor(sqrt({_d2('a.v', 'b.v')}))::BIGINT AS dist,
    row_number() OVER (PARTITION BY a.id ORDER BY floor(sqrt({_d2('a.v', 'b.v')})), b.id) AS rank FROM pts a JOIN pts b ON a.id <> b.id) WHERE rank <= 5""")
def grf1_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.knn_graph(points(spark, sf_dir), 5)


_LF = lambda x: f"(lgamma(({x}) + 1) / ln(2))"
_BIT = ", ".join(f"(v[{i}] > {x})::BIGINT" for i, x in ((1, 25), (2, 5), (3, 4)))


@query(f"""SELECT round(({_LF("n")} - inside + {_LF("n + 15")} - {_LF("n - 1")} - {_LF("15")} + bits) / n, 6) AS sc FROM
    (SELECT sum(n)::DOUBLE AS n, sum({_LF("n")}) AS inside FROM (SELECT cid, sum(freq)::DOUBLE AS n FROM asg GROUP BY cid)),
    (SELECT sum({_LF("n + 1")} - {_LF("f")} - {_LF("n - f")}) AS bits FROM (
        SELECT cid, i, sum(freq)::DOUBLE AS n, sum(CASE WHEN b[i] > 0 THEN freq ELSE 0 END)::DOUBLE AS f FROM (SELECT cid, freq, [{_BIT}] AS b FROM asg), range(1, 4) r(i) GROUP BY cid, i))""")
def agg7_stochastic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    bits = F.array(*((v[i] > x).cast("bigint") for i, x in ((0, 25), (1, 5), (2, 4))))
    return R.stochastic_complexity(assigned(spark, sf_dir).withColumn("v", bits), K).select(F.round("sc", 6).alias("sc"))


@query(f"""SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY {_d2("v", "[25, 5, 4]")}, id) - 1 AS rank FROM pts), (SELECT count(*) AS n FROM pts)
    WHERE rank IN (SELECT (i * n + n // 2) // 16 FROM range(16) r(i))""")
def win1_equal_width_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = F.array(*(F.lit(x).cast("bigint") for x in (25, 5, 4)))
    return R.equal_width_picks(points(spark, sf_dir), V.squared(F.col("v"), centre), K)


@query("SELECT a.id, sum(abs(b.x - a.x))::BIGINT AS sum FROM (SELECT id, v[1] AS x, row_number() OVER (ORDER BY v[1], id) AS r FROM pts) a JOIN (SELECT v[1] AS x, row_number() OVER (ORDER BY v[1], id) AS r FROM pts) b ON b.r BETWEEN a.r - 5 AND a.r + 5 GROUP BY a.id")
def win3_sliding_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sliding_density(points(spark, sf_dir), 0, 10)


@query(f"""SELECT round(min(CASE WHEN p <> q THEN d END) / max(CASE WHEN p = q THEN d END), 9) AS dunn FROM
    (SELECT a.cid AS p, b.cid AS q, ({_d2("a.v", "b.v")})::DOUBLE AS d FROM asg a JOIN asg b ON a.id < b.id)""")
def val4_dunn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.dunn(assigned(spark, sf_dir)).select(F.round("dunn", 9).alias("dunn"))


@query(f"""SELECT round(sum(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END * freq) / sum(freq), 9) AS silhouette FROM (
    SELECT id, freq, max(CASE WHEN p = q THEN s / greatest(n + freq - 1, 1) END) AS a, min(CASE WHEN p <> q THEN s / n END) AS b FROM (
        SELECT a.id, a.freq, a.cid AS p, b.cid AS q, sum(sqrt({_d2("a.v", "b.v")}) * b.freq) AS s, sum(b.freq) AS n FROM asg a JOIN asg b ON a.id <> b.id GROUP BY a.id, a.freq, a.cid, b.cid) GROUP BY id, freq)""")
def val8_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.silhouette(assigned(spark, sf_dir)).select(F.round("silhouette", 9).alias("silhouette"))


@query(f"""SELECT round(sum(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END * freq) / sum(freq), 9) AS silhouette FROM (
    SELECT id, freq, max(CASE WHEN p = q THEN s / (n + freq) END) AS a, min(CASE WHEN p <> q THEN s / n END) AS b FROM (
        SELECT a.id, a.freq, a.cid AS p, b.cid AS q, sum(sqrt({_d2("a.v", "b.v")}) * b.freq) AS s, sum(b.freq) AS n FROM asg a JOIN asg b ON a.id <> b.id GROUP BY a.id, a.freq, a.cid, b.cid) GROUP BY id, freq)""")
def val8_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VA.silhouette(assigned(spark, sf_dir), compat=True).select(F.round("silhouette", 9).alias("silhouette"))


from . import library, searches  # noqa: E402, F401  more queries, registered here
