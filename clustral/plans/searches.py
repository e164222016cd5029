"""Queries of the search algorithms: initial codebooks, K-means, random swap, merging, splitting, genetic algorithm.

Those that don't depend on floating-point order have SQL, every step of it a table (unrolled.py).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genetic as GA
from ..operators import graphs as G
from ..operators import kmeans as M
from ..operators import merging as P
from ..operators import splitting as S
from ..sources.files import history_table
from .engine import Points, of
from .queries import K, _embeddings, codebook, points, query
from .unrolled import Steps


def solved(spark: SparkSession, s: M.Solution) -> DataFrame:
    """cid, c, freq, sse."""
    return spark.createDataFrame([(i, [int(x) for x in c], int(n), float(s.sse)) for i, (c, n) in enumerate(zip(s.codebook, s.n, strict=True))], "cid int, c array<bigint>, freq bigint, sse double")


def flat(spark: SparkSession, s: M.Solution) -> DataFrame:
    """cid, c0, c1, c2, freq, sse."""
    return solved(spark, s).select("cid", *(F.col("c")[i].alias(f"c{i}") for i in range(3)), "freq", "sse")


def _lineitem(spark: SparkSession, sf_dir: str) -> Points:
    return of(points(spark, sf_dir))


def _start(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The codebook that the SQL calls cb."""
    return np.array([r["c"] for r in codebook(spark, sf_dir).orderBy("cid").collect()], np.int64)  # K rows


def _steps(f: Callable[[Steps], str]) -> str:
    s = Steps()
    return s.solution(f(s))


def search(sql: Callable[[Steps], str] | None = None, name: str | None = None):
    """Registers f(points) -> Solution as a query."""

    def register(f: Callable[[Points], M.Solution]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = _lineitem(spark, sf_dir)
            return flat(spark, f(e))

        run.__name__ = name or f.__name__
        query(_steps(sql) if sql else None)(run)
        return f

    return register


# initial codebooks

_INITS: dict[str, Callable[[Steps], str] | None] = {
    "random": lambda s: s.first(8, "0"),
    "weighted": lambda s: s.weighted(8, "0"),
    "kmeans++": lambda s: s.plus_plus(8, "0"),
    "maxmin": lambda s: s.maxmin(8),
    "projection": lambda s: s.projection(8, "0"),
    "sorting": lambda s: s.sorting(8, "0"),
    "stratified": lambda s: s.stratified(8, "0"),
    "partition": lambda s: s.partition(8, "0"),
    "luxburg": lambda s: s.luxburg(8, "0"),
    "splitting": lambda s: s.splitting(8, "0", 5),
    "bradley": None,
    "density": None,
    "hybrid": None,
    "overlap": None,
}
for _name, _sql in _INITS.items():
    search(_sql, f"ini_{_name.replace('+', 'p')}")(lambda e, f=M.INITS[_name]: M.of_codebook(e, f(e, 8)))


# K-means


@search(lambda s: s.lloyd(s.maxmin(K), 10))
def km1_kmeans(e: Points) -> M.Solution:
    return M.kmeans(e, K, "maxmin", iterations=10)


@query(Steps().history("cb", 3))
def snk8_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_table(spark, M.lloyd(_lineitem(spark, sf_dir), _start(spark, sf_dir), 3).history)


@search()
def km1_to_the_end(e: Points) -> M.Solution:
    return M.kmeans(e, K, "random", repeats=3)


_STRATEGIES = {"gla0_driver": "full", "gla2_local": "local", "gla3_wu": "wu", "gla4_tie": "tie", "gla5_local_tie": "local_tie", "gla6_mps": "mps", "gla7_local_mps": "local_mps", "gla11_mean": "mean", "km6_traveller": "traveller"}


def _with_search(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(spark, M.lloyd(_lineitem(spark, sf_dir), _start(spark, sf_dir), 6, search=how))

    return run


for _name, _how in _STRATEGIES.items():
    _run = _with_search(_how)
    _run.__name__ = _name
    query(_steps(lambda s: s.lloyd("cb", 6)))(_run)


@search()
def gla8_kmedoids(e: Points) -> M.Solution:
    return M.lloyd(e, M.maxmin_init(e, 8), members=True)


@search()
def gla10_fill_empties(e: Points) -> M.Solution:
    return M.lloyd(e, np.concatenate([M.random_init(e, 6), np.full((2, e.dim), 10**6)]), 10, fill=True)


@search()
def sa1_annealing(e: Points) -> M.Solution:
    return M.anneal(e, M.random_init(e, 8), M.Annealing(8.0, 1.0), 10, 100)


# random swap


@search(lambda s: s.swaps(8, 5, 2, "0"))
def rs1_five_swaps(e: Points) -> M.Solution:
    return M.random_swap(e, 8, 5)


@query()
def rs1_random_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solved(spark, M.random_swap(of(_embeddings(spark, sf_dir)), 10))


@search()
def rs6_automatic_stop(e: Points) -> M.Solution:
    return M.random_swap(e, 8, 0, deterministic=True)


# merging and shrinking


@search(lambda s: s.lloyd(s.merge(s.first(64, "0"), K, 64 - K), 2))
def pnn1_merge(e: Points) -> M.Solution:
    c = M.random_init(e, 64)
    return M.lloyd(e, P.pnn(c, e.statistics(c).n, K)[0], 2)


@search(lambda s: s.merge(s.first(40, "0"), 8, 32))
def pnn2_lazy(e: Points) -> M.Solution:
    c = M.random_init(e, 40)
    return M.of_codebook(e, P.pnn(c, e.statistics(c).n, 8, search="lazy")[0])


@search()
def pnn2_fast(e: Points) -> M.Solution:
    c = M.random_init(e, 64)
    return M.of_codebook(e, P.pnn(c, e.statistics(c).n, K, search="fast")[0])


@search()
def pnn3_amount(e: Points) -> M.Solution:
    return P.pnn_of_points(e, K, 64, cost="amount")


@search()
def pnn4_counters(e: Points) -> M.Solution:
    return P.pnn_of_points(e, K, 64, cost="increase", counters=True)


@search()
def pnn7_tuned(e: Points) -> M.Solution:
    return P.pnn_of_points(e, K, 32, tune=1)


@search(lambda s: s.shrink(s.first(12, "0"), 4))
def ish1_shrink(e: Points) -> M.Solution:
    return P.shrink(e, M.random_init(e, 12), 8)


@search()
def ish2_exact_shrink(e: Points) -> M.Solution:
    return P.shrink(e, M.random_init(e, 12), 8, "exact")


@search()
def ish3_standard_policy(e: Points) -> M.Solution:
    return P.shrink(e, M.random_init(e, 12), 8, policy="standard")


# splitting


@search()
def spl1_split(e: Points) -> M.Solution:
    return S.split(e, e.sample(1, "0"), 8)


for _rule in ("sigma", "sigmas", "far", "random", "two_far", "two_random", "means", "mirror"):
    # a random member may be the centroid itself, when another cluster is split: that has no SQL
    search(None if _rule == "random" else lambda s, r=_rule: s.split(8, r, 1, "0"), f"spl3_{_rule}")(lambda e, r=_rule: S.split(e, e.sample(1, "0"), 8, "error", tune=1, rule=r))

for _pivot in S.PIVOTS:
    search(None, f"spl4_{_pivot.replace('-', '_')}")(lambda e, p=_pivot: S.split(e, e.sample(1, "0"), 8, "error", axis="regression", pivot=p))


@search()
def spl5_local_tuning(e: Points) -> M.Solution:
    return S.split(e, e.sample(1, "0"), 8, "third", axis="furthest", inside=3, tune=0)


@search()
def ims1_split_and_merge(e: Points) -> M.Solution:
    return S.split_and_merge(e, M.random_init(e, 8))


@search()
def ims2_better_one(e: Points) -> M.Solution:
    return S.split_and_merge(e, M.random_init(e, 8), order="better", decay=0.1)


# genetic algorithm


@search()
def ga1_genetic(e: Points) -> M.Solution:
    return GA.genetic(e, 8)


for _method in GA.CROSSINGS:
    search(None, f"ga_cross_{_method.replace('-', '_')}")(lambda e, m=_method: GA.genetic(e, 8, 2, 4, m))

for _first in GA.FIRST:
    search(None, f"ga2_{_first.replace('-', '_')}")(lambda e, f=_first: GA.genetic(e, 8, 1, 4, first=f, noise=2.0, weighted=f == "codebook"))


def _pairs(method: str, size: int, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(GA.select(list(range(10)), size, method))], "i int, a int, b int")

    run.__name__ = f"ga3_{method}"
    query(sql)(run)


_ORDERED = "SELECT (row_number() OVER (ORDER BY {0}) - 1)::INT AS i, a::INT AS a, b::INT AS b FROM (SELECT a, b FROM range(10) x(a), range(10) y(b) WHERE {1}) QUALIFY i < {2}"
_pairs("elitist", 9, _ORDERED.format("b, a", "a < b AND b < 5", 9))
_pairs("elitist2", 9, _ORDERED.format("b, a", "a <= b AND b < 4", 9))
_pairs("zigzag", 9, _ORDERED.format("b - a, a", "b - a IN (1, 2)", 9))


# densities


_BY_PRICE = "r AS (SELECT id, d, x, row_number() OVER (PARTITION BY d ORDER BY x, id) AS r FROM (SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS x, 1 AS d FROM orders UNION ALL SELECT o_orderkey, o_orderkey, 2 FROM orders))"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their price in cents and their key."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("id"), F.array(F.round(F.col("o_totalprice") * 100).cast("bigint"), F.col("o_orderkey").cast("bigint")).alias("v"), F.lit(1).cast("bigint").alias("freq"))


@query(f", {_BY_PRICE} SELECT id, round(sum(d), 12) AS density FROM (SELECT a.id, a.d AS dim, (count(*) - 1) / (sum(abs(b.x - a.x)) + 1e-20) AS d FROM r a JOIN r b ON a.d = b.d AND b.r BETWEEN a.r - 5 AND a.r + 5 GROUP BY a.id, a.d) GROUP BY id")
def den2_window_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.axis_density(_orders(spark, sf_dir), 10).select("id", F.round("density", 12).alias("density"))


@query(f""", {_BY_PRICE}, n AS (SELECT a.id, a.d AS dim, abs(b.x - a.x) AS x, row_number() OVER (PARTITION BY a.id, a.d ORDER BY abs(b.x - a.x)) AS k FROM r a JOIN r b ON a.d = b.d AND a.id <> b.id AND b.r BETWEEN a.r - 10 AND a.r + 10)
    SELECT id, round(sum(d), 12) AS density FROM (SELECT id, dim, count(*) / (sum(x) + 1e-20) AS d FROM n WHERE k <= 10 GROUP BY id, dim) GROUP BY id""")
def den1_axis_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest_axis_density(_orders(spark, sf_dir), 10).select("id", F.round("density", 12).alias("density"))


@query(f"""SELECT id, round(k / greatest(1 / (far + 1e-20) + total, 1e-20), 9) AS density FROM (SELECT id, count(*) AS k, max(dist) AS far, sum(dist) AS total FROM (
    SELECT a.id, floor(sqrt({" + ".join(f"(a.v[{i}] - b.v[{i}]) ** 2" for i in (1, 2, 3))}))::BIGINT AS dist, row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) AS r FROM pts a JOIN pts b ON a.id <> b.id) WHERE r <= 5 GROUP BY id)""")
def den3_graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.graph_density(G.knn_graph(points(spark, sf_dir), 5))
    return out.select("id", F.round("density", 9).alias("density"))


@query("SELECT id, ('0x' || substr(md5('0|' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS density FROM pts")
def den4_random_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.random_density(points(spark, sf_dir))


_DENSER = f"""SELECT a.id, min(floor(sqrt({" + ".join(f"(a.v[{i}] - b.v[{i}]) ** 2" for i in (1, 2, 3))}))::BIGINT) AS delta FROM pts a JOIN pts b ON b.freq > a.freq OR (b.freq = a.freq AND b.id < a.id) GROUP BY a.id"""


@query(f"SELECT pts.id, freq::DOUBLE AS density, delta FROM pts LEFT JOIN ({_DENSER}) d ON d.id = pts.id")
def win6_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    return G.peak_deltas(own, own.select("id", F.col("freq").cast("double").alias("density")))


def _peaks(by: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = points(spark, sf_dir)
        out = G.density_peaks(own, own.select("id", F.col("freq").cast("double").alias("density")), by)
        return out.orderBy(F.desc("peak"), "id").limit(20).select("id", F.when(F.col("peak") < 1e300, F.col("peak")).alias("peak"))

    run.__name__ = f"den5_{by}"
    query(sql)(run)


_TOP = f"SELECT id, CASE WHEN peak < 1e300 THEN peak END AS peak FROM (SELECT pts.id, {{}} AS peak FROM pts LEFT JOIN ({_DENSER}) d ON d.id = pts.id) ORDER BY peak DESC NULLS FIRST, id LIMIT 20"
_peaks("plain", _TOP.format("coalesce(delta::DOUBLE, 1e305)"))
_peaks("gamma", _TOP.format("coalesce(delta::DOUBLE * freq, 1e305)"))
_peaks("density", "SELECT id, freq::DOUBLE AS peak FROM pts ORDER BY freq DESC, id LIMIT 20")


@query("""SELECT id, sum(e)::BIGINT AS evidence FROM (
    SELECT a.id, count(*) FILTER (b.freq > a.freq) AS e FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY x, id) - 1 AS r FROM (SELECT id, freq, v[1] AS x, 1 AS d FROM pts UNION ALL SELECT id, freq, v[2], 2 FROM pts UNION ALL SELECT id, freq, v[3], 3 FROM pts)) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY d ORDER BY x, id) - 1 AS r FROM (SELECT id, freq, v[1] AS x, 1 AS d FROM pts UNION ALL SELECT id, freq, v[2], 2 FROM pts UNION ALL SELECT id, freq, v[3], 3 FROM pts)) b
    ON a.d = b.d AND b.r BETWEEN (CASE WHEN greatest(a.r - 25, 0) + 50 >= (SELECT count(*) FROM pts) THEN (SELECT count(*) FROM pts) - 51 ELSE greatest(a.r - 25, 0) END)
        AND (CASE WHEN greatest(a.r - 25, 0) + 50 >= (SELECT count(*) FROM pts) THEN (SELECT count(*) FROM pts) - 51 ELSE greatest(a.r - 25, 0) END) + 49
    GROUP BY a.id, a.d) GROUP BY id""")
def win4_denser_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    return G.higher_in_window(own, own.select("id", F.col("freq").alias("density")))


@query()
def jn11_sampled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sampled_knn_graph(points(spark, sf_dir), 5)


@query()
def grf4_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hulls(_parts(spark, sf_dir), "p_brand")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_brand", F.array(F.col("p_size").cast("bigint"), F.round("p_retailprice").cast("bigint")).alias("v"))


@query(""", h AS (SELECT DISTINCT p_brand AS b, p_size::BIGINT AS x, round(p_retailprice)::BIGINT AS y FROM part)
    SELECT DISTINCT p.b AS p_brand, p.x, p.y FROM h p JOIN h q ON p.b = q.b AND (p.x <> q.x OR p.y <> q.y)
    WHERE NOT EXISTS (SELECT 1 FROM h r WHERE r.b = p.b AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
        OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) < 0)))""")
def grf4_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hulls(_parts(spark, sf_dir), "p_brand").select("p_brand", "x", "y")


_EDGES = f"""e AS MATERIALIZED (SELECT src, dst, dist FROM (SELECT a.id AS src, b.id AS dst, floor(sqrt({" + ".join(f"(a.v[{i}] - b.v[{i}]) ** 2" for i in (1, 2, 3))}))::BIGINT AS dist,
    row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) AS r FROM pts a JOIN pts b ON a.id <> b.id) WHERE r <= 5)"""


@query(f", {_EDGES} SELECT src, dst, dist FROM e UNION SELECT dst, src, dist FROM e")
def grf1_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mutual(G.knn_graph(points(spark, sf_dir), 5))


@query(f", {_EDGES} SELECT src, dst, dist FROM e WHERE dst % 7 <> 0 UNION ALL SELECT src, 510000 + src, 1 FROM (SELECT DISTINCT src FROM e)")
def grf2_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.knn_graph(points(spark, sf_dir), 5)
    less = G.remove_edges(edges, edges.where("dst % 7 = 0"))
    return G.add_edges(less, edges.select("src").distinct().select("src", (F.col("src") + 510_000).alias("dst"), F.lit(1).cast("bigint").alias("dist"))).select("src", "dst", "dist")


@query(f", {_EDGES} SELECT src, count(*) AS k, string_agg(dst::VARCHAR, ' ' ORDER BY dist, dst) AS dsts FROM e GROUP BY src")
def grf3_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours_of(G.knn_graph(points(spark, sf_dir), 5)).select("src", "k", F.array_join("dsts", " ").alias("dsts"))
