"""Queries of the small operators on vectors, codebooks, partitions and files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import relational as R
from ..operators import sets
from ..sources import files
from .queries import _LF, FLAT, K, _d2, assigned, codebook, flat, points, query  # noqa: F401

_BITS = ", ".join(f"(v[{i}] > {x})::BIGINT" for i, x in ((1, 25), (2, 5), (3, 4)))


def _bits(v: str = "v"):
    return F.array(*((F.col(v)[i] > x).cast("bigint") for i, x in ((0, 25), (1, 5), (2, 4))))


def _cents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assignment, its start, and the centroids."""
    own, cb = assigned(spark, sf_dir), codebook(spark, sf_dir)
    return own, cb, R.centroids(own, cb)


# errors


_MISMATCH = lambda w: f"CASE WHEN m + b = 0 THEN 0 ELSE floor(1000000.0 * m / (m + {w} * b) + 0.5) END"


def _binary_error(name: str, weight: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bits, cb = points(spark, sf_dir).withColumn("v", _bits()), codebook(spark, sf_dir).withColumn("c", _bits("c"))
        return R.codebook_error(bits, cb, name).select(F.round("error", 6).alias("error"))

    run.__name__ = f"agg4_{name}"
    each = f"SELECT p.id, p.freq, min({_MISMATCH(weight)}) AS d FROM (SELECT p.id, p.freq, c.cid, " + " + ".join(f"(p.b[{i}] <> c.b[{i}])::INT" for i in (1, 2, 3)) + " AS m, " + " + ".join(f"(p.b[{i}] = 1 AND c.b[{i}] = 1)::INT" for i in (1, 2, 3)) + f" AS b FROM (SELECT id, freq, [{_BITS}] AS b FROM pts) p, (SELECT cid, [{_BITS.replace('v[', 'c[')}] AS b FROM cb) c) p GROUP BY p.id, p.freq"
    query(f"SELECT round(sum(d * freq) / sum(freq), 6) AS error FROM ({each})")(run)


_binary_error("jaccard", 1)
_binary_error("dice", 2)


@query(f"SELECT round(sum(({_d2('a.v', 'c.c')}) * a.freq)::DOUBLE / (sum(a.freq) * 3), 6) AS error FROM asg a JOIN cen c ON a.cid = c.cid")
def agg5_partition_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.partition_error(assigned(spark, sf_dir)).select(F.round("error", 6).alias("error"))


@query("SELECT round(sum(d2)::DOUBLE / (count(*) * 3), 6) AS error FROM asg")
def agg6_without_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.codebook_error(points(spark, sf_dir), codebook(spark, sf_dir), use_freq=False).select(F.round("error", 6).alias("error"))


_DIMS = "(SELECT v[1] AS x, 0 AS dim FROM pts UNION ALL SELECT v[2], 1 FROM pts UNION ALL SELECT v[3], 2 FROM pts)"


@query(f"SELECT dim, round(var_pop(x), 6) AS variance, quantile_disc(x, 0.5) AS median, min(x) AS low, max(x) AS high FROM {_DIMS} GROUP BY dim")
def agg14_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.dimension_statistics(points(spark, sf_dir))
    return out.select("dim", F.round("variance", 6).alias("variance"), "median", "low", "high")


@query("SELECT cid, sum(freq)::BIGINT AS n, sum(v[1] * freq)::DOUBLE AS s0 FROM (SELECT CASE WHEN id % 3 = 0 THEN 5 ELSE cid END AS cid, v, freq FROM asg) GROUP BY cid")
def agg1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = assigned(spark, sf_dir)
    new = own.withColumn("cid", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("cid")))
    out = R.with_changes(R.counters(own), R.counter_changes(own, new))
    return out.select("cid", "n", F.col("s")[0].cast("double").alias("s0"))


_MOVED = "(SELECT cid, CASE WHEN cid = 3 THEN [25, 5, 4]::BIGINT[] ELSE c END AS c FROM cb)"


@query(f"SELECT id, cid, d2 FROM (SELECT p.id, b.cid, {_d2('p.v', 'b.c')} AS d2, row_number() OVER (PARTITION BY p.id ORDER BY {_d2('p.v', 'b.c')}) AS r FROM pts p, {_MOVED} b) WHERE r = 1 AND 1 = 0 UNION ALL SELECT id, NULL, min({_d2('p.v', 'b.c')}) FROM pts p, {_MOVED} b GROUP BY id")
def rs4_local_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, cb = assigned(spark, sf_dir), codebook(spark, sf_dir)
    new = cb.withColumn("c", F.when(F.col("cid") == 3, F.array(*(F.lit(x).cast("bigint") for x in (25, 5, 4)))).otherwise(F.col("c")))
    return R.local_repartition(own, new, 3).select("id", F.lit(None).cast("int").alias("cid"), "d2")


_COST = "CASE WHEN {0} * {1} = 0 THEN 0 ELSE (2 * {0}::HUGEINT * {1} * ({2}) + {0} + {1}) // (2 * ({0} + {1})) END"
_SECOND = f"sec AS MATERIALIZED (SELECT a.id, a.v, a.freq, a.cid, a.d2, n.cid AS cid2, {_COST.format('a.freq', 'n.freq', _d2('a.v', 'n.c'))} AS cost FROM asg a JOIN cen n ON n.cid <> a.cid QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY cost, n.cid) = 1)"


@query(f", own AS (SELECT a.id, a.v, a.freq, a.cid, {_d2('a.v', 'cen.c')} AS d2 FROM asg a JOIN cen ON cen.cid = a.cid), {_SECOND.replace('FROM asg a', 'FROM own a')} SELECT c.cid, coalesce(sum(s.freq), 0)::BIGINT AS n, coalesce(sum(s.cost - s.d2 * s.freq), 0)::DOUBLE AS cost FROM cen c LEFT JOIN sec s ON s.cid = c.cid GROUP BY c.cid")
def ish2_removal_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removal(spark, sf_dir, False)


def _removal(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    own, _, cen = _cents(spark, sf_dir)
    near = R.with_centroid(own, cen).select("id", "v", "freq", "cid", V.squared(F.col("v"), F.col("c")).alias("d2"))
    return R.removal_costs(near, cen, exact).withColumn("cost", F.col("cost").cast("double"))


_SUMS = ", ".join(f"sum(v[{i}] * freq)::BIGINT AS s{i}" for i in (1, 2, 3))
_HALF = "[" + ", ".join(f"(2 * s{i} + w) // (2 * w)" for i in (1, 2, 3)) + "]::BIGINT[]"


@query(f""", own AS (SELECT a.id, a.v, a.freq, a.cid, {_d2('a.v', 'cen.c')} AS d2 FROM asg a JOIN cen ON cen.cid = a.cid), {_SECOND.replace('FROM asg a', 'FROM own a')},
    g AS (SELECT cid, cid2, {_HALF} AS m, w FROM (SELECT cid, cid2, sum(freq)::BIGINT AS w, {_SUMS} FROM sec GROUP BY cid, cid2)),
    i AS (SELECT s.cid, s.cid2, sum(({_d2('s.v', 'g.m')}) * s.freq) - sum(s.d2 * s.freq) AS e FROM sec s JOIN g ON g.cid = s.cid AND g.cid2 = s.cid2 GROUP BY s.cid, s.cid2)
    SELECT c.cid, coalesce(sum(g.w), 0)::BIGINT AS n, coalesce(sum(i.e + {_COST.format('g.w', 't.freq', _d2('g.m', 't.c'))}), 0)::DOUBLE AS cost
    FROM cen c LEFT JOIN g ON g.cid = c.cid LEFT JOIN i ON i.cid = g.cid AND i.cid2 = g.cid2 LEFT JOIN cen t ON t.cid = g.cid2 GROUP BY c.cid""")
def ish2_exact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removal(spark, sf_dir, True)


# vectors


_CLIP = lambda s: f"(least(greatest({s}, 1000), 999000) / 1000000.0::DOUBLE)"


@query("SELECT id, floor((" + " + ".join(f"-log2(CASE WHEN v[{i}] > {x} THEN {_CLIP(s)} ELSE 1.0 - {_CLIP(s)} END)" for i, x, s in ((1, 25, 300000), (2, 5, 10), (3, 4, 999999))) + ") * 1000000 + 0.5)::BIGINT AS entropy FROM pts")
def dst3_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = F.array(*(F.lit(x).cast("bigint") for x in (300_000, 10, 999_999)))
    return points(spark, sf_dir).select("id", V.entropy(_bits(), shares).alias("entropy"))


@query(f"SELECT id, CASE WHEN {_d2('v', '[3, 5, 7]')} <= 400 THEN {_d2('v', '[3, 5, 7]')} END AS d2 FROM pts")
def dst7_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(*(F.lit(x).cast("bigint") for x in (3, 5, 7)))
    return points(spark, sf_dir).select("id", V.partial_squared(F.col("v"), c, F.lit(400)).alias("d2"))


@query("""SELECT vec_id AS id, round(s, 6) AS length, round(x1 / s, 9) AS first, round(x1 + 2 * x2, 6) AS plus, round(lo, 6) AS least, round(d, 6) AS distance FROM (
    SELECT vec_id, list_sum(list_transform(e, lambda x: abs(x))) AS s, e[1] AS x1, e[2] AS x2, list_min(e) AS lo, sqrt(list_sum(list_transform(e, lambda x: (x - 0.5) * (x - 0.5)))) AS d
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL))""")
def vec8_float_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    x, half = F.col("x"), V.filled(64, 0.5)
    moved = V.plus(x, V.scale(F.concat(F.slice(x, 2, 63), F.slice(x, 1, 1)), F.lit(2.0)))
    return rows.select(F.col("vec_id").alias("id"), F.round(V.length(x), 6).alias("length"), F.round(V.normalised(x)[0], 9).alias("first"), F.round(moved[0], 6).alias("plus"), F.round(V.ordered(x)[0], 6).alias("least"), F.round(V.distance(x, half), 6).alias("distance"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("x"))


@query("""SELECT dim, round(avg(x), 6) AS mean, min(x) AS low, max(x) AS high, count(DISTINCT x) AS kinds FROM (
    SELECT 0 AS dim, p_size::DOUBLE AS x FROM part UNION ALL SELECT 1, p_retailprice::DOUBLE FROM part) GROUP BY dim""")
def vec9_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sets.column_profile(_orders(spark, sf_dir))
    return out.select("dim", F.round("mean", 6).alias("mean"), "low", "high", "kinds")


@query("SELECT p_size::DOUBLE AS value, count(*) AS n FROM part GROUP BY 1")
def vec9_unique_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.unique_values(sets.sub_dimensions(_orders(spark, sf_dir), [0]), 0)


@query("SELECT p_retailprice::DOUBLE AS value FROM part ORDER BY p_retailprice, p_partkey LIMIT 1 OFFSET 100")
def vec9_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.nth(_orders(spark, sf_dir), 1, 100)


@query("SELECT o_orderkey AS id, format('{:,}', floor(o_totalprice)::BIGINT) AS text, round(o_totalprice::DOUBLE - 7.5 * floor(o_totalprice::DOUBLE / 7.5), 6) AS rest FROM orders")
def vec12_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), V.grouped_digits(F.floor(price).cast("bigint")).alias("text"), F.round(V.remainder(price, F.lit(7.5)), 6).alias("rest"))


# order, codebooks, partitions


@query("SELECT id, row_number() OVER (ORDER BY ('0x' || substr(md5('s2|' || id), 1, 13))::BIGINT, id) - 1 AS place FROM pts")
def flt4_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shuffled(points(spark, sf_dir), "s2").select("id", "place")


def _sorted(by: str, descending: bool, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sets.sorted_codebook(_cents(spark, sf_dir)[2], by, descending).select("cid", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"), F.col("c")[2].alias("c2"), "freq")

    run.__name__ = f"srt2_{by}_{'desc' if descending else 'asc'}"
    query(f"SELECT (row_number() OVER (ORDER BY {sql}, cid) - 1)::INT AS cid, c[1] AS c0, c[2] AS c1, c[3] AS c2, freq FROM cen")(run)


for _by, _sql in (("data", "c"), ("freq", "freq"), ("mean", "floor((c[1] + c[2] + c[3]) / 3.0 + 0.5)")):
    _sorted(_by, False, _sql)
    _sorted(_by, True, f"{_sql} DESC")


_CENTRE = "(SELECT [(2 * sum(v[1] * freq) + sum(freq)) // (2 * sum(freq)), (2 * sum(v[2] * freq) + sum(freq)) // (2 * sum(freq)), (2 * sum(v[3] * freq) + sum(freq)) // (2 * sum(freq))]::BIGINT[] AS m FROM pts)"


@query(f"SELECT (row_number() OVER (ORDER BY {_d2('c', 'm')}, cid) - 1)::INT AS cid, c[1] AS c0, c[2] AS c1, freq FROM cen, {_CENTRE}")
def srt3_by_centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sets.by_centroid_distance(_cents(spark, sf_dir)[2], R.global_centroid(points(spark, sf_dir)))
    return out.select("cid", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"), "freq")


@query(f"SELECT a, rank::INT AS rank, b, d2 FROM (SELECT x.cid AS a, y.cid AS b, {_d2('x.c', 'y.c')} AS d2, row_number() OVER (PARTITION BY x.cid ORDER BY {_d2('x.c', 'y.c')}, y.cid) AS rank FROM cen x JOIN cen y ON x.cid <> y.cid)")
def srt9_order_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.order_matrix(_cents(spark, sf_dir)[2])


@query("SELECT CASE WHEN cid = 16 THEN 4 ELSE cid END::INT AS cid, c0 FROM (SELECT cid, c[1] AS c0 FROM cb UNION ALL SELECT 16, 25) WHERE cid <> 4")
def set2_add_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = sets.add_vector(codebook(spark, sf_dir), F.array(*(F.lit(x).cast("bigint") for x in (25, 5, 4))))
    return sets.remove_vector(more, 4).select("cid", F.col("c")[0].alias("c0"))


@query("SELECT CASE WHEN id = 10000 THEN 7 ELSE cid END::INT AS cid, count(*) AS n FROM asg GROUP BY 1")
def set4_move_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.moved_item(assigned(spark, sf_dir), 10_000, 7).groupBy("cid").agg(F.count("*").alias("n"))


@query("SELECT id, (row_number() OVER (ORDER BY id) - 1)::INT AS own, 0 AS first FROM pts")
def set5_all_in_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sets.all_in_own(points(spark, sf_dir)).withColumnRenamed("cid", "own")
    return sets.all_in_first(own).select("id", "own", F.col("cid").alias("first"))


@query("SELECT least(cid, 11)::INT AS cid, count(*) AS n FROM asg GROUP BY 1")
def set6_fewer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.resized(assigned(spark, sf_dir), 12).groupBy("cid").agg(F.count("*").alias("n"))


@query("""SELECT cid, coalesce(f.v, c)[1] AS c0, coalesce(f.v, c)[2] AS c1 FROM (
    SELECT d.cid, d.c, CASE WHEN d.cid < m.last THEN row_number() OVER (PARTITION BY d.cid < m.last ORDER BY d.cid) END AS r FROM (SELECT cid, c FROM cb UNION ALL SELECT cid + 16, c FROM cb) d JOIN (SELECT c, max(cid) AS last FROM (SELECT cid, c FROM cb UNION ALL SELECT cid + 16, c FROM cb) GROUP BY c) m ON m.c = d.c) x
    LEFT JOIN (SELECT v, row_number() OVER (ORDER BY id) AS r FROM pts WHERE v NOT IN (SELECT c FROM cb)) f ON f.r = x.r""")
def set7_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cb = codebook(spark, sf_dir)
    out = sets.replace_duplicates(R.union_codebooks(cb, cb, K), points(spark, sf_dir))
    return out.select("cid", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@query(f"SELECT cb.cid, {_d2('cb.c', 'cen.c')} > 0 AS moved, {_d2('cb.c', 'cen.c')} AS d2 FROM cb JOIN cen ON cb.cid = cen.cid")
def km3_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cb, cen = _cents(spark, sf_dir)
    return sets.moved_centroids(cb, cen)


# files: written to the shared folder and read back


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share; of this machine only where the session runs on it alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "/tmp/checkpoints"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT cid::BIGINT AS id, c[1] AS c0, c[2] AS c1, c[3] AS c2, freq FROM cen")
def snk1_codebook_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "codebook") + ".cb"
    files.write_codebook(_cents(spark, sf_dir)[2], path, files.with_method("", "test"))
    return flat(files.read_codebook(spark, path).select("id", "v", "freq"), "v", "c")


@query(f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, {FLAT}, freq FROM pts")
def snk1_training_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "training") + ".ts"
    files.write_training_set(points(spark, sf_dir), path)
    return flat(files.read_vectors(spark, path))


@query("SELECT v[1] AS v0, v[2] AS v1, v[3] AS v2, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def snk2_text_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    files.write_text(points(spark, sf_dir), path)
    high = points(spark, sf_dir).agg(F.max(F.array_max("v"))).first()[0]
    low = points(spark, sf_dir).agg(F.min(F.array_min("v"))).first()[0]
    rows, _, _ = files.read_text(spark, path, high - low)  # a step of the scale is one
    return flat(rows.select(F.transform("v", lambda x: x + low).alias("v"))).groupBy("v0", "v1", "v2").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS row, cid FROM asg")
def snk4_partition_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "partition") + ".pa"
    files.write_partition(assigned(spark, sf_dir), K, path)
    return files.read_partition(spark, path)


@query("SELECT cid, c[1] AS c0, c[2] AS c1, c[3] AS c2, freq FROM cen")
def src13_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, own = scratch(spark, "solution"), assigned(spark, sf_dir)
    files.write_partition(own, K, f"{path}.pa")
    return flat(files.read_solution(spark, path, points(spark, sf_dir), K)[0].select("cid", "c", "freq"), "c", "c")


@query("SELECT freq::VARCHAR AS value, count(*) AS n FROM pts GROUP BY 1")
def snk5_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "list")
    files.write_list(points(spark, sf_dir), "freq", path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


_NEAR = f"SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY floor(sqrt({_d2('a.v', 'b.v')})), b.id)::INT AS rank, floor(sqrt({_d2('a.v', 'b.v')}))::DOUBLE AS weight FROM pts a JOIN pts b ON a.id <> b.id QUALIFY rank <= 3"


@query(_NEAR)
def snk6_graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graphs import knn_graph

    path, own = scratch(spark, "graph"), points(spark, sf_dir)
    files.write_graph(knn_graph(own, 3), path, own.count())
    return files.read_graph(spark, path)


@query(f", e AS (SELECT src, dst, rank FROM ({_NEAR})), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM pts) SELECT n.i AS src, e.dst, e.rank FROM e JOIN n ON n.id = e.src")
def src11_graph_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graphs import knn_graph

    path, own = scratch(spark, "graph") + ".gr", points(spark, sf_dir)
    files.write_graph_v1(own, knn_graph(own, 3), path)
    return files.read_graph_v1(spark, path)[1]


@query("SELECT 3 AS dim, count(*) AS rows, count(*) AS complete, min(list_min(v))::DOUBLE AS low, max(list_max(v))::DOUBLE AS high, false AS last_is_freq FROM pts")
def src4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "profile")
    files.write_text(points(spark, sf_dir), path)
    return files.profile(spark, path).select("dim", "rows", "complete", "low", "high", "last_is_freq")


@query("SELECT count(*) FILTER (p_partkey % 10 <> 0) AS kept, count(*) FILTER (p_partkey % 10 = 0) AS dropped, round(sum(CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END)::DOUBLE, 2) AS price FROM part")
def src6_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, parts = scratch(spark, "floats"), spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat_ws(" ", "p_size", F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice").cast("string")))
    parts.select(line.alias("value")).write.text(path)
    rows, dropped = files.read_floats(spark, path)
    return rows.agg(F.count("*").alias("kept"), F.lit(dropped).cast("bigint").alias("dropped"), F.round(F.sum(F.col("x")[1]), 2).alias("price"))


@query("SELECT 'codebook' AS kind, 16::BIGINT AS size UNION ALL SELECT 'partition', count(*) FROM pts UNION ALL SELECT 'training', count(*) FROM pts")
def src10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _, cen = _cents(spark, sf_dir)
    path, found = scratch(spark, "kinds"), []
    files.write_codebook(cen, f"{path}-a.cb")
    files.write_partition(own, K, f"{path}-b.pa")
    files.write_training_set(points(spark, sf_dir), f"{path}-c.ts")
    for name in "abc":
        at, kind = files.find(spark, f"{path}-{name}")
        size = (files.read_partition if kind == "partition" else files.read_codebook)(spark, at).count()
        found.append((kind, size))
    return spark.createDataFrame(found, "kind string, size long")


@query("SELECT c[1] AS v0, c[2] AS v1, c[3] AS v2, 2::BIGINT AS n FROM cen")
def snk3_like_the_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    cen, path = _cents(spark, sf_dir)[2], scratch(spark, "like")
    text, binary = files.write_like(cen, f"{path}-t", "in.txt"), files.write_like(cen, f"{path}-b", "in.ts")
    rows = files.raw_vectors(spark, text).select(F.transform("x", lambda x: x.cast("bigint")).alias("v"))
    both = rows.union(files.read_codebook(spark, binary).select("v"))
    return flat(both).groupBy("v0", "v1", "v2").agg(F.count("*").alias("n"))
