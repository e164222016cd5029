"""Operators do all of their input: each test fails on a form that looked at a part of it."""

import time

import numpy as np
import pytest

import __spark_entry__ as entry
from clustral.operators import graphs as G
from clustral.operators import kmeans as M
from clustral.operators import relational as R
from clustral.operators import validity as VA
from clustral.plans.engine import Local, Spark, nearest


def test_every_point_is_unrolled(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    got = entry.queries()["vec10_unrolled"](spark, "/root/testdata/sf0.01").agg({"copies": "sum", "id": "count"}).first()
    assert got["sum(copies)"] == rows and got["count(id)"] == 4944


def test_s_dbw_takes_every_pair(spark):
    rng = np.random.default_rng(5)
    c = np.sort(rng.choice(4000, 400, replace=False))
    of = np.concatenate([np.arange(400), np.arange(400)])
    x = c[of] + rng.integers(-6, 7, 800)
    cb = spark.createDataFrame([(i, [int(v)], 1) for i, v in enumerate(c)], "cid int, c array<bigint>, freq long")
    own = spark.createDataFrame([(i, [int(v)], 1, int(k), 0) for i, (v, k) in enumerate(zip(x, of, strict=True))], "id long, v array<bigint>, freq long, cid int, d2 long")
    var = np.array([x[of == k].var() for k in range(400)])
    sd, means = np.sqrt(var.sum()) / 400, []
    inside = lambda at, k: int((np.abs(x[(of == k[0]) | (of == k[1])] - at) <= sd).sum())
    for a in range(400):
        for b in range(a + 1, 400):
            top = max(inside(c[a], (a, b)), inside(c[b], (a, b)))
            means.append(inside((c[a] + c[b]) // 2, (a, b)) / top if top else 0)
    assert VA.s_dbw(own, cb).first()[0] == pytest.approx(var.mean() / x.var() + np.mean(means))


def test_no_centroid_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(R, "LARGEST", 3)
    cb = spark.createDataFrame([(i, [i], 1) for i in range(6)], "cid int, c array<bigint>, freq long")
    assert R.distance_matrix(cb).count() == 15
    assert R.with_centroid(cb.select("cid"), cb).count() == 6


def test_density_peaks_of_all_points(spark):
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 300, (2600, 2)), axis=0)[:2500]
    local = Local(x)
    root = np.floor(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    near = np.sort(root, 1)[:, 1:51]
    density = 50 / (1 / (near[:, -1] + 1e-20) + near.sum(1))
    order = np.argsort(-density, kind="stable")
    delta = np.full(2500, np.inf)
    for r in range(1, 2500):
        delta[order[r]] = root[order[r], order[:r]].min()
    want = x[np.argsort(-(delta * density), kind="stable")[:6]].tolist()
    assert M.density_init(local, 6).tolist() == want
    rows = spark.createDataFrame([(i, [int(a) for a in v], 1) for i, v in enumerate(x[:200])], "id long, v array<bigint>, freq long")
    assert M.density_init(Spark(rows), 6).tolist() == M.density_init(Local(x[:200]), 6).tolist()


def _ordered(v, ids, dim):
    order = np.lexsort((ids, v[:, dim]))
    return v[order, dim], ids[order]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Points of two dimensions: one of few values, most of them equal, and one of many."""
    rng = np.random.default_rng(11)
    n = 30_000
    v = np.stack([np.where(rng.random(n) < 0.5, 7, rng.integers(-40, 2000, n)), rng.integers(-(10**12), 10**12, n)], 1)
    ids = rng.permutation(10 * n)[:n]
    path = str(tmp_path_factory.mktemp("tied") / "points")
    spark.createDataFrame([(i, x, 1) for i, x in zip(ids.tolist(), v.tolist(), strict=True)], "id long, v array<bigint>, freq long").write.parquet(path)
    return v, ids, spark.read.parquet(path)


def test_density_of_the_nearest_by_ranges(spark, tied):
    v, ids, df = tied
    for k in (1, 3, 10):
        want = dict.fromkeys(ids.tolist(), 0.0)
        for dim in (0, 1):
            x, own = _ordered(v, ids, dim)
            for i in range(len(x)):
                near = np.abs(np.concatenate([x[max(0, i - k) : i], x[i + 1 : i + 1 + k]]) - x[i])
                near.sort()
                want[int(own[i])] += k / (near[:k].sum() + 1e-20)
        assert {r["id"]: r["density"] for r in G.nearest_axis_density(df, k).collect()} == want


def test_density_in_windows_by_ranges(spark, tied):
    v, ids, df = tied
    for window in (2, 10):
        want, half = dict.fromkeys(ids.tolist(), 0.0), window // 2
        for dim in (0, 1):
            x, own = _ordered(v, ids, dim)
            sums = {}
            for i in range(len(x)):
                near = np.abs(x[max(0, i - half) : i + 1 + half] - x[i])
                sums[int(own[i])] = int(near.sum())
                want[int(own[i])] += (len(near) - 1) / (near.sum() + 1e-20)
            assert {r["id"]: r["sum"] for r in G.sliding_density(df, dim, window).collect()} == sums
        assert {r["id"]: r["density"] for r in G.axis_density(df, window).collect()} == want


def test_rows_are_dealt_without_a_walk_through_all_edges(spark, tied):
    df = G.nearest_axis_density(tied[2], 10)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Window" not in plan and "ReusedExchange" in plan


def test_equal_coordinates_are_dealt_out():
    edge_x, edge_id = np.array([3, 7, 7, 7, 8, 9, 9]), np.array([5, 1, 4, 9, 2, 2, 6])
    rng = np.random.default_rng(12)
    x, ids = rng.integers(0, 12, 3000), rng.integers(0, 12, 3000)
    want = [sum((a, b) < (p, q) for a, b in zip(edge_x.tolist(), edge_id.tolist(), strict=True)) for p, q in zip(x.tolist(), ids.tolist(), strict=True)]
    assert G._parts(x, ids, edge_x, edge_id).tolist() == want


def _one_by_one(points, k, trials, iterations=2):
    """Random swap as it is defined, by full searches."""
    best = M.lloyd(points, M.random_init(points, k), iterations)
    history, pool = [best.sse], points.sample(min(points.size, 1000), "0/swap")
    for t in range(trials):
        c = best.codebook.copy()
        if not (c == pool[t]).all(1).any():
            c[M.drawn(f"0/victim/{t}", k)] = pool[t]
            s = M.lloyd(points, c, iterations)
            best = s if s.sse < best.sse else best
        history.append(best.sse)
    return best, history


@pytest.mark.parametrize(("low", "high"), [(0, 60), (-30_000, 40_000), (0, 1 << 30)])
def test_swaps_together_are_swaps_one_by_one(low, high):
    rng = np.random.default_rng(8)
    local = Local(rng.integers(low, high, (700, 3)), rng.integers(1, 9, 700))
    for k, iterations in ((1, 2), (5, 2), (9, 1), (5, 0)):
        got, (want, history) = M.random_swap(local, k, 60, iterations), _one_by_one(local, k, 60, iterations)
        assert (got.codebook.tolist(), got.n.tolist(), got.sse, got.history) == (want.codebook.tolist(), want.n.tolist(), want.sse, history)


def test_swaps_take_few_jobs(spark):
    rng = np.random.default_rng(9)
    x, w = rng.integers(0, 1000, (400, 4)), rng.integers(1, 5, 400)
    far = Spark(spark.createDataFrame([(i, v, int(f)) for i, (v, f) in enumerate(zip(x.tolist(), w, strict=True))], "id long, v array<bigint>, freq long").cache())
    spark.sparkContext.setJobGroup("swaps", "swaps")
    got = M.random_swap(far, 4, 60)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("swaps")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want, history = _one_by_one(Local(x, w), 4, 60)
    assert (got.codebook.tolist(), got.n.tolist(), got.history) == (want.codebook.tolist(), want.n.tolist(), history)
    assert len(jobs) < 120 and far.blocks is None  # three passes a trial are more


def test_swaps_cost_less_than_searches():
    local = Local(np.random.default_rng(10).integers(0, 65_536, (8000, 64)))
    c = local.x[:10]
    took = []
    for f in (lambda: [nearest(local.x, c) for _ in range(30)], lambda: M.random_swap(local, 10, 100)):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    assert took[1] < took[0] * 5  # 300 assignments in less than the time of 150
