import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clustral.operators import genetic as GA
from clustral.operators import graphs as G
from clustral.operators import kmeans as M
from clustral.operators import merging as P
from clustral.operators import relational as R
from clustral.operators import search, sets, splitting
from clustral.operators import validity as VA
from clustral.plans.engine import Local, Spark, distances, nearest, of


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 60000, (8, 2))
    return Local(np.clip(np.concatenate([m + rng.normal(0, 600, (60, 2)) for m in c]), 0, 65535).astype(int)), c


def frame(spark, local):
    rows = [(int(i), [int(x) for x in v], int(w)) for i, v, w in zip(local.ids, local.x, local.w, strict=True)]
    return spark.createDataFrame(rows, "id long, v array<bigint>, freq long")


def test_small_cases(spark):
    points = spark.createDataFrame([(0, [0], 1), (1, [10], 1), (2, [5], 1)], "id long, v array<bigint>, freq long")
    cb = spark.createDataFrame([(0, [0], 1), (1, [10], 1)], "cid int, c array<bigint>, freq long")
    first = {r["id"]: r["cid"] for r in R.assign(points, cb).collect()}
    assert first == {0: 0, 1: 1, 2: 0}
    again = R.assign(R.assign(points, cb).withColumn("cid", R.F.lit(1)), cb, incumbent="cid")
    assert {r["id"]: r["cid"] for r in again.collect()}[2] == 1
    weighted = spark.createDataFrame([(0, [0], 3), (1, [4], 1)], "id long, v array<bigint>, freq long")
    far = spark.createDataFrame([(0, [0], 1), (1, [100], 1)], "cid int, c array<bigint>, freq long")
    got = {r["cid"]: (list(r["c"]), r["freq"]) for r in R.centroids(R.assign(weighted, far), far).collect()}
    assert got == {0: ([1], 4), 1: ([100], 0)}


def test_engines_agree(spark, blobs):
    local, c = blobs
    both = local.statistics(c), Spark(frame(spark, local)).statistics(c)
    assert both[0].sse == both[1].sse and (both[0].n == both[1].n).all() and (both[0].sums == both[1].sums).all()
    assert (Local(local.x).sample(7, "s") == Spark(frame(spark, local)).sample(7, "s")).all()
    assert M.lloyd(local, c).sse == M.lloyd(Spark(frame(spark, local)), c).sse
    assert isinstance(of(frame(spark, local)), Local) and isinstance(of(frame(spark, local), 10), Spark)
    assert of(frame(spark, local)).statistics(c).sse == both[0].sse


def test_every_init_is_the_same_on_both_engines(spark):
    rng = np.random.default_rng(9)
    x = np.unique(np.concatenate([rng.integers(0, 60, (90, 3)), rng.integers(200, 300, (60, 3))]), axis=0)
    local = Local(x, rng.integers(1, 9, len(x)), np.sort(rng.choice(10**6, len(x), replace=False)))
    far = Spark(frame(spark, local).repartition(3).cache())
    for name, init in M.INITS.items():
        more = {"subsets": 2} if name == "bradley" else {}
        one, two = init(local, 3, **more), init(far, 3, **more)
        assert one.shape == (3, 3) and one.tolist() == two.tolist(), name
    for density, delta in (("axis", "plain"), ("window", "gamma"), ("random", "density")):
        assert M.density_init(local, 5, density=density, delta=delta).tolist() == M.density_init(far, 5, density=density, delta=delta).tolist(), (density, delta)
    assert M.projection_init(local, 5, True).tolist() == M.projection_init(far, 5, True).tolist()
    assert M.plus_plus_init(local, 3, tries=2).tolist() == M.plus_plus_init(far, 3, tries=2).tolist()
    for choice in ("size", "third", "furthest", "optimal"):
        assert splitting.split(local, x[:1], 3, choice, tune=1).codebook.tolist() == splitting.split(far, x[:1], 3, choice, tune=1).codebook.tolist(), choice
    for axis, pivot in zip(splitting.AXES, ("optimal", "moments", "lloyd"), strict=True):
        one, two = (splitting.split(e, x[:1], 2, "error", axis, 0, pivot=pivot) for e in (local, far))
        assert one.codebook.tolist() == two.codebook.tolist() and one.sse == two.sse, (axis, pivot)
    c = x[:6]
    assert P.removal_costs(local, c, local.statistics(c).n, "exact").tolist() == P.removal_costs(far, c, far.statistics(c).n, "exact").tolist()
    assert M.medoids(local, c).tolist() == M.medoids(far, c).tolist()
    assert M.random_swap(local, 4, 3).codebook.tolist() == M.random_swap(far, 4, 3).codebook.tolist()
    assert local.labelled("a", 3).sums.tolist() == far.labelled("a", 3).sums.tolist() and local.top() == far.top()


def test_sums_beyond_64_bits(spark):
    x = np.array([[0] * 64] * 4 + [[214_748_364] * 64] * 4)
    c = np.array([[0] * 64])
    want = 4 * 64 * 214_748_364**2
    local = Local(x)
    assert local.statistics(c).sse == want == Spark(frame(spark, local)).statistics(c).sse and want > 2**63
    assert local.statistics(c).centroids(c)[0][0] == 107_374_182
    heavy = Local(x, np.full(8, 10**9))
    assert heavy.statistics(c).sse == want * 10**9 == Spark(frame(spark, heavy)).statistics(c).sse
    assert heavy.worst(c, 1).tolist() == Spark(frame(spark, heavy)).worst(c, 1).tolist() == x[4:5].tolist()


def test_inits(blobs):
    for name, init in M.INITS.items():
        if name not in ("density", "hybrid"):  # these need a session
            assert init(blobs[0], 8).shape == (8, 2), name
    with pytest.raises(ValueError):
        M.random_init(Local(np.zeros((2, 1), int)), 3)
    few = Local(np.array([[0], [1], [10], [11]]))
    assert M.lloyd(few, M.exhaustive_init(few, 2)).sse == min(few.statistics(np.array([[a], [b]])).sse for a in range(12) for b in range(12))


def test_searches_find_the_blobs(blobs):
    local, c = blobs
    best = M.lloyd(local, c).sse
    assert M.random_swap(local, 8, 150).sse <= best * 1.01
    assert splitting.split(local, local.x[:1], 8).sse <= best * 1.01
    for rule in splitting.RULES:
        assert len(splitting.split(local, local.x[:1], 8, "error", rule=rule).codebook) == 8
    for pivot in splitting.PIVOTS:
        assert splitting.split(local, local.x[:1], 8, "error", pivot=pivot).sse <= best * 60
    for method in GA.CROSSINGS:
        assert GA.genetic(local, 8, 2, 5, method).sse <= GA.genetic(local, 8, 1, 2, "copy").sse * 1.01
    for selection in GA.SELECTIONS:
        assert len(GA.genetic(local, 8, 2, 5, selection=selection).codebook) == 8
    for first in GA.FIRST:
        run = GA.genetic(local, 8, 3, 5, first=first, tuned="best", noise=30)
        assert run.history == sorted(run.history, reverse=True) and run.sse == run.history[-1]
    for order in splitting.ORDERS:
        assert splitting.split_and_merge(local, M.random_init(local, 8), 8, order=order).sse <= best * 5
    assert M.lloyd(local, P.pnn(local.x, local.w, 8)[0]).sse <= best * 1.01
    assert M.lloyd(local, P.pnn(local.x, local.w, 8, search="fast")[0]).sse <= best * 4
    assert P.pnn_of_points(local, 8, 64, tune=1, counters=True).sse <= best * 4
    for how in ("second", "simple", "exact"):
        assert P.shrink(local, M.random_init(local, 16), 8, how).sse <= best * 4
    for policy in P.POLICIES:
        assert M.lloyd(local, P.shrink(local, M.random_init(local, 16), 8, policy=policy).codebook).sse <= best * 4
    assert M.centroid_index(M.lloyd(local, c).codebook, c) == 0
    run = M.random_swap(local, 8, 60, reference=c)
    assert len(run.index) == 60 and sum(M.success_histogram(run.history)) == sum(b < a for a, b in zip(run.history, run.history[1:]))
    for kind in ("uniform", "gaussian"):
        noisy = M.Annealing(50.0, 100.0, False, kind).noisy(c, 65535)
        assert noisy.min() >= 0 and noisy.max() <= 65535 and (noisy != c).any()
        assert len(M.anneal(local, c, M.Annealing(50.0, 10.0, True, kind), 3, 65535).codebook) == 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=40), st.integers(2, 6), st.integers(0, 10**6))
def test_search_strategies_agree(points, k, seed):
    x = np.array(points)
    rng = np.random.default_rng(seed)
    old = rng.integers(0, 13, (k, 2))
    new = old.copy()
    new[rng.integers(0, k, 2)] = rng.integers(0, 13, (2, 2))
    of = nearest(x, old)[0]
    want = nearest(x, new)[:2]
    for how in search.SEARCHES:
        cid, d2, looked = search.reassign(x, new, old, of, how)
        assert (cid == want[0]).all() and (d2 == want[1]).all(), how
    local = Local(x)
    runs = [M.lloyd(local, old, search=how) for how in search.SEARCHES]
    assert all((r.codebook == runs[0].codebook).all() and r.history == runs[0].history for r in runs)


def test_strategies_look_at_fewer_pairs(blobs):
    local, c = blobs
    old, new = c + 300, c + 300
    new = new.copy()
    new[0] += 40
    of = nearest(local.x, old)[0]
    full = search.reassign(local.x, new, old, of, "full")[2]
    assert all(search.reassign(local.x, new, old, of, how)[2] < full / 2 for how in ("local", "tie", "local_tie", "mps", "local_mps"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=3, max_size=14), st.integers(0, 10**6))
def test_pnn_searches_agree(points, seed):
    c = np.array(points)
    n = np.random.default_rng(seed).integers(0, 5, len(c))
    want = P.pnn(c, n, 2)
    for how in ("trivial", "kurita"):
        got = P.pnn(c, n, 2, search=how)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    one = np.maximum(n, 1)
    a, b = P.pnn(c, one, len(c) - 1), P.pnn(c, one, len(c) - 1, search="lazy")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and P.pnn(c, one, 2, search="lazy")[1].sum() == one.sum()


def test_pnn_merges_the_cheapest():
    c, n = P.pnn(np.array([[0], [2], [10]]), np.array([1, 1, 4]), 2)
    assert c.tolist() == [[1], [10]] and n.tolist() == [2, 4]
    assert P.pnn(np.array([[0], [2], [10]]), np.array([1, 1, 4]), 2, cost="amount", error=np.array([0, 100, 0]))[0].tolist() == [[8], [2]]


def test_solutions(blobs):
    local, c = blobs
    assert (GA.from_bits(GA.to_bits(c, 16), 16, 2) == c).all()
    with pytest.raises(ValueError):
        GA.to_bits(c, 3)
    s = M.of_codebook(local, c)
    assert GA.optimal(local, s).sse <= s.sse and GA.with_vector(local, s, 0, c[1]).sse > s.sse


def test_selections():
    assert GA.select([1, 2, 3], 3) == [(0, 1), (0, 2), (1, 2)] and GA.select([1, 2, 3], 3, "elitist2") == [(0, 0), (0, 1), (1, 1)]
    assert GA.select([1, 2, 3], 3, "zigzag") == [(0, 1), (1, 2), (0, 2)]
    pairs = GA.select([0, 10**9, 10**9], 50, "roulette")
    assert all(a != b for a, b in pairs) and sum(0 in p for p in pairs) == 50
    twins = GA.without_twins(np.array([[1], [1], [2]]), np.array([[1], [5]]))
    assert twins.tolist() == [[5], [1], [2]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=30), st.integers(1, 5))
def test_nearest_is_the_lowest_of_the_least(points, k):
    x = np.array(points)
    c = x[:k]
    of, d2, _ = nearest(x, c)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (of == full.argmin(1)).all() and (d2 == full.min(1)).all()
    big = distances(x * 10**8, c * 10**8)
    assert (big == full * 10**16).all()


def test_validity_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x, of = rng.integers(0, 40, (30, 2)), rng.integers(0, 3, 30)
    df = spark.createDataFrame([(i, [int(a) for a in v], 1, int(o)) for i, (v, o) in enumerate(zip(x, of, strict=True))], "id long, v array<bigint>, freq long, cid int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(30):
        a = d[i][(of == of[i]) & (np.arange(30) != i)].mean()
        b = min(d[i][of == j].mean() for j in range(3) if j != of[i])
        s.append((b - a) / max(a, b))
    assert VA.silhouette(df, 8).first()[0] == pytest.approx(np.mean(s))
    inside = max(d[i, j] for i in range(30) for j in range(30) if of[i] == of[j])
    between = min(d[i, j] for i in range(30) for j in range(30) if of[i] != of[j])
    assert VA.dunn(df, 8).first()[0] == pytest.approx(between**2 / inside**2)
    same = VA.external(df.withColumn("other", R.F.col("cid") + 5), "cid", "other").first()
    assert same["rand"] == 1 and same["adjusted_rand"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)


def test_graphs_and_hull(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, (60, 2))
    df = spark.createDataFrame([(i, [int(a) for a in v], 1) for i, v in enumerate(x)], "id long, v array<bigint>, freq long")
    d = np.floor(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))).astype(int)
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]}
    edges = G.knn_graph(df, 4, block=16)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want
    assert G.graph_density(edges).count() == 60
    found = G.sampled_knn_graph(df, 4, 40)
    assert found.groupBy("src").count().where("count > 4").count() == 0
    deltas = G.peak_deltas(df, G.axis_density(df, 10)).collect()
    assert len(deltas) == 60 and sum(r["delta"] is None for r in deltas) == 1
    square = spark.createDataFrame([("a", [0, 0]), ("a", [0, 2]), ("a", [2, 2]), ("a", [2, 0]), ("a", [1, 1])], "g string, v array<bigint>")
    assert [(r["x"], r["y"]) for r in G.hulls(square, "g").orderBy("n").collect()] == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_edges(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 1)], "src long, dst long, dist long")
    more = G.add_edges(e, spark.createDataFrame([(1, 2, 9), (3, 4, 2)], "src long, dst long, dist long"), both=True)
    assert sorted(tuple(r) for r in more.collect()) == [(1, 2, 5), (2, 1, 9), (2, 3, 1), (3, 4, 2), (4, 3, 2)]
    assert G.remove_edges(more, spark.createDataFrame([(4, 3)], "src long, dst long"), both=True).count() == 3
    pairs = spark.createDataFrame([(1, 2), (9, 9)], "src long, dst long")
    assert {tuple(r) for r in G.has_edges(e, pairs).collect()} == {(1, 2, True), (9, 9, False)}
    near = G.add_neighbour(e.withColumn("rank", R.F.lit(1)), spark.createDataFrame([(1, 7, 3)], "src long, dst long, dist long"), 1)
    assert {(r["src"], r["dst"]) for r in near.collect()} == {(1, 7), (2, 3)}


def test_sets(spark):
    cb = spark.createDataFrame([(0, [3], 1), (1, [1], 2), (2, [3], 3)], "cid int, c array<bigint>, freq bigint")
    fresh = spark.createDataFrame([(5, [1]), (7, [9])], "id long, v array<bigint>")
    assert [tuple(r["c"]) for r in sets.replace_duplicates(cb, fresh).orderBy("cid").collect()] == [(9,), (1,), (3,)]
    assert [r["c"][0] for r in sets.remove_vector(cb, 0).orderBy("cid").collect()] == [3, 1] and sets.remove_vector(cb, 2).count() == 2
    rows = spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 4.0])], "id long, x array<double>")
    assert [r["binary"] for r in sets.column_profile(rows).orderBy("dim").collect()] == [True, False] and not sets.range_of(rows).first()["binary"]
    assert [r["id"] for r in sets.by_dimensions(rows, [1, 0]).collect()] == [2, 1]


def test_higher_in_window_and_axis_densities_by_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 10**6, (3000, 2))
    df = spark.createDataFrame([(i, [int(a) for a in v], 1) for i, v in enumerate(x)], "id long, v array<bigint>, freq long")
    want = np.zeros(3000)
    for d in (0, 1):
        order = np.lexsort((np.arange(3000), x[:, d]))
        y = x[order, d].astype(float)
        for r in range(3000):
            near = np.sort(np.abs(np.delete(y[max(0, r - 10) : r + 11], min(r, 10)) - y[r]))[:10]
            want[order[r]] += len(near) / (near.sum() + 1e-20)
    got = {r["id"]: r["density"] for r in G.nearest_axis_density(df, 10).collect()}
    assert np.allclose([got[i] for i in range(3000)], want)
