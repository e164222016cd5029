"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and sent to the executors; its size depends on the sample alone. Every vector goes
to its leaf. A query walks the tree with a priority queue of nodes by what the best vector in them may reach: the inner
product with the centre plus the spread of the node's vectors. It visits leaves in that order; how many is calibrated on
queries of the sample until the mean recall there reaches the target. Leaves meet in groups of a bounded number of vectors,
to which a query travels once with the list of its leaves there, and which answer with its best k. Leaves that have grown
are split by a tree of their own where they meet, whose bins a query visits down to the bound of its last leaf. Equal
vectors are stored once with their smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Vectors in a group of leaves, and those of a leaf from which on it gets a tree of its own.
GROUP, GROWN = 8192, 512
#: Standard deviations that the best vector of a node lies above its centre.
ABOVE = 3.0


@dataclass
class Tree:
    """centres and spreads (by dimension) of the children of an inner node; a leaf has none but its number."""

    leaf: int = -1
    centres: np.ndarray | None = None
    spreads: np.ndarray | None = None
    children: list[Tree] = field(default_factory=list)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the child with the nearest centre."""
        if self.centres is None:
            return np.full(len(x), self.leaf)
        near = np.argmin((self.centres**2).sum(1) - 2 * (x @ self.centres.T), 1)
        out = np.empty(len(x), np.int64)
        for k, child in enumerate(self.children):
            out[near == k] = child.assign(x[near == k])
        return out

    def visits(self, q: np.ndarray, most: int, least: float = -np.inf) -> tuple[list[int], float]:
        """The first `most` leaves, best bin first, as long as the bound is `least` or more; and the last one's bound."""
        queue, out, n, bound, length = [(-np.inf, 0, self)], [], 1, np.inf, ABOVE * float(np.sqrt(q @ q))
        while queue and len(out) < most:
            top, _, node = heapq.heappop(queue)
            if -top < least:
                break
            if node.centres is None:
                out.append(node.leaf)
                bound = -top
                continue
            for score, child in zip((node.centres @ q + length * node.spreads).tolist(), node.children, strict=True):
                heapq.heappush(queue, (-score, n, child))
                n += 1
        return out, bound


def build(x: np.ndarray, branches: int = 8, leaf: int = 24, rounds: int = 8) -> tuple[Tree, int]:
    """A tree over x and its number of leaves; nodes of up to `leaf` vectors, or of equal ones, are leaves."""
    rng, count = np.random.default_rng(11), 0

    def spread(own: np.ndarray, centre: np.ndarray, parent: float) -> float:
        return float(np.sqrt(((own - centre) ** 2).sum() / (len(own) - 1) / x.shape[1])) if len(own) > 1 else parent

    def node(own: np.ndarray, wide: float) -> Tree:
        nonlocal count
        kinds = np.unique(own, axis=0) if len(own) > leaf else own
        if len(own) > leaf and len(kinds) >= branches:
            centres = kinds[rng.choice(len(kinds), branches, replace=False)].astype(float)
            for _ in range(rounds):
                near = np.argmin((centres**2).sum(1) - 2 * (own @ centres.T), 1)
                for k in range(branches):
                    if (near == k).any():
                        centres[k] = own[near == k].mean(0)
            near = np.argmin((centres**2).sum(1) - 2 * (own @ centres.T), 1)
            full = np.flatnonzero(np.bincount(near, minlength=branches))
            if len(full) > 1:
                spreads = [spread(own[near == k], centres[k], wide) for k in full]
                return Tree(-1, centres[full], np.array(spreads), [node(own[near == k], s) for k, s in zip(full, spreads, strict=True)])
        count += 1
        return Tree(count - 1)

    return node(x, spread(x, x.mean(0), 0.0) if len(x) else 0.0), count


def calibrate(tree: Tree, leaves: int, x: np.ndarray, k: int, target: float, queries: int = 200) -> int:
    """The number of leaves to visit for a mean recall of at least target among the sample."""
    of = tree.assign(x)
    need = []
    for i in range(0, len(x), max(1, len(x) // queries)):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, int)
        rank = np.empty(leaves, int)
        rank[tree.visits(x[i], leaves)[0]] = np.arange(leaves)
        need.append(rank[of[best]])
    ranks = np.concatenate([*need, np.zeros(0, int)])
    return int(np.quantile(ranks, target, method="higher")) + 1 if len(ranks) else 1


def grouped(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each leaf its first group and over how many groups it is dealt: leaves share groups of `most` vectors, in order;
    a leaf with more has groups of its own."""
    out, group, held = {}, 0, 0
    for leaf, n in sorted(sizes.items()):
        if held and held + n > most:
            group, held = group + 1, 0
        blocks = -(-n // most)
        out[leaf] = group, blocks
        group, held = (group + blocks, 0) if blocks > 1 else (group, held + n)
    return out


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and the vectors' length, the most frequent one (the smaller of equals).

    Rows without an id, null and zero vectors, those with null or non-finite components or of another length don't.
    """
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = lengths["d"] if lengths else 0
    return rows.where(F.size("v") == d), d


def search(df: DataFrame, key: str, vector: str, is_query: str, k: int = 20, sample: int = 16_384, target: float = 0.965, group: int = GROUP, grown: int = GROWN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row for which the SQL condition is_query on
    `id` holds, by largest inner product in double precision, ties to the smaller id; fewer if there are fewer rows.

    Rows with the query's own id are no candidates. Repeated rows count once. Which rows take part: see usable. `sample`
    bounds the vectors, chosen by a hash of their ids, that the tree is fitted and calibrated on; target is the mean recall
    it is calibrated for, group and grown are vectors in a group and in a leaf that is split where it meets its queries. An
    empty table gives an empty result, other columns are ignored.
    """
    rows, d = usable(df, key, vector)
    spark = df.sparkSession
    out = "query_id long, vec_id long, score double"
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not few.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(few.column("v").combine_chunks(), d)
    tree, leaves = build(x)
    most = min(leaves, calibrate(tree, leaves, x, k, target))
    shared = spark.sparkContext.broadcast(tree)  # of fewer centres than the sample has rows

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # equal vectors of a batch become one row with the k + 1 smallest ids
            v = np.ascontiguousarray(_matrix(b.column("v"), d)) + 0.0
            kinds, at = np.unique(v, axis=0, return_inverse=True)
            ids = b.column("id").to_numpy()
            order = np.lexsort((ids, at))
            cut = np.searchsorted(at[order], np.arange(len(kinds) + 1))
            lists = [np.unique(ids[order[cut[i] : cut[i + 1]]])[: k + 1].tolist() for i in range(len(kinds))]
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(shared.value.assign(kinds).astype(np.int32)), "v": pa.array([r.tobytes() for r in kinds], pa.binary()), "ids": pa.array(lists, pa.list_(pa.int64()))})

    stored = rows.mapInArrow(placed, "leaf int, v binary, ids array<long>").groupBy("leaf", "v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    stored = kept(stored, "vectors")
    places = grouped({r["leaf"]: r["n"] for r in stored.groupBy("leaf").agg(F.count("*").alias("n")).collect()}, group)  # a row a leaf
    dealt = spark.sparkContext.broadcast(places)
    table = spark.createDataFrame([(leaf, g, n) for leaf, (g, n) in places.items()], "place int, first long, blocks long")
    stored = stored.join(F.broadcast(table), F.col("leaf") == F.col("place"))  # of fewer rows than the sample
    stored = stored.select("leaf", "v", "ids", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("blocks"))).alias("group"))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"id": [], "group": [], "leaves": [], "bound": [], "v": []}
            for i, q in zip(b.column("id").to_pylist(), _matrix(b.column("v"), d), strict=True):
                own, bound = shared.value.visits(q, most)
                by: dict[int, list[int]] = {}
                for leaf in own:
                    g, n = dealt.value.get(leaf, (0, 0))
                    for k in range(n):
                        by.setdefault(g + k, []).append(leaf)
                for g, some in by.items():
                    for name, value in zip(out, (i, g, some, bound, q.tobytes()), strict=True):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))

    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(visited, "id long, group long, leaves array<int>, bound double, v binary")

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        got: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if held.num_rows and asked.num_rows:
            stack = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, d)
            order = np.argsort(held.column("leaf").to_numpy(), kind="stable")
            leaf, base, ids = held.column("leaf").to_numpy()[order], stack(held)[order], held.column("ids").to_pylist()
            names, start = np.unique(leaf, return_index=True)
            ends = dict(zip(names.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(leaf)], strict=True), strict=True))
            inner: dict[int, tuple[Tree, int, np.ndarray]] = {}
            for name, (a, z) in ends.items():
                if z - a > grown:
                    tree, n = build(base[a:z])
                    inner[name] = tree, n, tree.assign(base[a:z])
            for i, q, some, bound in zip(asked.column("id").to_pylist(), stack(asked), asked.column("leaves").to_pylist(), asked.column("bound").to_pylist(), strict=True):
                seen = np.zeros(len(base), bool)
                for name in some:
                    a, z = ends.get(name, (0, 0))
                    if name in inner:
                        tree, n, of = inner[name]
                        open_ = np.zeros(n, bool)
                        open_[tree.visits(q, n, bound)[0]] = True
                        seen[a:z] = open_[of]
                    else:
                        seen[a:z] = True
                rows_ = np.flatnonzero(seen)
                rough = (base @ q)[rows_] if 4 * len(rows_) > len(base) else base[rows_] @ q
                top = rows_[np.argpartition(-rough, k + 8)[: k + 8]] if len(rows_) > k + 8 else rows_
                exact = (base[top] * q).sum(1)
                found = sorted((-s, v) for s, t in zip(exact.tolist(), top.tolist(), strict=True) for v in ids[order[t]] if v != i)[:k]
                got["query_id"] += [i] * len(found)
                got["vec_id"] += [v for _, v in found]
                got["score"] += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(got["query_id"], pa.int64()), "vec_id": pa.array(got["vec_id"], pa.int64()), "score": pa.array(got["score"], pa.float64())})

    found = queries.groupBy("group").cogroup(stored.groupBy("group")).applyInArrow(best, out)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
