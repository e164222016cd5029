"""N-gram Jaccard join of documents: heavy-light candidates (jaccard.py), exact verification, connected classes.

Where small sets end and large ones begin is chosen by cost: from the sizes of all sets, so that signatures are fewest.

Equal sets are one node from the start. Nodes with a signature in common become one candidate group by a star around the
smallest, so no list is expanded into pairs and no link is lost. Within a candidate group the inverted lists of the sets' elements are scanned
for exact overlaps. Groups above `block` nodes are dealt as pairs of blocks, whose spanning forests are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import SMALLEST_LARGE, Forest, boundary, overlaps, signatures
from .shared import bit_map, components, dropped, in_bit_map, kept
from .text import flat, pieces, set_hash, shingles

#: Bits of the map of nodes that have a partner; groups above a block whose sizes are broadcast, beyond which they are joined.
BITS, LARGE = 1 << 25, 1 << 16


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: keys, nodes (a hash of the set), all elements, offsets."""
    for b in batches:
        data, off = flat(b.column("text"))
        for i, j in pieces(off):
            values, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
            yield b.column("key")[i:j], set_hash(values, at).astype(np.int64), values, at


def nodes(df: DataFrame, n: int) -> DataFrame:
    """(key, node, size) of each row; node is null for an empty set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, node, _, at in _sets(batches, n):
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([keys, pa.array(node, mask=size == 0), pa.array(size.astype(np.int64))], names=["key", "node", "size"])

    return df.mapInArrow(rows, f"key {df.schema['key'].dataType.simpleString()}, node long, size long")


def candidate_edges(df: DataFrame, n: int, percent: int, limit: int) -> DataFrame:
    """Edges (a, b) between each node and the smallest node of every list it is in. Sets of `limit` elements are large."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, node, values, at in _sets(batches, n):
            parts, owners = [], []
            for k, x in enumerate(node.tolist()):
                if x not in seen and at[k + 1] > at[k]:
                    seen.add(x)
                    parts.append(signatures(values[at[k] : at[k + 1]], percent, limit))
                    owners.append(np.full(len(parts[-1]), x))
            if parts:
                yield pa.RecordBatch.from_pydict({"sig": pa.array(np.concatenate(parts).astype(np.int64)), "node": pa.array(np.concatenate(owners))})

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = centre = None
        for b in batches:
            sig, node = b.column("sig").to_numpy(), b.column("node").to_numpy()
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            first = np.flatnonzero(new)
            centres = node[first].copy()
            if last is not None and sig[0] == last:
                centres[0] = centre
            to = np.repeat(centres, np.diff(np.append(first, len(sig))))
            last, centre = sig[-1], centres[-1]
            pairs = np.unique(np.stack([to, node], 1)[to != node], axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

    signed = df.mapInArrow(lists, "sig long, node long")
    return signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(stars, "a long, b long").distinct()


def _verified(percent: int):
    """The nodes of a group (or of a pair of blocks) with their links' number and the root of their class."""

    def links(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        node = table.column("node").to_numpy()
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        table, node = table.filter(pa.array(new)), node[new]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        copies, least, block = (table.column(k).to_numpy() for k in ("copies", "first", "block"))
        parts = [np.frombuffer(x.as_py(), np.int64) for x in table.column("elements")]
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        forest, count = Forest(len(node)), np.zeros(len(node), np.int64)
        mine = np.flatnonzero(block == i)
        for x, near in overlaps(np.concatenate(parts), at, percent, mine, block == j):
            count[x] += copies[near].sum()
            if i != j:
                count[near] += copies[x]
            for y in near.tolist():
                forest.join(int(x), y)
        root = np.array([forest.root(x) for x in range(len(node))])
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, root, least)
        return pa.table({"node": node, "root": node[root], "low": low[root], "n": count, "whole": np.full(len(node), table.column("blocks")[0].as_py() == 1)})

    return links


def classes(df: DataFrame, key: str, text: str, n: int = 3, percent: int = 90, block: int = 2048) -> DataFrame:
    """(key, n_shingles, component_id, n_links) for every row of df.

    Rows link when their sets of n-word shingles have 100 * intersection >= percent * union. component_id is the smallest
    key reachable by links, n_links the number of rows linked to. Null texts and texts without words have no shingles and
    link with nothing, their own key is their component_id. Repeated rows are rows of their own, linked to each other. A
    null key never is the smallest unless alone. Other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(df[key].cast("long").alias("key"), df[text].alias("text"))
    of = kept(nodes(rows, n), "nodes")
    about = of.where("node is not null").groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    small = of.where(F.col("size").between(1, 2 * SMALLEST_LARGE)).groupBy("size").agg(F.count("*").alias("n")).collect()  # 128 rows
    limit = boundary({r["size"]: r["n"] for r in small}, percent)
    groups = kept(components(candidate_edges(rows, n, percent, limit)), "groups")
    packed = np.frombuffer(bit_map(groups, "node", BITS), np.int64)  # of fixed size
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, node, values, at in _sets(batches, n):
            own = [k for k in np.flatnonzero(in_bit_map(shared.value, node, BITS) & (np.diff(at) > 0)).tolist() if not (int(node[k]) in seen or seen.add(int(node[k])))]
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[own]), "elements": pa.array([values[at[k] : at[k + 1]].astype(np.int64).tobytes() for k in own], pa.binary())})

    sets = rows.mapInArrow(elements, "node long, elements binary")
    # only groups above a block are told their sizes: a large one's rows need not meet for that
    big = kept(groups.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") > block), "large")
    known = F.broadcast(big) if big.count() <= LARGE else big
    placed = groups.join(known, "component", "left").join(about, "node").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("first", F.coalesce("first", F.lit((1 << 63) - 1)))
    dealt = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "first", "copies", "block", "blocks", "elements")
    found = kept(dealt.groupBy("component", "i", "j").applyInArrow(_verified(percent), "node long, root long, low long, n long, whole boolean"), "links")
    dropped(groups)
    dropped(big)
    whole = found.where("whole").select("node", F.col("low").alias("component_id"), "n")
    split = found.where("not whole")
    if not split.isEmpty():
        joined = components(split.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counted = split.groupBy("node").agg(F.sum("n").alias("n"), F.min("low").alias("low")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        low = counted.groupBy("component").agg(F.min("low").alias("component_id"))
        whole = whole.union(counted.join(low, "component").select("node", "component_id", "n"))
    result = about.join(whole, "node", "left").select(F.col("node").alias("id"), F.coalesce(F.nullif("component_id", F.lit((1 << 63) - 1)), "first").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = of.where("node is not null").join(result, F.col("node") == F.col("id")).select("key", F.col("size").alias("n_shingles"), "component_id", "n_links")
    none = of.where("node is null").select("key", F.col("size").alias("n_shingles"), F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(none)
