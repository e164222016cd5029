"""Benchmark decontamination: which documents contain a test item, by size-partitioned MinHash containment search.

Items are put in partitions by the number of their shingles. An item's sketch is its bottom-k MinHash, the k smallest
hashes of its shingles; k, set for the largest size of the partition, is one more than the shingles a document may lack,
so a document that contains enough of an item contains one of its sketch. A document of any length is probed with all its
shingles, and the candidates are verified by counting the item's shingles that the document has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F

from .text import U, flat, mix, pieces, sequence, shingles

#: Shingles of items that are searched for in one pass over the documents (8 bytes each, sent to every executor).
PASS = 1 << 20


class Index:
    """Sketches of the items' shingle sets. lengths: words in a shingle, for items shorter than n words too."""

    def __init__(self, ids: list, sets: list[np.ndarray], lengths: list[int], percent: int) -> None:
        self.ids, self.sets, self.percent = ids, sets, percent
        self.lengths = sorted(set(lengths))
        edge, entry, item = [1], [], []
        while edge[-1] <= max(map(len, sets), default=0):
            edge.append(edge[-1] * 5 // 4 + 1)
        for i, s in enumerate(sets):
            largest = edge[int(np.searchsorted(edge, len(s), "right"))] - 1
            k = min(len(s), largest - -(-largest * percent // 100) + 1)
            entry.append(s[np.argsort(mix(s ^ U(0x2545F4914F6CDD1D)))[:k]])
            item.append(np.full(k, i))
        entries, items = np.concatenate([np.zeros(0, U), *entry]), np.concatenate([np.zeros(0, np.int64), *item])
        order = np.argsort(entries, kind="stable")
        self.entries, self.items = entries[order], items[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.entries >> U(44)).astype(np.int64)] = True

    def search(self, data: np.ndarray, off: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the rows that contain at least percent of an item's shingles."""
        runs = [sequence(data, off, k) for k in self.lengths]
        rows, hits = [], []
        for values, at in runs:
            place = np.flatnonzero(self.maybe[(values >> U(44)).astype(np.int64)])
            rows.append(np.searchsorted(at, place, "right") - 1)
            hits.append(values[place])
        row, hit = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, U), *hits])
        low, high = np.searchsorted(self.entries, hit), np.searchsorted(self.entries, hit, "right")
        each = high - low
        if not each.sum():
            return
        ends = np.cumsum(each)
        item = self.items[np.arange(ends[-1]) + np.repeat(low - (ends - each), each)]
        pairs = np.unique(np.stack([np.repeat(row, each), item], 1), axis=0)
        for r in np.unique(pairs[:, 0]).tolist():
            own = np.unique(np.concatenate([values[at[r] : at[r + 1]] for values, at in runs]))
            for i in pairs[pairs[:, 0] == r, 1].tolist():
                want = self.sets[i]
                place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                common = int((own[place] == want).sum())
                if common * 100 >= self.percent * len(want):
                    yield r, i, common


def _indexes(items: DataFrame, item: str, text: str, n: int, percent: int) -> Iterator[Index]:
    """Indexes of at most about PASS shingles each, one at a time."""
    ids, sets, lengths, size = [], [], [], 0
    for row in items.select(items[item].alias("id"), items[text].alias("text")).toLocalIterator():
        data, off = flat(pa.array([row["text"]], pa.string()))
        values, _ = shingles(data, off, n)
        if not len(values):
            continue
        ids.append(row["id"])
        sets.append(values)
        lengths.append(min(n, len(bytes(data).lower().split())))
        size += len(values)
        if size >= PASS:
            yield Index(ids, sets, lengths, percent)
            ids, sets, lengths, size = [], [], [], 0
    if ids:
        yield Index(ids, sets, lengths, percent)


def contained(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(key, item_id, item_shingles, shared) for each document and item of which it has at least percent of the n-word
    shingles.

    An item of fewer words is one shingle, found wherever the words stand in a row. Null and empty items and texts are in
    no result. Repeated rows give repeated results, other columns are ignored, an empty table gives an empty result. Keys
    and items' ids may be of any type and null. The benchmark goes through the driver, PASS shingles at a time, and each
    PASS of them takes a pass over the documents.
    """
    kinds = {"key": docs.schema[key].dataType.simpleString(), "item_id": items.schema[item].dataType.simpleString()}
    ids = to_arrow_type(items.schema[item].dataType)
    schema = f"key {kinds['key']}, item_id {kinds['item_id']}, item_shingles long, shared long"
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = None
    for index in _indexes(items, item, item_text, n, percent):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                data, off = flat(b.column("text"))
                for i, j in pieces(off):
                    got = list(index.search(data[off[i] : off[j]], off[i : j + 1] - off[i], n))
                    keys = b.column("key").take(pa.array([i + r for r, _, _ in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([index.ids[x] for _, x, _ in got], ids), pa.array([len(index.sets[x]) for _, x, _ in got], pa.int64()), pa.array([c for _, _, c in got], pa.int64())], names=["key", "item_id", "item_shingles", "shared"])

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
