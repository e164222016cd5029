"""A character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams it has at any position, or the text itself if it is shorter than all
of them, hashed to a fixed number of buckets, A-Z lower-cased; whole texts are read. The
ratio of a bucket is the logarithm of its share of positive rows over its share of negative rows, both smoothed by one.
A logistic regression on the features times their ratios gives the score. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, kept
from .text import _LOWER, flat, pieces

#: Texts whose features are marked at once.
BLOCK = 64
#: Rows of a group that is fitted at once; their numbers fit a byte.
GROUP = 256


@dataclass(frozen=True)
class Model:
    """weights: of each bucket, the ratio included; orders: lengths of the n-grams."""

    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]

    def score(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(rows, self.weights[buckets], n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _hash(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n characters."""
    m = len(points) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def features(data: np.ndarray, off: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows [i, j): each row's distinct buckets, as (i, j, row in the block, bucket)."""
    marks = np.zeros(BLOCK << bits, bool)
    for i, j in ((a, min(a + BLOCK, d)) for c, d in pieces(off) for a in range(c, d, BLOCK)):
        own = _LOWER[data[off[i] : off[j]]]
        lead = np.cumsum((own & 0xC0) != 0x80)
        points = np.frombuffer(own.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        at = np.concatenate([[0], lead])[off[i : j + 1] - off[i]]
        row = np.repeat(np.arange(j - i), np.diff(at))
        for k in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < min(orders))).tolist():
            h = _hash(points[at[k] : at[k + 1]], int(at[k + 1] - at[k]))
            marks[(k << bits) + int(h[0] >> np.uint64(64 - bits))] = True
        for n in orders:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = _hash(points, n)
            inside = row[:m] == row[n - 1 :]
            marks[(row[:m][inside] << bits) + (h[inside] >> np.uint64(64 - bits)).astype(np.int64)] = True
        hit = np.flatnonzero(marks[: (j - i) << bits])
        marks[hit] = False
        yield i, j, hit >> bits, hit & ((1 << bits) - 1)


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def fit(rows: DataFrame, text: str, label: str, orders: tuple[int, ...] = (5, 7), bits: int = 18, penalty: float = 3.0, steps: int = 40, tasks: int = 12) -> Model:
    """Fits the model on rows, whose number the caller bounds. Rows with a null label are left out, null texts are empty,
    repeated rows count as often as they are there, other columns are ignored.

    Features are written to the shared folder once. Each step is a pass of the executors over them, whose sums have the
    size of the model: one reaches the driver, whatever the rows' number and their texts' length.

    Without any positive or any negative row the score is the smoothed share of positives for every text.
    """

    def grouped(held: list[tuple]) -> pa.RecordBatch:
        labels, row, buckets = (np.concatenate(x) for x in zip(*held, strict=True))
        row = row.astype(np.uint8)[np.argsort(buckets, kind="stable")]
        sizes = np.bincount(buckets, minlength=1 << bits).astype("<u2")
        return pa.RecordBatch.from_pydict({c: pa.array([x.tobytes()], pa.binary()) for c, x in (("labels", labels.astype("<i4")), ("sizes", sizes), ("rows", row))})

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            data, off = flat(b.column("text"))
            labels = b.column("label").to_numpy()
            for i, j, r, buckets in features(data, off, orders, bits):
                if n + j - i > GROUP:
                    yield grouped(held)
                    held, n = [], 0
                held.append((labels[i:j], r + n, buckets))
                n += j - i
        if held:
            yield grouped(held)

    given = rows.select(rows[text].alias("text"), rows[label].cast("int").alias("label")).where("label is not null")
    # a bounded number of rows, dealt to few tasks, so that groups are full
    blocks = kept(given.repartition(tasks).mapInArrow(extract, "labels binary, sizes binary, rows binary"), "features")
    spark = rows.sparkSession

    def total(f: Callable[[np.ndarray, Block], np.ndarray], at: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(at)  # of the model's size

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for y, s, r in zip(*b.columns, strict=True):
                    own = f(shared.value, (np.frombuffer(y.as_buffer(), "<i4").astype(float), np.frombuffer(s.as_buffer(), "<u2"), np.frombuffer(r.as_buffer(), np.uint8)))
                    out = own if out is None else out + own
            if out is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tobytes()], pa.binary())})

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for x in b.column("sums"):
                    own = np.frombuffer(x.as_buffer())
                    out = own if out is None else out + own
            if out is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tobytes()], pa.binary())})

        parts = blocks.coalesce(tasks).mapInArrow(partial, "sums binary")  # `tasks` rows at most
        sums = parts.repartition(1).mapInArrow(summed, "sums binary").toArrow().column("sums")  # one row
        shared.destroy()
        return np.frombuffer(sums[0].as_buffer()) if len(sums) else np.zeros(0)

    out = solve(total, orders, bits, penalty, steps)
    dropped(blocks)
    return out


def _add(into: np.ndarray, values: np.ndarray, size: np.ndarray, row: np.ndarray) -> None:
    """Adds to each bucket the values of its rows."""
    some = np.flatnonzero(size)
    if len(some):
        into[some] += np.add.reduceat(values[row], (np.cumsum(size, dtype=np.int64) - size)[some])


def solve(total: Callable, orders: tuple[int, ...], bits: int, penalty: float, steps: int) -> Model:
    """fit, where total(f, x) sums f(x, block) over the blocks: groups of at most GROUP rows, given by their labels, how
    many of them each bucket is in, and which, bucket by bucket. Limited-memory BFGS, `steps` passes at most."""
    width = 1 << bits

    def counts(_: np.ndarray, block: Block) -> np.ndarray:
        own, size, row = block
        out = np.zeros(2 * width + 2)
        _add(out[:width], own, size, row)
        _add(out[width : 2 * width], 1 - own, size, row)
        out[-2:] = len(own), own.sum()
        return out

    found = total(counts, np.zeros(0))
    rows, positive = (float(found[-2]), float(found[-1])) if len(found) else (0.0, 0.0)
    prior = (positive + 1) / (rows + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < positive < rows:
        return Model(np.zeros(width), bias, orders)
    p, q = found[:width] + 1, found[width : 2 * width] + 1
    ratio = np.log(p / (positive + 2)) - np.log(q / (rows - positive + 2))
    ratio[(p + q) < 5] = 0

    def slopes(x: np.ndarray, block: Block) -> np.ndarray:
        """By bucket, for the bias, and the loss."""
        own, size, row = block
        at, out = row.astype(np.intp), np.zeros(width + 2)
        z = np.clip(x[-1] + np.bincount(at, np.repeat(x[:-1], size), len(own)), -500, 500)
        miss = 1 / (1 + np.exp(-z)) - own
        _add(out[:width], miss, size, at)
        out[-2:] = miss.sum(), (np.logaddexp(0, z) - own * z).sum()
        return out

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        s = total(slopes, np.append(x[:-1] * ratio, x[-1]))
        return float(s[-1]) + penalty / 2 * float(x[:-1] @ x[:-1]), np.append(s[:width] * ratio + penalty * x[:-1], s[-2])

    x = np.append(np.zeros(width), bias)
    value, g = loss(x)
    passes, past = 1, []
    while passes < steps:
        d, turned = -g, []
        for s, y, r in reversed(past):
            turned.append(r * (s @ d))
            d = d - turned[-1] * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).sum())))
        for (s, y, r), t in zip(past, reversed(turned), strict=True):
            d = d + (t - r * (y @ d)) * s
        step, fall = 1.0, float(g @ d)
        while passes < steps:
            new, h = loss(x + step * d)
            passes += 1
            if new <= value + 1e-4 * step * fall:
                break
            step /= 4
        else:
            break
        s, y = step * d, h - g
        if s @ y > 1e-10:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        x, g, done = x + s, h, value - new < 1e-4 * max(1.0, abs(value))
        value = new
        if done:
            break
    return Model(x[:-1] * ratio, float(x[-1]), orders)


def score(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, score double) for every row: from 0 to 1, higher for a likelier label 1. Null texts count as empty, which
    have the bias's score. Repeated rows stay, other columns are ignored, an empty table gives an empty result."""
    bits = int(np.log2(len(model.weights)))
    kind = df.schema[key].dataType.simpleString()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column("text"))
            parts = [model.score(r, buckets, j - i) for i, j, r, buckets in features(data, off, model.orders, bits)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.concatenate([*parts, np.zeros(0)]))], names=["key", "score"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(scores, f"key {kind}, score double")


def sample(labelled: DataFrame, key: str, rows: int, seed: str = "fit") -> DataFrame:
    """The `rows` rows that come first by a hash of the key: the same on every run, and no more than that."""
    return labelled.orderBy(F.md5(F.concat(F.lit(seed), labelled[key].cast("string"))), labelled[key]).limit(rows)


def keep_below(df: DataFrame, text: str, model: Model, limit: float) -> DataFrame:
    """df's rows, with all columns, whose text scores under limit."""
    bits = int(np.log2(len(model.weights)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat(b.column(text))
            parts = [model.score(r, buckets, j - i) for i, j, r, buckets in features(data, off, model.orders, bits)]
            yield b.filter(pa.array(np.concatenate([*parts, np.zeros(0)]) < limit))

    return df.mapInArrow(below, df.schema)
