"""Texts as codes into small dictionaries: the frame of operators that treat each distinct word once.

A task reads its rows in batches of bounded size and numbers the distinct words of each batch. Words then travel once a
batch, not once an occurrence, so the most frequent word of the whole corpus has as many rows as there are batches. The
codes of the texts, packed, wait under the batch's name for what comes back about its words. A batch is named by a hash of
its texts, so two passes that cut the rows in other batches never mix their words up: that is an error.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .shared import kept

#: Characters of text in a batch, and codes packed in a row.
BATCH, PACK = 6_000_000, 1 << 18
Split = Callable[[str], list]


def pack(codes: np.ndarray) -> bytes:
    """32-bit codes, by planes of bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(start - (ends - size), size)]


def stable(df: DataFrame) -> DataFrame:
    """df itself if it only reads files, so that it gives the same rows in the same order again; else a written copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    simple = all(line.lstrip(" :+-").startswith(("Project", "Relation")) for line in plan.strip().splitlines())
    return df if simple and " parquet" in plan else kept(df, "texts")


def _batches(rows: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, object, str]]:
    """(whether it is a batch's last, key, text) of each row of a task."""
    size, last = 0, None
    for b in rows:
        for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
            if last is not None:
                full = size >= limit
                yield full, *last
                size = 0 if full else size
            last = key, text or ""
            size += len(last[1])
    if last is not None:
        yield True, *last


def _mark(text: str) -> bytes:
    """A text with its length: a batch's name depends on where its texts end."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + data


def _of(known: xxhash.xxh3_64) -> int:
    return known.intdigest() - (1 << 63)


def _numbered() -> defaultdict:
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


def pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 1)


def unpack_words(packed: bytes) -> list[bytes]:
    data = zlib.decompress(packed)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [data[s:e] for s, e in zip(starts, ends.tolist(), strict=False)]


def dealt(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, numbers of its words) by the words' hashes: equal words of all batches meet in a bucket."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, order[cut[k] : cut[k + 1]]


def batch_words(df: DataFrame, split: Split, limit: int = BATCH) -> DataFrame:
    """The distinct words of each batch, dealt to buckets by their hash: rows (bucket, batch, words, codes), packed.

    Equal words meet in a bucket; the number of buckets follows spark.sql.shuffle.partitions, which follows the input.
    """
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = _numbered(), xxhash.xxh3_64()
        for last, _, text in _batches(rows, limit):
            for w in split(text):
                names[w]
            known.update(_mark(text))
            if last:
                batch = _of(known)
                full = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in names]
                names, known = _numbered(), xxhash.xxh3_64()
                out: dict[str, list] = {"bucket": [], "batch": [], "words": [], "codes": []}
                for k, own in dealt(full, buckets):
                    for name, value in zip(out, (k, batch, pack_words([full[i] for i in own]), pack(np.diff(own, prepend=0))), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=list(out))

    return df.mapInArrow(words, "bucket int, batch long, words binary, codes binary")


def _keys(df: DataFrame) -> tuple[pa.DataType, str]:
    kind = df.schema["key"].dataType
    return to_arrow_type(kind), kind.simpleString()


def batch_texts(df: DataFrame, split: Split, limit: int = BATCH) -> DataFrame:
    """The texts as codes: rows (batch, keys, sizes, codes), each of some texts of one batch."""
    kind, name = _keys(df)
    schema = pa.schema([("batch", pa.int64()), ("keys", pa.list_(kind)), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())])

    def texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, keys, codes, size, held = _numbered(), xxhash.xxh3_64(), [], [], 0, []
        for last, key, text in _batches(rows, limit):
            got = split(text)
            codes.append(np.fromiter(map(names.__getitem__, got), np.uint32, len(got)))
            keys.append(key)
            size += len(got)
            known.update(_mark(text))
            if last or size >= PACK:
                held.append({"keys": keys, "sizes": [len(x) for x in codes], "codes": pack(np.concatenate(codes))})
                keys, codes, size = [], [], 0
            if last:
                for row in held:
                    yield pa.RecordBatch.from_pylist([row | {"batch": _of(known)}], schema)
                names, known, held = _numbered(), xxhash.xxh3_64(), []

    return df.mapInArrow(texts, f"batch long, keys array<{name}>, sizes array<int>, codes binary")


def whole_batches(df: DataFrame, split: Split, training: Callable[[object], bool], limit: int = BATCH) -> DataFrame:
    """A row for each batch, with all that later passes need, so that the texts are split once: (batch, words, keys, sizes,
    trains, codes). trains: which texts' keys `training` accepts."""
    kind, name = _keys(df)
    schema = pa.schema([("batch", pa.int64()), ("words", pa.binary()), ("keys", pa.list_(kind)), ("sizes", pa.list_(pa.int32())), ("trains", pa.list_(pa.bool_())), ("codes", pa.binary())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, keys, trains, codes = _numbered(), xxhash.xxh3_64(), [], [], []
        for last, key, text in _batches(rows, limit):
            got = split(text)
            codes.append(np.fromiter(map(names.__getitem__, got), np.uint32, len(got)))
            keys.append(key)
            trains.append(bool(training(key)))
            known.update(_mark(text))
            known.update(repr(key).encode())
            if last:
                yield pa.RecordBatch.from_pylist([{"batch": _of(known), "words": pack_words(list(names)), "keys": keys, "sizes": [len(x) for x in codes], "trains": trains, "codes": pack(np.concatenate(codes))}], schema)
                names, known, keys, trains, codes = _numbered(), xxhash.xxh3_64(), [], [], []

    return df.mapInArrow(batches, f"batch long, words binary, keys array<{name}>, sizes array<int>, trains array<boolean>, codes binary")


def meet(texts: DataFrame, words: DataFrame, use: Callable[[list[dict], np.ndarray], Callable], schema: str) -> DataFrame:
    """Brings rows about the words (batch, codes, ...) back to the texts of their batch.

    use(a batch's rows, their codes one after another) gives a function from (keys, sizes, codes) to an Arrow table.
    """

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        order = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(r["codes"]).astype(np.int64)) for r in rows)])
        each = use(rows, order)
        out = []
        for row in left.to_pylist():
            codes = unpack(row["codes"])
            if len(codes) and not len(order):
                raise RuntimeError("the two passes over the texts have not cut them into the same batches")
            out.append(each(row["keys"], np.array(row["sizes"], np.int64), codes))
        return pa.concat_tables(out)

    return texts.groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(joined, schema)
