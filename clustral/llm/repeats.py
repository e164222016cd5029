"""Removal of repeated strings by suffix arrays over the corpus.

A text's bytes are cut into fragments: the windows of `length` bytes whose smallest k-gram hash is at the same place make
one. Equal windows have equal smallest k-grams, so only fragments that meet under the same k-gram can share windows, and
fragments whose k-gram occurs once are done. The rest meet by k-gram in a shuffle, to which a task sends each distinct one
once or, if it has met it again, twice; what is found returns to all places of a fragment by a join. Where they meet
a suffix array of the fragments, read as letters of BLOCK bytes counted from the k-gram, shows which share enough letters
for a window, and a window is repeated if another there has the same bytes: hashes only propose, here as for fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_map, dropped, in_bit_map, kept
from .suffix_array import common_prefixes, suffix_array
from .text import U, flat, mix, pieces, prefix_hash, span_hash

#: Bytes of the k-gram, bytes of a letter, fragments in a suffix array.
GRAM, BLOCK, MANY = 64, 80, 1500
#: Bits of the map of repeated k-grams for each of them, and at most (128 MB; beyond, more fragments travel for nothing).
BITS_EACH, BITS_MOST = 16, 1 << 30
#: Bits of a place in a piece; a text has less than 2 GB. The rest of the hash chooses the k-gram, so it must be as long in
#: every piece: else equal windows of two pieces could choose different ones.
PLACE_BITS = U(32)
COLLISION = "different fragments have the same 64-bit hash; nothing was removed"


def fragments(data: np.ndarray, off: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The fragments of rows: row, low and high (first and last start of a window, in data), place of the k-gram, key, hash."""
    n = len(data) - length + 1
    names = ("row", "low", "high", "place", "key", "hash")
    if n <= 0:
        return {k: np.zeros(0, U if k in ("key", "hash") else np.int64) for k in names}
    sums = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    key = span_hash(sums, at, at + GRAM)
    low = ((key >> PLACE_BITS) << PLACE_BITS) | at.astype(U)  # of hashes equal so far the first place is the smallest
    reach, span = 1, length - GRAM + 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:n], low[span - reach : span - reach + n])
    place = (low & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
    row = np.searchsorted(off, np.arange(n), "right") - 1
    inside = np.flatnonzero(np.arange(n) + length <= off[row + 1])
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | (place[inside][1:] != place[inside][:-1]) | (row[inside][1:] != row[inside][:-1])
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:], len(inside)) - 1] if len(inside) else first
    return {"row": row[first], "low": first, "high": last, "place": place[first], "key": key[place[first]], "hash": span_hash(sums, first, last + length) + mix((place[first] - first).astype(U))}


def repeated_windows(keys: np.ndarray, parts: list[bytes], places: np.ndarray, twice: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each distinct fragment the runs [a, b] of its windows that are repeated. twice: it occurs more than once."""
    need = (length - BLOCK + 1) // BLOCK
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(x) for x in parts], np.int64)
    base = np.cumsum(size) - size
    sums = prefix_hash(data)
    lead = places % BLOCK
    blocks = np.maximum(0, (size - lead) // BLOCK)
    owner = np.repeat(np.arange(len(parts)), blocks)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = base[owner] + lead[owner] + rank * BLOCK
    _, letter = np.unique(mix(span_hash(sums, begin, begin + BLOCK) ^ keys[owner]), return_inverse=True)
    # each fragment's letters, then an end of its own; the last end is the smallest letter
    spot = np.arange(len(owner)) + owner
    text = np.zeros(len(owner) + len(parts), np.int64)
    ends = np.cumsum(blocks + 1) - 1
    text[spot] = letter + len(parts)
    text[ends] = len(parts) - 1 - np.arange(len(parts))
    which = np.full(len(text), -1)
    which[spot] = np.arange(len(owner))
    text_ = text.tolist()
    order = suffix_array(text_)
    shared = np.array(common_prefixes(text_, order)) >= need
    near = shared.copy()
    near[:-1] |= shared[1:]
    seeds = which[np.array(order)[near]]
    seeds = seeds[seeds >= 0]
    # the windows that begin in the BLOCK bytes up to such a letter
    start = (begin[seeds][:, None] - np.arange(BLOCK)[None, :]).ravel()
    own = np.repeat(owner[seeds], BLOCK)
    right = (start >= base[own]) & (start + length <= base[own] + size[own])
    start, own = start[right], own[right]
    hit = np.zeros(len(data) + 1, bool)
    hit[equal_windows(data, np.unique(start), sums, length)] = True
    out = []
    for i in range(len(parts)):
        windows = int(size[i]) - length + 1
        if twice[i]:
            out.append([(0, windows - 1)])
            continue
        on = np.diff(np.concatenate([[0], hit[base[i] : base[i] + windows].astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(on == 1).tolist(), (np.flatnonzero(on == -1) - 1).tolist(), strict=True)))
    return out


def equal_windows(data: np.ndarray, start: np.ndarray, sums: np.ndarray, length: int) -> np.ndarray:
    """Those of the windows, by ascending start, that have the same bytes as another of them. Hashes propose, bytes decide."""
    _, first, kind, count = np.unique(span_hash(sums, start, start + length), return_index=True, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[kind] > 1)
    if not len(some):
        return start[:0]
    at, mate = start[some], start[first[kind[some]]]
    # runs of windows whose mates run along are compared as one string each
    new = np.ones(len(some), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(mate) != 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(some))) + length - 1
    begin = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(begin, size)
    other = data[np.repeat(at[head], size) + inside] != data[np.repeat(mate[head], size) + inside]
    if not other.any():
        return at
    wrong = np.concatenate([[0], np.cumsum(other)])
    place = begin[np.cumsum(new) - 1] + at - at[head][np.cumsum(new) - 1]
    odd = np.isin(kind[some], kind[some][wrong[place + length] > wrong[place]])  # of equal hashes, not all equal
    seen: dict[bytes, list[int]] = {}
    for s in at[odd].tolist():
        seen.setdefault(data[s : s + length].tobytes(), []).append(s)
    return np.concatenate([at[~odd], np.array([s for own in seen.values() if len(own) > 1 for s in own], np.int64)])


def _content(df: DataFrame, key: str, text: str) -> DataFrame:
    given = F.coalesce(df[text], F.lit(""))
    return df.select(df[key].alias("key"), F.xxhash64(given).alias("content"), given.alias("text"))


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Content ids, bytes and fragments of the rows of a task; of equal texts the first two."""
    seen: dict[int, int] = {}
    for b in batches:
        content = b.column("content").to_numpy()
        stays = []
        for c in content.tolist():
            seen[c] = seen.get(c, 0) + 1
            stays.append(seen[c] <= 2)
        own = b.filter(pa.array(stays, pa.bool_()))
        data, off = flat(own.column("text"))
        content = own.column("content").to_numpy()
        for i, j in pieces(off):
            yield content[i:j], data[off[i] : off[j]], fragments(data[off[i] : off[j]], off[i : j + 1] - off[i], length)


def covered(df: DataFrame, length: int) -> DataFrame:
    """(content, low, high): byte ranges of texts covered by repeated windows; df has columns content and text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, f in _scan(batches, length):
            key, n = np.unique(f["key"].astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"k": pa.array(key), "n": pa.array(n)})

    grams = df.select("content", "text").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    twice = kept(grams.where("n > 1").select("k"), "grams")
    bits = min(BITS_MOST, 1 << max(20, (BITS_EACH * twice.count()).bit_length()))
    shared = df.sparkSession.sparkContext.broadcast(np.frombuffer(bit_map(twice, "k", bits), np.int64))  # BITS_MOST at most
    dropped(twice)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bytes, dict[str, np.ndarray]]]:
        for content, data, f in _scan(batches, length):
            stays = in_bit_map(shared.value, f["key"].astype(np.int64), bits)
            begins = np.searchsorted(f["row"], f["row"])  # a row's first fragment starts at the row's first byte
            f["at"] = f["low"] - f["low"][begins]
            yield content, data.tobytes(), {k: x[stays] for k, x in f.items()}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bytes] = {}
        told: set[int] = set()
        for _, full, f in places(batches):
            own, texts = [], []
            for i, (a, b, h) in enumerate(zip(f["low"].tolist(), f["high"].tolist(), f["hash"].tolist(), strict=True)):
                part = full[a : b + length]
                first = known.setdefault(h, part)
                if first != part:
                    raise ValueError(COLLISION)
                if first is part or h not in told:  # a task tells of a fragment once, and once more if it meets it again
                    own.append(i)
                    texts.append(part if first is part else None)
                    if first is not part:
                        told.add(h)
            yield pa.RecordBatch.from_pydict({"k": pa.array(f["key"][own].astype(np.int64)), "h": pa.array(f["hash"][own].astype(np.int64)), "place": pa.array((f["place"] - f["low"])[own].astype(np.int32)), "part": pa.array(texts, pa.binary())})

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content, _, f in places(batches):
            yield pa.RecordBatch.from_pydict({"h": pa.array(f["hash"].astype(np.int64)), "content": pa.array(content[f["row"]]), "at": pa.array(f["at"])})

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            k, h = table.column("k").to_numpy(), table.column("h").to_numpy()
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            first = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            times = np.bincount(which)
            bytes_: list = [None] * len(first)
            for w, part in zip(which.tolist(), table.column("part").to_pylist(), strict=True):
                if part and bytes_[w] and bytes_[w] != part:
                    raise ValueError(COLLISION)
                bytes_[w] = bytes_[w] or part
            groups = np.cumsum(np.concatenate([[True], k[first][1:] != k[first][:-1]])) - 1
            alone = (np.bincount(groups)[groups] == 1) & (times == 1)  # the map said yes for nothing
            use = np.flatnonzero(~alone)
            runs: list[list[tuple[int, int]]] = [[] for _ in first]
            if len(use):
                for w, r in zip(use.tolist(), repeated_windows(k[first][use].astype(U), [bytes_[w] for w in use.tolist()], table.column("place").to_numpy()[first][use], times[use] > 1, length), strict=True):
                    runs[w] = r
            row = np.repeat(first, [len(r) for r in runs])
            ends = np.array([x for r in runs for x in r], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"f": pa.array(h[row]), "a": pa.array(ends[:, 0].copy()), "b": pa.array(ends[:, 1].copy())})

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= MANY:
                table = pa.concat_tables(held)
                k = table.column("k").to_numpy()
                cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
                at = 0
                while len(cuts) and cuts[-1] - at > 0:  # whole groups, about MANY fragments at once
                    to = int(cuts[min(np.searchsorted(cuts, at + MANY), len(cuts) - 1)])
                    yield done(table.slice(at, to - at).combine_chunks())
                    at = to
                held, rows = [table.slice(at)], table.num_rows - at
        if rows:
            yield done(pa.concat_tables(held).combine_chunks())

    texts = df.select("content", "text")
    met = texts.mapInArrow(parts, "k long, h long, place int, part binary").repartition("k").sortWithinPartitions("k", "h")
    runs = met.mapInArrow(resolved, "f long, a long, b long")
    at = texts.mapInArrow(occurrences, "h long, content long, at long")
    return at.join(runs, at["h"] == runs["f"]).select("content", (F.col("at") + F.col("a")).alias("low"), (F.col("at") + F.col("b") + length).alias("high"))


def remove_repeats(df: DataFrame, key: str, text: str, length: int = 400) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of every row: its UTF-8 bytes without those covered by a string of
    `length` bytes that also starts anywhere else, in it or in another row. Overlaps count; the input decides, not what is
    left. n_spans are the maximal removed runs.

    Null texts count as empty. Repeated rows repeat each other's strings. Texts shorter than length stay whole. Other
    columns are ignored, an empty table gives an empty result. length is 2 * BLOCK + GRAM at least.
    """
    if length < 2 * BLOCK + GRAM:
        raise ValueError(f"length must be at least {2 * BLOCK + GRAM}")
    rows = _content(df, key, text)
    ranges = covered(rows, length).groupBy("content").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = ranges.withColumnRenamed("content", "c")
    joined = rows.join(ranges, rows["content"] == ranges["c"], "left").select("key", "text", "ranges")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            data, off = flat(b.column("text"))
            for i, found in enumerate(b.column("ranges").to_pylist()):
                own = data[off[i] : off[i + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                for r in found or ():
                    edge[r["low"]] += 1
                    edge[r["high"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                for name, value in zip(out, (len(own), int(gone.sum()), spans, own[~gone].tobytes()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(v, pa.binary() if n == "kept" else pa.int64()) for n, v in out.items())], names=["key", *out])

    return joined.mapInArrow(cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
