"""Brown class-based bigram scoring: classes from exchange clustering, smoothed transitions and emissions.

Texts are split once, into batches that carry their own words (dictionary.py); all later passes read these. The words most
frequent in training are exchanged among the classes until no word moves: each in turn goes to the class that raises the
likelihood of the class bigrams most. Then all other words that occur twice in training are exchanged, each by the counts
of the classes beside it, which meet with the word in a shuffle. Words that occur once and words not met are what an unknown
word looks like: their classes go by their last two bytes. The end of a text has a class of its own. The probability of a
text is the product of its class transitions and its word emissions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dictionary
from .dictionary import pack, unpack, unpack_words
from .shared import dropped, kept

#: Leading words, the classes that exchange clustering fills, and the classes of rare words by their ends. The first bounds
#: what the driver exchanges; the other words are exchanged by the executors, however many they are.
LEADERS, CLASSES, TAILS = 1000, 64, 32
#: The class of a text's end, and the number of classes; a class and a side fit a byte.
END, ALL = CLASSES + TAILS, CLASSES + TAILS + 1
#: Contexts that are weighed at once.
CHUNK = 1 << 17


def split(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail(word: bytes) -> int:
    """The class of a word that is not in the exchange."""
    return CLASSES + zlib.crc32(word[-2:]) % TAILS


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, movable: int, classes: int = CLASSES) -> np.ndarray:
    """The class of each type, from the types' bigram counts: the first `movable` start in turn in the `classes` classes,
    every other type is a class of its own after these. Ends when a sweep moves nothing.

    A word moves to the class of the largest gain in sum f(n(c, d)) - 2 sum f(n(c)), f(x) = x log x; ties to the smaller.
    Every move gains at least 1e-6, so the sweeps end.
    """
    m = classes + len(counts) - movable
    of = np.concatenate([np.arange(movable) % classes, np.arange(classes, m)])
    total = (counts.sum(1) + counts.sum(0)) / 2
    fold = np.zeros((len(of), m))
    fold[np.arange(len(of)), of] = 1
    table = fold.T @ counts @ fold
    size = fold.T @ total
    live = np.argsort(-total[:movable], kind="stable")
    live = live[total[live] > 0]
    moved = 1
    while moved:
        moved = 0
        for w in live.tolist():
            a = of[w]
            self_, out, in_ = counts[w, w], np.bincount(of, counts[w], m), np.bincount(of, counts[:, w], m)
            out[a] -= self_
            in_[a] -= self_
            table[a] -= out
            table[:, a] -= in_
            table[a, a] -= self_
            size[a] -= total[w]
            now, diagonal = _xlogx(table[:classes]), np.diag(table)[:classes]
            gain = (_xlogx(table[:classes] + out) - now).sum(1) + (_xlogx(table[:, :classes] + in_[:, None]) - _xlogx(table[:, :classes])).sum(0)
            gain += _xlogx(diagonal + (out + in_)[:classes] + self_) + _xlogx(diagonal) - _xlogx(diagonal + out[:classes]) - _xlogx(diagonal + in_[:classes])
            gain -= 2 * (_xlogx(size[:classes] + total[w]) - _xlogx(size[:classes]))
            b = int(np.argmax(gain))
            b = b if gain[b] > gain[a] + 1e-6 else a
            table[b] += out
            table[:, b] += in_
            table[b, b] += self_
            size[b] += total[w]
            of[w] = b
            moved += a != b
    return of


def best_classes(word: np.ndarray, context: np.ndarray, times: np.ndarray, words: int, table: np.ndarray) -> np.ndarray:
    """The class that suits each word's contexts best: the largest sum of the logarithms of the class bigrams they make, less
    twice that of the class for each occurrence, which is what an exchange of that word alone gains; ties to the smaller.

    Contexts (word, context, times) are in order of words; a context is a class before the word, or ALL plus one after it.
    """
    t = np.log(table + 0.5)
    size = np.log(table.sum(0)[:CLASSES] + 1)
    weight = np.concatenate([t[:, :CLASSES], t[:CLASSES].T]) - size  # a word's occurrences have a context on either side
    out = np.zeros((words, CLASSES))
    for i in range(0, len(word), CHUNK):
        own, new = word[i : i + CHUNK], np.ones(len(word[i : i + CHUNK]), bool)
        new[1:] = own[1:] != own[:-1]
        out[own[new]] += np.add.reduceat(weight[context[i : i + CHUNK]] * times[i : i + CHUNK, None], np.flatnonzero(new))
    return out.argmax(1)


@dataclass(frozen=True)
class Model:
    """bottom: by class, log10 of what a word's count is divided by; ends: of training texts."""

    bottom: np.ndarray
    tokens: int
    distinct: int
    ends: int


def transitions(table: np.ndarray, weight: float = 20.0) -> np.ndarray:
    """log10 of P(d | c) at [c, d], smoothed by the classes' shares."""
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + weight * share) / (table.sum(1, keepdims=True) + weight))


def _sequence(sizes: np.ndarray, codes: np.ndarray, end: int) -> np.ndarray:
    """The codes of texts one after another, each with `end` behind it."""
    seq = np.full(int(sizes.sum()) + len(sizes), end)
    inner = np.ones(len(seq), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    seq[inner] = codes
    return seq


def _rows(b: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches as (row, sizes, trains, codes)."""
    for r in b.to_pylist():
        yield r, np.array(r["sizes"], np.int64), np.array(r["trains"], bool), unpack(r["codes"]).astype(np.int64)


def _trained(seq: np.ndarray, sizes: np.ndarray, trains: np.ndarray) -> np.ndarray:
    """The part of a sequence that is in training texts; it begins after an end and ends with one."""
    return seq[np.repeat(trains, sizes + 1)]


def _table(pairs: DataFrame, m: int) -> np.ndarray:
    got = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # m * m rows at most
    out = np.zeros(m * m)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(m, m)


def leading_words(batches: DataFrame) -> list[bytes]:
    """The LEADERS words of the largest counts in training texts, ties to the smaller word. Every word of every batch counts."""

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r, sizes, trains, codes in _rows(b):
                words = unpack_words(r["words"])
                n = np.bincount(codes[np.repeat(trains, sizes)], minlength=len(words))
                met = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in met.tolist()], pa.binary()), "n": pa.array(n[met])})

    found = batches.select("words", "sizes", "trains", "codes").mapInArrow(counted, "word binary, n long")
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(LEADERS).collect()  # LEADERS rows
    return [bytes(r["word"]) for r in rows]


def leader_classes(batches: DataFrame, leaders: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """The leaders' classes, and the class bigrams that they make with the classes by ends of all other words."""
    shared = batches.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(leaders)})  # LEADERS words at most
    many, m = len(leaders), len(leaders) + TAILS + 1

    def pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(m * m, np.int64)
        for b in rows:
            for r, sizes, trains, codes in _rows(b):
                words = unpack_words(r["words"])
                kind = np.array([shared.value.get(w, -1) for w in words] + [m - 1], np.int64)
                rest = np.flatnonzero(kind < 0)
                kind[rest] = [many + tail(words[i]) - CLASSES for i in rest.tolist()]
                seq = _trained(kind[_sequence(sizes, codes, len(words))], sizes, trains)
                counts += np.bincount(np.append(m - 1, seq[:-1])[: len(seq)] * m + seq, minlength=m * m)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(counts[at])})

    counts = _table(batches.select("words", "sizes", "trains", "codes").mapInArrow(pairs, "pair long, n long"), m)
    of = exchange(counts, many)
    fold = np.zeros((m, ALL))
    fold[np.arange(m), of] = 1
    return dict(zip(leaders, of.tolist(), strict=False)), fold.T @ counts @ fold


def word_classes(batches: DataFrame, leaders: dict[bytes, int], table: np.ndarray) -> DataFrame:
    """The training count and class of every word, by batch: (batch, codes, counts, classes), packed; and for each bucket of
    words a row with batch null, whose counts are the classes' sizes and distinct rare words (see _sums)."""
    spark = batches.sparkSession
    shared = spark.sparkContext.broadcast((leaders, table))  # LEADERS words at most
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value[0]
        for b in rows:
            for r, sizes, trains, codes in _rows(b):
                words = unpack_words(r["words"])
                w = len(words)
                of = np.array([*(first.get(x, -1) for x in words), END], np.int64)
                rest = of < 0
                of[rest] = [tail(words[i]) for i in np.flatnonzero(rest).tolist()]
                seq = _trained(_sequence(sizes, codes, w), sizes, trains)
                before, after = np.append(END, of[seq[:-1]])[: len(seq)], ALL + np.append(of[seq[1:]], END)[: len(seq)]
                inner = rest[seq]  # the others' classes are known
                at, times = np.unique(np.concatenate([seq[inner] * 2 * ALL + before[inner], seq[inner] * 2 * ALL + after[inner]]), return_counts=True)
                each = np.bincount(at // (2 * ALL), minlength=w)
                start = np.cumsum(each) - each
                n = np.bincount(seq[seq < w], minlength=w)
                out: dict[str, list] = {k: [] for k in ("bucket", "batch", "words", "codes", "counts", "each", "context", "times")}
                for k, own in dictionary.dealt(words, buckets):
                    mine = dictionary.ragged(np.arange(len(at)), start[own], each[own])
                    for name, value in zip(out, (k, r["batch"], dictionary.pack_words([words[i] for i in own]), pack(np.diff(own, prepend=0)), pack(n[own]), pack(each[own]), zlib.compress((at[mine] % (2 * ALL)).astype(np.uint8).tobytes(), 1), pack(times[mine])), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=list(out))

    def classed(given: pa.Table) -> pa.Table:
        first, table = shared.value
        number, codes, n, owner, context, times = dictionary._numbered(), [], [], [], [], []
        for r in given.select(["words", "counts", "each", "context", "times"]).to_pylist():
            words = unpack_words(r["words"])
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            n.append(unpack(r["counts"]).astype(np.int64))
            owner.append(np.repeat(codes[-1], unpack(r["each"]).astype(np.int64)))
            context.append(np.frombuffer(zlib.decompress(r["context"]), np.uint8))
            times.append(unpack(r["times"]).astype(np.int64))
        count = np.bincount(np.concatenate(codes), np.concatenate(n), len(number)).astype(np.int64)
        words = list(number)
        at, inverse = np.unique(np.concatenate(owner) * 256 + np.concatenate(context), return_inverse=True)
        best = best_classes(at >> 8, at & 255, np.bincount(inverse, np.concatenate(times), len(at)), len(words), table)
        kind = np.array([first.get(w, -1) for w in words], np.int64)
        kind = np.where(kind >= 0, kind, np.where(count >= 2, best, -1))
        rare = np.flatnonzero(kind < 0)
        kind[rare] = [tail(words[i]) for i in rare.tolist()]
        sums = np.concatenate([np.bincount(kind, count, ALL), np.bincount(kind, count > 0, ALL)]).astype(np.int64)
        out = {"batch": [*given.column("batch").to_pylist(), None], "codes": [*given.column("codes").to_pylist(), None], "counts": [*(pack(count[c]) for c in codes), sums.astype("<i8").tobytes()], "classes": [*(zlib.compress(kind[c].astype(np.uint8).tobytes(), 1) for c in codes), None]}
        return pa.table({k: pa.array(v, pa.int64() if k == "batch" else pa.binary()) for k, v in out.items()})

    words = batches.select("batch", "words", "sizes", "trains", "codes").mapInArrow(contexts, "bucket int, batch long, words binary, codes binary, counts binary, each binary, context binary, times binary")
    return words.groupBy("bucket").applyInArrow(classed, "batch long, codes binary, counts binary, classes binary")


def _sums(known: DataFrame) -> np.ndarray:
    """The training tokens and the distinct training words of each class."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * ALL, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                out += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(2 * ALL)), "n": pa.array(out)})

    out = np.zeros(2 * ALL, np.int64)
    for r in known.where("batch is null").select("counts").mapInArrow(added, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 2 * ALL rows
        out[r["i"]] = r["n"]
    return out


def score(df: DataFrame, key: str, text: str, training: Callable[[object], bool], batch: int = dictionary.BATCH) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; rows whose key `training` accepts train.

    Tokens are the words, then one end. n_known counts tokens met in training. base_score is the sum over tokens of log10
    of (count + 1) / (N + V + 1), score the model's log10 probability, in which a word not met in training counts as the
    unknown word of its class. Null texts count as empty, with the end alone. Repeated rows stay and count as often as they
    are there, null keys are keys like any other; other columns are ignored. An empty table gives an empty result; without
    training rows all counts are 0.
    """
    spark = df.sparkSession
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    batches = kept(dictionary.whole_batches(rows, split, training, batch), "batches")
    leaders, table = leader_classes(batches, leading_words(batches))
    known = kept(word_classes(batches, leaders, table), "words")
    sums = _sums(known)
    ends = int(batches.select(F.sum(F.size(F.filter("trains", lambda x: x)))).first()[0] or 0)
    size, distinct = sums[:ALL], sums[ALL:]
    bottom = np.maximum(size, 1)
    bottom[CLASSES:END] += distinct[CLASSES:END] + 1
    shared = spark.sparkContext.broadcast(Model(np.log10(bottom), int(size.sum()) + ends, int(distinct.sum()) + (ends > 0), ends))
    kind, name = dictionary._keys(rows)

    def annotated(left: pa.Table, right: pa.Table) -> pa.Table:
        model, about = shared.value, right.to_pylist()
        none = np.zeros(0, np.int64)
        order = np.concatenate([none, *(np.cumsum(unpack(r["codes"]).astype(np.int64)) for r in about)])
        out: dict[str, list] = {k: [] for k in ("keys", "n_tokens", "n_known", "base", "emitted", "classes", "pairs")}
        for r, sizes, trains, codes in (x for b in left.to_batches() for x in _rows(b)):
            w = int(codes.max()) + 1 if len(codes) else 0
            count, of = np.full(w + 1, -1), np.full(w + 1, END)
            count[order[order < w]] = np.concatenate([none, *(unpack(x["counts"]).astype(np.int64) for x in about)])[order < w]
            of[order[order < w]] = np.concatenate([none, *(np.frombuffer(zlib.decompress(x["classes"]), np.uint8) for x in about)])[order < w]
            count[-1], of[-1] = model.ends, END
            if (count < 0).any():
                raise RuntimeError("words of a batch are missing")
            emit = np.log10(np.maximum(count + ((of >= CLASSES) & (of < END)), 1e-9)) - model.bottom[of]
            emit[-1] = 0
            seq, row = _sequence(sizes, codes, w), np.repeat(np.arange(len(sizes)), sizes + 1)
            c, n = of[seq], len(sizes)
            learnt = _trained(c, sizes, trains)
            pairs = np.bincount(np.append(END, learnt[:-1])[: len(learnt)] * ALL + learnt, minlength=ALL * ALL)
            for k, v in zip(out, (r["keys"], (sizes + 1).tolist(), np.bincount(row, count[seq] > 0, n).astype(np.int64).tolist(), np.bincount(row, np.log10(count + 1)[seq], n).tolist(), np.bincount(row, emit[seq], n).tolist(), zlib.compress(c.astype(np.uint8).tobytes(), 1), zlib.compress(pairs.astype("<i8").tobytes(), 1)), strict=True):
                out[k].append(v)
        kinds = (pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    met = batches.drop("words").groupBy("batch").cogroup(known.where("batch is not null").groupBy("batch")).applyInArrow(annotated, f"keys array<{name}>, n_tokens array<long>, n_known array<long>, base array<double>, emitted array<double>, classes binary, pairs binary")
    met = kept(met, "classes")
    dropped(batches)
    dropped(known)

    def pairs(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(ALL * ALL, np.int64)
        for b in given:
            for x in b.column("pairs").to_pylist():
                out += np.frombuffer(zlib.decompress(x), "<i8")
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(out[at])})

    step = transitions(_table(met.select("pairs").mapInArrow(pairs, "pair long, n long"), ALL))
    steps = spark.sparkContext.broadcast(step)

    def scored(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in given:
            for r in b.to_pylist():
                n = np.array(r["n_tokens"], np.int64)
                c = np.frombuffer(zlib.decompress(r["classes"]), np.uint8).astype(np.int64)
                moves = steps.value[np.append(END, c[:-1])[: len(c)], c]  # a text begins after an end
                value = np.bincount(np.repeat(np.arange(len(n)), n), moves, len(n)) + np.array(r["emitted"])
                base = np.array(r["base"]) - n * np.log10(model.tokens + model.distinct + 1)
                yield pa.RecordBatch.from_arrays([pa.array(r["keys"], kind), pa.array(n), pa.array(r["n_known"], pa.int64()), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(value)], names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.drop("pairs").mapInArrow(scored, f"key {name}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
