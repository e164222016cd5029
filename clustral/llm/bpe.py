"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

The texts are split by the tokenizer's pattern. The distinct pre-tokens of all batches of rows are shuffled by their
bytes, each is encoded once, the ids go back to the batches and the texts are put together by position (dictionary.py).
Decoding joins the table of the tokens' bytes, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dictionary

#: White space of Unicode, as the pattern's \s means it (fixed values).
_WHITE = r"\t-\r \x85\xa0  -     　"
#: Characters that re's classes treat as the pattern's: Latin letters, ASCII and common signs.
_PLAIN = re.compile(r"[\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token's bytes in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str):
    """The pre-tokens of a text as a function. The pattern may use \\p{L}, \\p{N} and \\s in classes of its own.

    Python's own engine is faster than one that knows \\p{..}, and the same on texts of _PLAIN characters.
    """
    whole = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))
    quick = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
    return lambda text: quick.findall(text) if _PLAIN.fullmatch(text) else whole.findall(text)


def encode(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str, batch: int = dictionary.BATCH) -> DataFrame:
    """(key, ids array<int>) for each row of df; ids are those of encoding each match of the pattern separately.

    Null and empty texts have no ids. Repeated rows and null keys stay as they are, other columns are ignored, an empty
    table gives an empty result. A very long text is a batch of its own.
    """
    import tiktoken  # on the driver and on executors

    rows = dictionary.stable(df.select(df[key].alias("key"), df[text].alias("text")))
    split = splitter(pattern)
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary's size bounds it

    def each_once(table: pa.Table) -> pa.Table:
        coder = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out: dict[str, list] = {"sizes": [], "ids": []}
        for row in table.column("words"):
            lists = []
            for w in dictionary.unpack_words(row.as_py()):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = coder._encode_single_piece(w)
                lists.append(ids)
            out["sizes"].append(dictionary.pack(np.fromiter(map(len, lists), np.int64, len(lists))))
            out["ids"].append(dictionary.pack(np.fromiter((i for x in lists for i in x), np.int64)))
        return pa.table({"batch": table.column("batch"), "codes": table.column("codes"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    words = dictionary.batch_words(rows, split, batch)
    coded = words.groupBy("bucket").applyInArrow(each_once, "batch long, codes binary, sizes binary, ids binary")

    def use(rows: list[dict], order: np.ndarray):
        none = np.zeros(0, np.int64)
        flat = np.concatenate([none.astype("<u4"), *(dictionary.unpack(r["ids"]) for r in rows)])
        got = np.concatenate([none, *(dictionary.unpack(r["sizes"]).astype(np.int64) for r in rows)])
        size, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        size[order], start[order] = got, np.cumsum(got) - got

        def texts(keys: list, sizes: np.ndarray, codes: np.ndarray) -> pa.Table:
            each = size[codes]
            ids = dictionary.ragged(flat, start[codes], each)
            at = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
            return pa.table({"key": pa.array(keys, kind), "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))})

        return texts

    kind, name = dictionary._keys(rows)
    return dictionary.meet(dictionary.batch_texts(rows, split, batch), coded, use, f"key {name}, ids array<int>")


def _decoder(by_id: list[bytes]):
    """A function that joins the bytes of the tokens of one text."""
    table = np.frombuffer(b"".join(by_id), np.uint8)
    size = np.array([len(x) for x in by_id], np.int64)
    start = np.cumsum(size) - size

    def text(ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return dictionary.ragged(table, start[ids], size[ids]).tobytes()

    return text


def _token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return by_id


def decode(df: DataFrame, key: str, ids: str, ranks: dict[bytes, int]) -> DataFrame:
    """(key, data binary) for each row: the tokens' bytes joined. Null ids count as none; an unknown id is an error."""
    shared = df.sparkSession.sparkContext.broadcast(_token_bytes(ranks))  # the vocabulary's size bounds it

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _decoder(shared.value)
        for b in batches:
            lists = b.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([text(flat[at[i] : at[i + 1]]) for i in range(len(lists))], pa.binary())], names=["key", "data"])

    rows = df.select(df[key].alias("key"), F.coalesce(df[ids].cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(texts, f"key {df.schema[key].dataType.simpleString()}, data binary")


def round_trip_digests(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each text, encoded, and decoded from its ids as decode does.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows and null keys stay as they are, other
    columns are ignored, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(_token_bytes(ranks))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _decoder(shared.value)
        for b in batches:
            lists = b.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            ids = [flat[at[i] : at[i + 1]] for i in range(len(lists))]
            sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(text(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.diff(at).astype(np.int64)), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(df, key, text, ranks, pattern).mapInArrow(digests, f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
