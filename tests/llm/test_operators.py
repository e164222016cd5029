"""The operators against brute force, and on nulls, empty and long texts, repeats, ties, empty tables and other columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clustral.llm import bpe, class_model, decontamination, jaccard, jaccard_join, neighbours, pii, repeats, sharding, shared, toxicity, warc
from clustral.llm import text as T
from clustral.llm.suffix_array import common_prefixes, suffix_array

CLASH = "key string, node int, content int, batch int, sig int, freq int"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(60)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs():
    rng = random.Random(6)
    base = [prose(n, rng) for n in (12, 25, 60, 140)]
    rows = [None, "", "   ", "one", "one two", "ONE two", "x" * 3000, prose(4000, rng)]
    for b in base:
        w = b.split()
        rows += [b, b.upper(), b + " end", " ".join(w[1:]), " ".join([*w[:7], "changed", *w[8:]]), prose(9, rng) + " " + b]
    return [*enumerate(rows), (100, rows[10]), (101, rows[10]), (3, "one")]


@pytest.fixture(scope="module")
def table(spark):
    """The documents with columns that clash with names the operators use."""
    rows = [(i, t, "k", 1, 2, 3, 4, 5) for i, t in docs()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(table):
    return table.where("false")


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 60, 3)])
def test_jaccard_classes(table, n, percent, block):
    rows = docs()
    sets = [shingle_set(t, n) for _, t in rows]
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    up = jaccard.Forest(len(rows))
    links = collections.Counter()
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                up.join(i, j)
                links[i] += 1
                links[j] += 1
    low = collections.defaultdict(lambda: 10**9)
    for i, (k, _) in enumerate(rows):
        low[up.root(i)] = min(low[up.root(i)], k)
    want = sorted((k, len(sets[i]), low[up.root(i)], links[i]) for i, (k, _) in enumerate(rows))
    got = jaccard_join.classes(table, "doc_id", "text", n, percent, block).collect()
    assert sorted(map(tuple, got)) == want


def test_jaccard_empty(empty):
    assert jaccard_join.classes(empty, "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.sampled_from([80, 90]), st.integers(0, 1000), st.sampled_from([2, 7, 12, 24]))
def test_near_sets_share_a_signature(n, edits, percent, seed, limit):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n).astype(np.uint64)
    y = x.copy()
    y[: min(edits, n)] = rng.integers(0, 2**63, min(edits, n))
    x, y = np.unique(x), np.unique(y)
    common = len(np.intersect1d(x, y))
    if 100 * common >= percent * (len(x) + len(y) - common):
        assert np.intersect1d(jaccard.signatures(x, percent, limit), jaccard.signatures(y, percent, limit)).size


def test_no_link_is_left_to_chance():
    """Sets at the very threshold that differ where it hurts most: the partner lacks an element of as many segments of the
    first round as it may."""
    rng = np.random.default_rng(17)
    for percent in (80, 90):
        for n in [*range(2, 60), 90, 140, 333, 1200]:
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = jaccard.missing(len(x), percent)  # a subset of the least size that is near
            if not gone:
                continue
            for band, _ in jaccard.bands_of(len(x), percent):
                at = (T.mix(x + np.uint64(band)) % np.uint64(jaccard.segments(band, percent))).astype(int)
                order = np.argsort(-np.bincount(at)[at], kind="stable")
                _, first = np.unique(at[order], return_index=True)
                spoilt = order[np.sort(first)][:gone]
                spoilt = np.concatenate([spoilt, np.setdiff1d(np.arange(len(x)), spoilt)])[:gone]
                y = np.delete(x, spoilt)
                assert np.intersect1d(jaccard.signatures(x, percent, 2), jaccard.signatures(y, percent, 2)).size, (percent, n)


def test_boundary_is_the_cheapest():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        for sizes in ({5: 100}, {12: 100, 25: 1}, {30: 10, 60: 10, 100: 5}, {}):
            limit = jaccard.boundary(sizes, percent)
            sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
            cost = lambda at: sum(m * (jaccard.subsets(n, percent) * (n * percent < at * 100) + jaccard.pieces_of(n, percent) * (n >= at)) for n, m in sizes.items())
            assert cost(limit) == min(map(cost, range(2, 65)))
            assert all(len(np.unique(jaccard.signatures(x, percent, limit))) for x in sets)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (50, 60)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 50: 50, 60: 50}


def test_bit_map(spark):
    ids = spark.createDataFrame([(i * 7919 - 10**6,) for i in range(500)], "x long")
    packed = np.frombuffer(shared.bit_map(ids, "x", 1 << 16), np.int64)
    assert shared.in_bit_map(packed, np.array([i * 7919 - 10**6 for i in range(500)]), 1 << 16).all()
    assert shared.in_bit_map(packed, np.arange(1 << 16), 1 << 16).sum() <= 500


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[5] = x[4]
    x[700:760] = x[4]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [1.0]), (None, [1.0] * 8), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, "vec_id", "embedding", "id % 20 = 0", k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    recall = []
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:10]
        recall.append(len({i for i, _ in found} & set(best)) / 10)
        assert [v for _, v in found] == pytest.approx([s[i] for i, _ in found])
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert np.mean(recall) >= 0.9
    assert neighbours.search(df.where("false"), "vec_id", "embedding", "true").count() == 0


def test_neighbours_of_grown_leaves(spark):
    """A tree of a small sample: leaves have grown and are split where they meet; groups are many; other columns clash."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 12)) + 3 * rng.normal(size=(40, 12))[rng.integers(0, 40, 4000)]
    df = spark.createDataFrame([(i, [float(a) for a in v], "x", 1, [1]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, leaf string, id int, v array<int>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, "vec_id", "embedding", "id % 50 = 0", k=20, sample=300, group=500, grown=60).collect():
        got[r["query_id"]].append(r["vec_id"])
    recall = [len(set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, x @ x[q]))[:20].tolist()) & set(got[q])) / 20 for q in range(0, 4000, 50)]
    assert np.mean(recall) >= 0.9 and all(len(set(v)) == 20 for v in got.values())
    assert neighbours.grouped({0: 3, 1: 5, 2: 25, 4: 1, 9: 2}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 4: (4, 1), 9: (4, 1)}


def test_contained(spark, table, empty):
    texts = dict(docs())
    items = [(0, texts[14]), (1, "one two"), (2, None), (3, ""), (4, prose(30)), (5, " ".join(texts[20].split()[3:40]).upper())]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    want = set()
    for k, t in docs():
        w = (t or "").lower().split()
        for i, item in items:
            s = shingle_set(item, 5)
            own = {tuple(w[a : a + z]) for z in {len(x) for x in s} for a in range(len(w) - z + 1)}
            if s and 100 * len(s & own) >= 80 * len(s):
                want.add((k, i, len(s), len(s & own)))
    got = decontamination.contained(table, "doc_id", "text", bench, "item_id", "text")
    assert {tuple(r) for r in got.collect()} == want and len({i for _, i, _, _ in want}) >= 3
    assert decontamination.contained(empty, "doc_id", "text", bench, "item_id", "text").count() == 0
    assert decontamination.contained(table, "doc_id", "text", bench.where("false"), "item_id", "text").count() == 0


def test_contained_with_other_ids(spark):
    text = prose(40)
    docs_ = spark.createDataFrame([("a", text), (None, text), ("b", "nothing here"), ("a", text)], "doc_id string, text string")
    items = spark.createDataFrame([("x", text, "t"), (None, text, "t"), ("y", prose(12), "t")], "item_id string, text string, doc_id string")
    got = collections.Counter((r["key"], r["item_id"]) for r in decontamination.contained(docs_, "doc_id", "text", items, "item_id", "text").collect())
    assert got == {("a", "x"): 2, ("a", None): 2, (None, "x"): 1, (None, None): 1}


def test_bpe_with_other_keys_and_columns(spark, table):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = [("a", "one two", [1], 2), (None, "three", [2], 3), ("a", None, [3], 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, ids array<int>, batch int")
    coded = bpe.encode(df, "doc_id", "text", ranks, public_tokenizers.PATTERN)
    got = sorted((r["key"] or "", bytes(r["data"])) for r in bpe.decode(coded, "key", "ids", ranks).collect())
    assert got == [("", b"three"), ("a", b""), ("a", b"one two")]
    assert bpe.encode(table, "doc_id", "text", ranks, public_tokenizers.PATTERN).count() == len(docs())
    none = spark.createDataFrame([(1, None, b"x")], "doc_id long, ids array<int>, data binary")
    assert bytes(bpe.decode(none, "doc_id", "ids", ranks).first()["data"]) == b""
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), "doc_id", "ids", ranks).collect()


def test_bpe(spark, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    assert len(ranks) == sum(1 for _ in open(path, "rb")) and ranks[base64.b64decode(b"IQ==")] >= 0
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = docs() + list(enumerate(["don't  stop\n\n x²½ Ⅷ a　b \x1c y\x85z", "日本語 テキスト ١٢٣ é __a_b  ", " " * 300 + "x", "'sfoo 'll 'S\t\t\n!!'s _'s", "👍🏽 ﬁ ª º µ ·", "\x00\x01"], 300))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coded = bpe.encode(df, "doc_id", "text", ranks, public_tokenizers.PATTERN, batch=2000)
    want = sorted((k, enc.encode_ordinary(t or "")) for k, t in rows)
    assert sorted((r["key"], list(r["ids"])) for r in coded.collect()) == want
    back = {r["key"]: bytes(r["data"]) for r in bpe.decode(coded, "key", "ids", ranks).collect()}
    assert back == {k: (t or "").encode() for k, t in rows}
    digests = {r["key"]: tuple(r)[1:] for r in bpe.round_trip_digests(df, "doc_id", "text", ranks, public_tokenizers.PATTERN).collect()}
    assert digests == {k: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((dict(rows)[k] or "").encode()).hexdigest()) for k, i in want}
    assert bpe.encode(empty, "doc_id", "text", ranks, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=30))
def test_suffix_array(letters):
    t = [*letters, 0]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    assert suffix_array(t) == order
    for r, k in enumerate(common_prefixes(t, order)):
        a, b = t[order[r] :], t[order[r - 1] :]
        assert k == (0 if not r else next(i for i in range(len(a) + 1) if a[: i + 1] != b[: i + 1] or i == min(len(a), len(b))))


def test_repeats(spark, empty):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(300, 1500))) for _ in range(10)]
    rows = [(0, None), (1, ""), (2, "a" * 3000), (3, "ab" * 900), (4, "b" + "ab" * 500), (5, "x" * 399), (6, "x" * 400), (7, "x" * 401)]
    for i in range(8, 70):
        rows.append((i, "".join(rng.choice(base)[rng.randint(0, 200) :][: rng.randint(200, 1200)] + prose(rng.randint(0, 20), rng) for _ in range(rng.randint(1, 4)))))
    rows += [(200, rows[50][1]), (201, rows[50][1])]
    count = collections.Counter(b[p : p + 400] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 399))
    want = {}
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, "doc_id", "text").collect()}
    assert got == want
    assert repeats.remove_repeats(empty, "doc_id", "text").count() == 0


def test_repeats_with_other_keys_and_columns(spark):
    long = prose(300)
    rows = [(None, long, 1, 2, 3), ("a", long, 4, 5, 6), ("a", long, 4, 5, 6), ("b", prose(20), 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string, content int, ranges int, h int")
    got = sorted(((r["key"] or "", r["n_bytes"] - r["n_removed"]) for r in repeats.remove_repeats(df, "doc_id", "text").collect()))
    assert got == [("", 0), ("a", 0), ("a", 0), ("b", len(rows[3][1]))]


def test_repeats_of_short_and_long_texts(spark):
    # two k-grams whose hashes are the smallest here and differ in their last 21 bits only, the larger one first
    rng = random.Random(1)
    low, high = "mbakwswiitcueofhasshlejtncsdttrkbzdwtuiwvpgklovveadckwujppqmjhhd", "fstgxcdprmalzldyghrfclnydcinllacezsorpgnvmwnazignggykmitmjzvxier"
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    same = digits(120) + high + low + digits(152)
    rows = [(1, same), (2, digits(1 << 20) + same + digits(5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["key"]: (r["n_removed"], r["n_spans"], len(r["kept"])) for r in repeats.remove_repeats(df, "doc_id", "text").collect()}
    assert got == {1: (400, 1, 0), 2: (400, 1, len(rows[1][1]) - 400)}


def test_equal_windows_compares_bytes(monkeypatch):
    data = np.frombuffer(b"abcdXabcdYbcde" + b"z" * 9, np.uint8)
    want = [p for p in range(20) if any(q != p and data[p : p + 3].tobytes() == data[q : q + 3].tobytes() for q in range(20))]
    for many in (1 << 60, 3, 1):  # the fewer hashes there are, the more collide
        monkeypatch.setattr(repeats, "span_hash", lambda s, a, b, many=many: T.span_hash(s, a, b) % np.uint64(many))
        got = repeats.equal_windows(data, np.arange(20), T.prefix_hash(data), 3)
        assert sorted(got.tolist()) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.9 1-+()é%\n0", max_size=40))
def test_base_patterns(text):
    spans = pii.base_spans(text)
    assert spans["email"] == [m.span() for m in EMAIL.finditer(text)]
    assert spans["ip"] == [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]


def wilson(trusted, n, z=1.64):
    p = trusted / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_pii_finds_unseen_identifiers(spark, empty):
    """With production parameters: identifiers of a form that no seed has, and none in clean texts."""
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, prose(rng.randint(3, 30), rng) + f' secret = "{key()}1a" ' + prose(rng.randint(3, 30), rng)) for i in range(80)]
    unseen = ["hunter2", "x9-pw", "Tr0ub4dor&3"[:9], "correct.horse1", "p4ss"]
    planted = {100 + i: f"{prose(5, rng)} secret={u} {prose(6, rng)}" for i, u in enumerate(unseen)}
    clean = {200 + i: f"{prose(4, rng)} version {i}.{rng.randint(0, 9)} and room {rng.randint(1, 400)} {prose(5, rng)}" for i in range(60)}
    clean |= {300: None, 301: "", 302: "é a@b.co, +358 40 123 4567; 10.0.0.1", 303: "no data"}
    rows += [*planted.items(), *clean.items(), (100, planted[100])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, content string, pattern int").repartition(3)
    got = collections.defaultdict(list)
    for r in pii.extract(df, "doc_id", "text").collect():
        got[r["key"]].append(r)
    assert len(got[100]) == 2 and sum(map(len, got.values())) == len(rows)
    for i, u in enumerate(unseen):
        at = planted[100 + i].index(u)
        assert got[100 + i][0]["spans"] == f"id:{at}:{at + len(u)}", u
    assert all(got[i][0]["n_added"] == 1 for i in range(80)) and all(r["n_added"] == 0 for i in clean for r in got[i])
    assert got[302][0]["base"] == got[302][0]["spans"] == "email:2:8,ip:28:36,phone:10:26"
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df, "doc_id", "text").collect()}
    assert out[100] == planted[100].replace("hunter2", "<ID>") and out[300] is None and out[302] == "é <EMAIL>, <PHONE>; <IP>"
    assert pii.redact("abc", "id:0:2,card:1:3") == "<ID>"
    assert pii.extract(empty, "doc_id", "text").count() == 0 and pii.redacted(empty, "doc_id", "text").count() == 0


def test_pattern_scores_by_brute_force(spark):
    rng = random.Random(4)
    edges = {(rng.randint(0, 25), rng.randint(0, 90)) for _ in range(700)}
    edges |= {(100, i) for i in range(1000, 1020)} | {(101, i) for i in range(1018, 1032)} | {(102, i) for i in range(1031, 1060)}
    seeds = {i for i in range(91) if rng.random() < 0.93} | set(range(1000, 1018)) | set(range(1020, 1031)) | set(range(1033, 1060))
    score = {i: float(i in seeds) for _, i in edges}
    good, rounds = {}, 0
    while True:
        by = collections.defaultdict(list)
        for p, i in edges:
            by[p].append(score[i])
        now = {p: w for p, v in by.items() if (w := wilson(sum(v), len(v))) >= 0.8}
        for p, i in edges:
            score[i] = max(score[i], now.get(p, 0.0))
        rounds += 1
        if len(now) == len(good):
            break
        good = now
    df = spark.createDataFrame([(p, i, i in seeds) for p, i in edges] + [(None, 3, True), (3, None, True)], "pattern long, instance long, seed boolean")
    got = {r["pattern"]: r["score"] for r in pii.patterns(df).collect()}
    assert rounds > 2 and got.keys() == now.keys() and 0 < len(got) < len({p for p, _ in edges})
    assert pii.patterns(df.where("false")).count() == 0


CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 -+().x", max_size=60))
def test_cards_and_phones(text):
    def checks(digits):
        total = 0
        for k, d in enumerate(reversed(digits)):
            d = int(d) * (1 + k % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    digits = lambda t: re.sub(r"[^0-9]", "", t)
    spans = pii.base_spans(text)
    assert spans["card"] == [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and checks(digits(m[0]))]
    assert spans["phone"] == [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.1 =-/é\"\n", max_size=40))
def test_instances_by_brute_force(text):
    want = []
    for m in re.finditer(r"[^\s\"=]+", text):
        if re.search("[0-9@]", m[0]):
            a, b = m.span()
            want.append((a + len(m[0]) - len(m[0].lstrip("./-")), b - len(m[0]) + len(m[0].rstrip("./-"))))
    assert list(pii.instances(text)) == want


def test_long_runs_stay_linear():
    for long in ("a", "1", "1.", "+1", "1 ", "a@", "a1", "-"):
        text = long * 200_000
        spans = pii.base_spans(text)
        assert spans["email"] == [] and len(spans["ip"]) == (50_000 if long == "1." else 0) and len(list(pii.instances(text))) <= 200_000


def test_shards(spark, table, empty):
    tree, more = sharding.even_tree(8), sharding.even_tree(9)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(table.select("doc_id", "text")).union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    got = sharding.shard(rows, "doc_id", "text", tree, more).collect()
    assert len(got) == 4000 + len(docs()) + 1
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and min(map(len, by.values())) > 380
    assert 300 < sum(r["grown_shard"] == 8 for r in got) < 600
    heavy = {"r0": {"k0": {0: 3.0, 1: 1.0}}}
    share = [r["shard"] for r in sharding.shard(rows, "doc_id", "text", heavy).collect()]
    assert 0.7 < share.count(0) / len(share) < 0.8
    assert {r["size"]: r["text_crc32"] for r in got}[2] == zlib.crc32(b"t") and sharding.shard(empty, "doc_id", "text", tree).count() == 0


def test_shards_of_long_texts(spark):
    rows = spark.createDataFrame([(1, "é" * 2_000_000), (2, None), (3, "")], "doc_id long, text string")
    got = {r["key"]: (r["size"], r["text_crc32"]) for r in sharding.shard(rows, "doc_id", "text", sharding.even_tree(8)).collect()}
    assert got == {1: (4_000_001, zlib.crc32(("é" * 2_000_000).encode())), 2: (1, 0), 3: (1, 0)}


def test_class_model(spark, table, empty):
    learns = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    rows = docs()
    count, ends = collections.Counter(), 0
    for k, t in rows:
        if learns(k):
            count.update((t or "").lower().split())
            ends += 1
    total, kinds = sum(count.values()) + ends, len(count) + 1
    got = class_model.score(table, "doc_id", "text", learns, batch=3000).collect()
    want = collections.defaultdict(list)
    for k, t in rows:
        w = (t or "").lower().split()
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
        want[k].append((len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(base, 6)))
    have = collections.defaultdict(list)
    for r in got:
        have[r["key"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert class_model.score(empty, "doc_id", "text", learns).count() == 0


def test_class_model_by_brute_force(spark):
    """Every word twice in training or more has a class of the exchange, also beyond the leaders; the best by its contexts;
    scores are those of a plain bigram model over these classes."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(1600)]
    draw = lambda n: " ".join(vocabulary[min(1599, int(rng.expovariate(1 / 300)))] for _ in range(n))
    rows = [(f"k{i}", draw(rng.randint(0, 120))) for i in range(300)] + [(None, "w1 w2 new"), ("k1", "once"), ("k1", "once")]
    learns = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id string, text string, key string, batch int").repartition(3)
    given = df.select(F.col("doc_id").alias("key"), "text")
    batches = shared.kept(class_model.dictionary.whole_batches(given, class_model.split, learns, 4000), "test")
    lead = class_model.leading_words(batches)
    first, table = class_model.leader_classes(batches, lead)
    words = {(r["batch"], i): w for r in batches.collect() for i, w in enumerate(class_model.unpack_words(bytes(r["words"])))}
    of, count = {}, {}
    for r in class_model.word_classes(batches, first, table).where("batch is not null").collect():
        for i, n, c in zip(np.cumsum(class_model.unpack(bytes(r["codes"])).astype(int)).tolist(), class_model.unpack(bytes(r["counts"])).tolist(), zlib.decompress(bytes(r["classes"])), strict=True):
            w = words[r["batch"], i]
            assert of.setdefault(w, c) == c and count.setdefault(w, n) == n
    train = [class_model.split(t) for k, t in rows if learns(k)]
    true = collections.Counter(w for t in train for w in t)
    assert all(count[w] == true[w] for w in count) and len(lead) == class_model.LEADERS and len(of) > 1300
    start = {w: first.get(w, class_model.tail(w)) for w in of}
    beside = collections.defaultdict(collections.Counter)
    for t in train:
        c = [class_model.END, *(start[w] for w in t), class_model.END]
        for i, w in enumerate(t):
            beside[w].update([(0, c[i]), (1, c[i + 2])])
    log, size = np.log(table + 0.5), np.log(table.sum(0) + 1)
    for w in of:
        if w not in first:
            gains = [sum(n * (log[d, c] if side == 0 else log[c, d]) for (side, d), n in beside[w].items()) - 2 * true[w] * size[c] for c in range(class_model.CLASSES)]
            assert gains[of[w]] >= max(gains) - 1e-6 if true[w] >= 2 else of[w] == class_model.tail(w)
        else:
            assert of[w] == first[w]
    seen = collections.Counter(p for t in train for c in [[class_model.END, *(of[w] for w in t), class_model.END]] for p in zip(c, c[1:], strict=False))
    pairs = np.zeros((class_model.ALL,) * 2)
    for p, n in seen.items():
        pairs[p] = n
    step = class_model.transitions(pairs)
    assert (10**step).sum(1) == pytest.approx(1)
    mass = collections.Counter()
    for w, n in true.items():
        mass[of[w]] += n + (of[w] >= class_model.CLASSES)
    want = collections.defaultdict(list)
    for k, t in rows:
        w = class_model.split(t)
        c = [class_model.END, *(of[x] for x in w), class_model.END]
        emitted = sum(math.log10((true[x] + (of[x] >= class_model.CLASSES)) / (mass[of[x]] + (of[x] >= class_model.CLASSES))) for x in w)
        want[k].append(round(emitted + sum(step[p] for p in zip(c, c[1:], strict=False)), 6))
    got = collections.defaultdict(list)
    for r in class_model.score(df, "doc_id", "text", learns, batch=4000).collect():
        got[r["key"]].append(round(r["score"], 6))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_leading_words_count_in_every_batch(spark):
    """A word that leads in no batch leads by its sum over the batches; texts that don't train don't count."""
    texts = [" ".join(f"own{i}x{j} own{i}x{j} own{i}x{j}" for j in range(4100)) + " wide wide partly partly" + " partly" * (i == 0) * 2 for i in range(4)]
    rows = [*enumerate(texts), (4, "held " * 50), (5, None)]
    given = spark.createDataFrame(rows, "key long, text string").repartition(2)
    batches = shared.kept(class_model.dictionary.whole_batches(given, class_model.split, lambda k: k != 4, 1), "test")
    count = collections.Counter(w for t in texts for w in class_model.split(t))
    want = sorted(count, key=lambda w: (-count[w], w))[: class_model.LEADERS]
    assert want[:2] == [b"partly", b"wide"] and class_model.leading_words(batches) == want


def test_class_model_without_training_rows(table):
    got = class_model.score(table, "doc_id", "text", lambda _: False).collect()
    assert len(got) == len(docs()) and all(r["n_known"] == r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)


def test_exchange_finds_alternating_classes():
    counts = np.zeros((53, 53))
    counts[:10, 10:20], counts[10:20, :10] = 5, 5
    of = class_model.exchange(counts, 20, classes=2)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10]


def test_batches_that_differ_are_an_error(spark):
    rows = spark.createDataFrame([(i, prose(9)) for i in range(20)], "key long, text string")
    texts = class_model.dictionary.batch_texts(rows.coalesce(1), str.split, 200)
    words = class_model.dictionary.batch_words(rows.coalesce(1), str.split, 500)
    with pytest.raises(Exception, match="same batches"):
        class_model.dictionary.meet(texts, words, lambda rows, order: lambda k, s, c: pa.table({"n": [1]}), "n long").collect()


def test_warc(spark, empty):
    long = "<p>" + "ü" * 9000 + "</p>"
    rows = [(5, "http://a/", long), (3, None, long), (9, "http://b c/\r\n", long), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 40), (3, "u", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_and_read(df, segment=512, chunk=100).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [h or "" for i, _, h in rows if i == r["page_id"]]
        assert r["payload_digest"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts} and r["payload_bytes"] == len(texts[0].encode())
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(5, 3), (9, 3)]
    assert warc.archive_and_read(df.where("false")).count() == 0
    named = spark.createDataFrame([("a b/ü\n", "u", long), (None, "u", long), ("", "u", long), ("z", "u", None)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_and_read(named, segment=512, chunk=100).collect()}
    size = len(long.encode())
    assert got == {"": ("response", None, size), "a b/ü\n": ("revisit", "", size), None: ("response", None, size), "z": ("response", None, 0)}
    huge = spark.createDataFrame([(1, "u", "ä" * 3_000_000)], "page_id long, url string, html string")
    assert warc.archive_and_read(huge).first()["payload_bytes"] == 6_000_000


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 70))
def test_chunks(body, size):
    framed = warc.chunked(body, size)
    assert warc.dechunked(framed) == body
    with pytest.raises(ValueError):
        warc.dechunked(framed[: len(framed) - 4] if len(framed) > 9 else b"5\r\nab")


def test_missing_segment(spark, tmp_path):
    import gzip

    parts = warc.page_records(1, "u", b"y" * 3000, hashlib.sha256(b"y" * 3000).hexdigest(), None, "0" * 32, 500, 100)
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(p + warc.END for p in [*parts[:2], *parts[3:]])))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, str(tmp_path)).collect()


def test_toxicity(spark, table, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng.randint(5, 60), rng) + (" you grumblewort " if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), "text", "label")
    fresh = spark.createDataFrame([(0, prose(30) + " grumblewort!"), (1, prose(30)), (2, None), (3, "")], "doc_id long, text string")
    s = {r["key"]: r["score"] for r in toxicity.score(fresh, "doc_id", "text", model).collect()}
    assert s[0] > 0.5 > 0.3 > s[1] and s[2] == s[3] and 0 <= min(s.values()) <= max(s.values()) <= 1
    assert toxicity.score(table, "doc_id", "text", model).count() == len(docs()) and toxicity.score(empty, "doc_id", "text", model).count() == 0
    assert toxicity.fit(fresh.withColumn("label", F.lit(0)), "text", "label").weights.any() == np.False_
    assert toxicity.keep_below(fresh, "text", model, 0.3).count() == 3


def test_toxicity_fit_is_the_optimum():
    """The penalised loss, written out for a dense matrix, has no slope at what solve finds."""
    rng = np.random.default_rng(3)
    hit = rng.random((300, 32)) < 0.3
    label = (hit[:, 3] | (hit[:, 7] & (rng.random(300) < 0.7))).astype(float)
    blocks = []
    for i in range(0, 300, 100):
        buckets, rows = np.nonzero(hit[i : i + 100].T)
        blocks.append((label[i : i + 100], np.bincount(buckets, minlength=32).astype("<u2"), rows.astype(np.uint8)))
    model = toxicity.solve(lambda f, x: sum(f(x, b) for b in blocks), (5,), 5, 3.0, 200)
    p, q = hit[label == 1].sum(0) + 1, hit[label == 0].sum(0) + 1
    ratio = np.log(p / (label.sum() + 2)) - np.log(q / ((1 - label).sum() + 2))
    x = hit * ratio
    w = model.weights / ratio
    miss = 1 / (1 + np.exp(-(x @ w + model.bias))) - label
    assert np.abs(x.T @ miss + 3.0 * w).max() < 0.5 and abs(miss.sum()) < 0.5 and np.abs(x.T @ (0.5 - label)).max() > 20
    assert np.allclose(model.score(*np.nonzero(hit), 300), 1 / (1 + np.exp(-(x @ w + model.bias))))


def test_toxicity_never_learns_from_held_out_rows(spark):
    from clustral.llm import queries

    rng = random.Random(12)
    rows = [(i, prose(rng.randint(5, 40), rng) + (" grumblewort" if i % 4 == 0 else ""), i % 4 == 0) for i in range(200)]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    docs = spark.createDataFrame([(i, t, "toxic", 9) for i, t, _ in rows] + [(None, "x", "", 0), (7, rows[7][1], "", 1)], "doc_id long, text string, lang string, label int")
    frame = lambda pairs: spark.createDataFrame([(*p, 5) for p in pairs], "doc_id long, toxic int, label int")
    honest = frame([(i, int(y)) for i, _, y in rows] + [(None, 1), (3, None)])
    lying = frame([(i, int(y != (i in held))) for i, _, y in rows] + [(4, 1)])
    a, b = queries.toxicity_model(spark, docs, honest), queries.toxicity_model(spark, docs, lying)
    assert held and np.allclose(a.weights, b.weights, atol=1e-6) and abs(a.bias - b.bias) < 1e-6 and a.weights.any()
    scores = {r["key"]: r["score"] for r in toxicity.score(docs, "doc_id", "text", a).collect()}
    assert all((scores[i] >= 0.3) == y for i, _, y in rows)
    few = queries.toxicity_model(spark, docs, honest, rows=30)
    assert not np.allclose(few.weights, a.weights)


def test_toxic_words_count_anywhere(spark):
    """One-word texts, the first word, words without spaces around them."""
    rng = random.Random(2)
    bad = (" grumblewort", "-grumblewort", "罵倒する言葉だ", "彼は罵倒する言葉だと")
    rows = [(prose(rng.randint(0, 30), rng) + (bad[i // 2 % 4] if i % 2 else ""), i % 2) for i in range(800)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), "text", "label")
    texts = ["grumblewort", "Grumblewort " + prose(5), "a-grumblewort/b", "彼は罵倒する言葉だと言う", prose(6), "日本語の文"]
    s = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", model).orderBy("key").collect()]
    assert min(s[:4]) > 0.3 > max(s[4:])


def test_shingles_by_brute_force():
    rows = [t for _, t in docs()]
    data, off = T.flat(pa.array(rows, pa.string()))
    values, at = T.shingles(data, off, 3)
    assert np.diff(at).tolist() == [len(shingle_set(t, 3)) for t in rows]
    a = T.set_hash(values, at)
    assert a[8] == a[9] and a[5] == a[4] and len(set(a.tolist())) < len(a)


def test_toxicity_sees_every_word(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    rows = [(i, "grumblewort-" * (i % 3 == 0) + "/".join(rng.choice(words, 30)), int(i % 3 == 0)) for i in range(200)]
    rows += [(i, "scum" if i % 2 else "fine", i % 2) for i in range(200, 300)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), "text", "label")
    fresh = spark.createDataFrame([(0, "grumblewort"), (1, "/".join(words[:20])), (2, "SCUM"), (3, "fine")], "doc_id long, text string")
    s = {r["key"]: r["score"] for r in toxicity.score(fresh, "doc_id", "text", model).collect()}
    assert min(s[0], s[2]) > 0.5 > max(s[1], s[3])


def test_toxicity_features_by_brute_force():
    texts = ["Ab", "", "one two three", "一二三四五六七八", "x" * 9]
    data, off = T.flat(pa.array(texts))
    (_, _, r, _), = toxicity.features(data, off, (5, 7), 18)
    grams = [{t[i : i + n] for n in (5, 7) for i in range(len(t) - n + 1)} or {t} - {""} for t in texts]
    assert np.bincount(r, minlength=5).tolist() == [len(g) for g in grams]
