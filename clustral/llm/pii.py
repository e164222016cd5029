"""Personal data: base patterns, and a bootstrapped search for identifiers in contexts that known ones share.

The base finds e-mail and IP addresses, card and phone numbers. They are seeds, and so are dense tokens: long ones of letters
and digits without a word in them, as keys and digests are. Seeds induce lexical patterns: the two words or = or : signs
before an instance, the two words after it, the word on either side, and the four letters it begins with. All tokens with
digits or an @ are instances; patterns and instances make a graph. Spark scores it in rounds, until no pattern is gained: a
pattern by the lower confidence bound of the share of its distinct instances that are trusted, an instance by its best
pattern. Instances of patterns with a high score that no base pattern has found are added as kind "id". A dense token is
added for its patterns alone, as any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, kept

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, from the operator's contract. A number cannot match from its second digit if it doesn't from its
# first, which the look-behind uses to stay linear; likewise an address from its second letter.
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARKED = re.compile(r"[0-9@]")
_SIGNS = "\"'`=:,;()<>[]{}|!?#$%&*+~^\\"
_CUT = frozenset(_SIGNS + " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000")
_RUN = re.compile("[^" + re.escape("".join(sorted(_CUT))) + "]*")
_NEAR = re.compile(r"\w+|[=:]")
#: Code points on either side of an instance that its context may come from.
NEAR = 80


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap: each @ has one run of characters before it, so one place to begin."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            m = _HOST.match(text, at + 1) if start < at else None
            if m:
                end = m.end()
                out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base's spans by kind, in code points."""
    ip = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    card = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return {"email": emails(text), "ip": ip, "card": card, "phone": phone}


def instances(text: str) -> Iterator[tuple[int, int]]:
    """Spans of all runs without spaces and signs that hold a digit or @; dots, slashes and hyphens at the ends don't count."""
    m = _MARKED.search(text)
    after = 0
    while m:
        start, end = m.start(), _RUN.match(text, m.start()).end()
        while start > after and text[start - 1] not in _CUT:
            start -= 1
        token = text[start:end]
        yield start + len(token) - len(token.lstrip("./-")), end - len(token) + len(token.rstrip("./-"))
        after = end
        m = _MARKED.search(text, end)


def dense(token: str) -> bool:
    """Whether a token is too long and mixed to be a word: 16 letters and digits at least, two of either, nothing else."""
    return len(token) >= 16 and token.isascii() and token.isalnum() and 2 <= sum(map(str.isdigit, token)) <= len(token) - 2


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of an instance. Words are lower-cased; NEAR code points on either side are looked at, and what comes
    after only up to the end of the line."""
    left = _NEAR.findall(text[max(0, start - NEAR) : start].lower())[-2:]
    right = _NEAR.findall(text[end : end + NEAR].split("\n", 1)[0].lower())[:2]
    out = []
    if len(left) == 2:
        out.append(f"before {left[0]} {left[1]}")
    if len(right) == 2:
        out.append(f"after {right[0]} {right[1]}")
    if left and right:
        out.append(f"between {left[-1]} {right[0]}")
    if end - start >= 12 and text[start : start + 4].isalpha() and "@" not in text[start:end]:
        out.append(f"begins {text[start : start + 4]}")
    return out


def _found(df: DataFrame, key: str, text: str) -> DataFrame:
    """For each row its base spans, and its instances with patterns, name and whether they are of the base and seeds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)
        kind = pa.list_(pa.struct([("patterns", pa.list_(pa.int64())), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("seed", pa.bool_())]))
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "found")}
            for t in b.column("text").to_pylist():
                t = t or ""
                spans = base_spans(t)
                for k in KINDS:
                    out[f"n_{k}"].append(len(spans[k]))
                out["base"].append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]))
                seeds = sorted(x for k in KINDS for x in spans[k])
                rest, at = [], 0
                for x, y in instances(t):
                    while at < len(seeds) and seeds[at][1] <= x:
                        at += 1
                    if at == len(seeds) or seeds[at][0] >= y:
                        rest.append((x, y))
                own = [{"patterns": [h(c) for c in contexts(t, x, y)], "instance": h(t[x:y]), "start": x, "end": y, "base": base, "seed": base or dense(t[x:y])} for base, found in ((True, seeds), (False, rest)) for x, y in found]
                out["found"].append(own)
            arrays = [b.column("key"), b.column("content"), *(pa.array(v, kind if k == "found" else pa.string() if k == "base" else pa.int64()) for k, v in out.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "content", *out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("content"), df[text].alias("text")).mapInArrow(rows, f"key {kind}, content long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<patterns: array<long>, instance: long, start: int, end: int, base: boolean, seed: boolean>>")


def patterns(edges: DataFrame, sure: float = 0.8, z: float = 1.64) -> DataFrame:
    """Patterns (pattern, score) whose score is at least `sure`, from edges (pattern, instance, seed).

    A pattern's score is the lower bound, at z standard errors, of the share of its distinct instances that is trusted
    (Wilson's interval): the more instances, the nearer to the share. Seeds count 1; another instance counts its best
    pattern's score if that is at least `sure`. Scores only rise, so rounds end when no pattern is gained. An empty table
    gives an empty result; null patterns and instances are left out.
    """
    edges = edges.where("pattern is not null and instance is not null")
    edges = kept(edges.groupBy("pattern", "instance").agg(F.max(F.coalesce(F.col("seed").cast("double"), F.lit(0.0))).alias("score")), "pii-edges")
    n, share = F.col("n"), F.col("trusted") / F.col("n")
    bound = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    def scored(e: DataFrame) -> DataFrame:
        sums = e.groupBy("pattern").agg(F.sum("score").alias("trusted"), F.count("*").alias("n"))
        return sums.select("pattern", bound.alias("p")).where(F.col("p") >= sure)

    out = kept(scored(edges), "pii-patterns")
    many, before = out.count(), -1
    while many > before:
        gained = edges.join(out, "pattern").groupBy("instance").agg(F.max("p").alias("gain"))
        now = edges.join(gained, "instance", "left").select("pattern", "instance", F.greatest("score", F.coalesce("gain", F.lit(0.0))).alias("score"))
        last, out = out, kept(scored(now), "pii-patterns")
        dropped(last)
        many, before = out.count(), many
    dropped(edges)
    return out.select("pattern", F.col("p").alias("score"))


def extract(df: DataFrame, key: str, text: str, sure: float = 0.8, z: float = 1.64) -> DataFrame:
    """(key, content, n_email, n_ip, n_card, n_phone, base, spans, n_added) for every row.

    content is a hash of the text. base and spans list kind:start:end, by kind and start, in code points; spans also has
    the added ones, kind "id", last. Null texts count as empty and have none. Repeated rows and null keys stay as they are,
    other columns are ignored, an empty table gives an empty result.
    """
    found = kept(_found(df, key, text), "pii")
    each = found.select("key", "content", F.explode("found").alias("f")).select("key", "content", "f.*").withColumn("pattern", F.explode("patterns"))
    good = patterns(each.select("pattern", "instance", "seed"), sure, z)
    fresh = each.where("not base").join(good, "pattern").groupBy("key", "content").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    fresh = fresh.select(F.col("key").alias("k"), F.col("content").alias("c"), "more")
    out = found.join(fresh, found["key"].eqNullSafe(fresh["k"]) & (found["content"] == fresh["c"]), "left")
    added = F.transform("more", lambda x: F.concat(F.lit("id:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(added, ","))
    return out.select("key", "content", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"))


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first that begins."""
    found = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
            at = -e
        else:
            at = max(at, -e)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, key: str, text: str, **options: float) -> DataFrame:
    """df with the personal data in its text column replaced by <KIND>; all rows, repeated ones too, and columns stay, null
    stays null, empty stays empty; an empty table gives an empty table."""
    found = extract(df, key, text, **options).where("spans <> ''").select("key", "content", "spans").distinct()
    found = found.select(F.col("key").alias("__k"), F.col("content").alias("__c"), F.col("spans").alias("__spans"))
    content = F.xxhash64(F.coalesce(df[text], F.lit("")))
    joined = df.join(found, df[key].eqNullSafe(found["__k"]) & (content == found["__c"]), "left")
    names = df.columns

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if t is None or not s else redact(t, s) for t, s in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(text).type) if n == text else b.column(n) for n in names], names=names)

    return joined.select(*names, "__spans").mapInArrow(replaced, df.schema)
