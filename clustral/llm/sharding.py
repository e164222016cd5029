"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends it: on each level every child draws a number from the hash of the
row's key and the child's name, divided by the child's weight, and the smallest draw wins. A child's draw depends on
nothing but the key, its name and its own weight. So when a weight grows, rows move only into that child; when it
shrinks, only out of it; below the children whose weights are unchanged nothing moves.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region name -> rack name -> shard number -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Shards of weight 1, filled rack by rack and region by region."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // shards_per_rack
        out.setdefault(f"r{rack // racks_per_region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u)/weight with u from 52 bits of MD5; the smallest of several such draws falls on each by its weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _first(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The option with the smallest draw; between equal draws the one listed first."""
    options = [x for x in options if x[1] > 0]
    if len(options) == 1:
        return options[0][2]
    draws = [F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(options)]
    won = F.least(*draws)["i"]
    out = options[-1][2]
    for i, (_, _, value) in reversed(list(enumerate(options[:-1]))):
        out = F.when(won == i, value).otherwise(out)
    return out


def place(key: Column, tree: Tree) -> Column:
    """The shard (int) of a row with this string key; null keys count as empty. Weights of 0 or less get no rows."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    weight = lambda x: x if isinstance(x, (int, float)) else math.fsum(map(weight, x.values()))
    regions = []
    for region, racks in tree.items():
        inside = [(f"{region}/{k}", weight(v), _first(key, [(f"{region}/{k}/{s}", w, F.lit(s)) for s, w in v.items()])) for k, v in racks.items() if weight(v) > 0]
        if inside:
            regions.append((region, weight(racks), _first(key, inside)))
    if not regions:
        raise ValueError("the tree has no shard with a weight")
    return _first(key, regions).cast("int")


def shard(df: DataFrame, key: str, text: str, tree: Tree, grown: Tree | None = None, buckets: int = 4096) -> DataFrame:
    """Returns key, size, text_crc32, shard, slot and grown_shard for every row of df.

    size: the text's UTF-8 bytes plus 1 (null text: 1). text_crc32: of the UTF-8 bytes (null: of none). slot: a row's
    place in its shard, from 0 without gaps. grown_shard: the shard under the tree `grown`, null without one.
    Rows with equal keys, null keys included, share a shard. Repeated rows stay and get slots of their own. Slots are
    counted in `buckets` parts of a shard (a power of 16 up to 65536), whose counts alone are summed in one place, so no
    task sorts a whole shard. An empty table gives an empty result.
    """
    digits = round(math.log(buckets, 16))
    rows = df.select(
        df[key].alias("key"),
        (F.coalesce(F.octet_length(df[text]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(df[text], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({"shard": place(F.col("key"), tree), "grown_shard": place(F.col("key"), grown) if grown else F.lit(None).cast("int")})
    spot = F.concat(F.lit("slot|"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("|"), F.col("text_crc32").cast("string"))
    rows = rows.withColumn("bucket", F.conv(F.substring(F.md5(spot), 1, digits), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank)
    placed = ranked.join(starts, (ranked["shard"] == starts["s"]) & (ranked["bucket"] == starts["b"]))
    return placed.select("key", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
