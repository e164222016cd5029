"""Helpers of this subpackage: the shared folder, columns, bounded bit maps and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no shared folder and driver and executors are one process, as in tests.
OWN_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a local run gets a folder of its own;
    a cluster has none that could be guessed, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = OWN_FOLDER
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what kept wrote; for tables that nothing returned to the caller reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns an operator needs, under its own names: others, clashing ones included, never reach it."""
    return df.select(*(df[old].alias(new) for new, old in names.items()))


def bit_map(ids: DataFrame, column: str, bits: int = 1 << 23) -> bytes:
    """A bit for each pmod(xxhash64(id), bits) that occurs, built by the executors: at most bits/63 rows reach the
    driver, whatever the input's size. It may say yes for an id that is not there, never no for one that is."""
    place = F.pmod(F.col(column), F.lit(bits))
    rows = (
        ids.select(place.alias("p"))
        .groupBy(F.expr("p div 63").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 63 as int)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros((bits + 62) // 63, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return out.tobytes()


def in_bit_map(packed: np.ndarray, ids: np.ndarray, bits: int = 1 << 23) -> np.ndarray:
    """Which of the int64 ids have their bit set; packed is bit_map's result as int64."""
    p = np.mod(ids, bits)
    return (packed[p // 63] >> (p % 63)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of int64 nodes to (node, component), component being the smallest node reachable.

    Alternates large-star and small-star, so that the rounds grow with the logarithm of a component's diameter. Each
    round is written to the shared folder. Hot nodes cost no memory: the smallest neighbour comes from a partial
    aggregate and is joined back. An empty table gives an empty table.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least(F.col("a"), F.col("m")).alias("m"))
        joined = both.join(low, both["a"] == low["x"])
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("x").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, said = None, digest(now)
    while said != before and said[0]:
        last, now = now, kept(star(star(now, True), False), "edges")
        dropped(last)
        before, said = said, digest(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
