"""Files of vectors, codebooks, partitions and graphs: readers, writers and text quantisation.

Text is read and written by Spark, line by line. The binary formats have records of variable length after a header, so a
file is read by one task (large sets belong in Parquet). Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

# Fixed values of the formats: the first words of a file, and the line that ends a header.
CODEBOOK, TRAINING, PARTITION, GRAPH = "VQ CODEBOOK", "VQ TRAINING SET", "VQ PARTITIONING", "Graph v."
DASHES = "-------------------------------------"


# text vectors


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that hold data: blank ones and those that begin with % or # are left out."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s*([%#].*)?$")).select(F.trim("value").alias("line"))


def raw_vectors(spark: SparkSession, path: str) -> DataFrame:
    """x array<double> of each line; an element that is no number is null."""
    parts = F.split("line", r"\s+")
    return raw_lines(spark, path).select(F.transform(parts, lambda s: s.try_cast("double")).alias("x"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """One row: dim (the longest line's), rows, complete rows, low, high, and whether the first or last column holds
    integers of at least 1 and so may be weights."""
    x = raw_vectors(spark, path)
    dim = x.agg(F.max(F.size("x"))).first()[0] or 0
    good = (F.size("x") == dim) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e))
    whole = lambda e: e.isNotNull() & (e >= 1) & (e == F.floor(e))
    low, high = F.min(F.when(good, F.array_min("x"))), F.max(F.when(good, F.array_max("x")))
    return x.agg(F.lit(dim).alias("dim"), F.count("*").alias("rows"), F.count_if(good).alias("complete"), low.alias("low"), high.alias("high"), F.min(F.when(good, whole(F.get("x", F.lit(0))))).alias("first_is_freq"), F.min(F.when(good, whole(F.element_at("x", -1)))).alias("last_is_freq"))


def read_text(spark: SparkSession, path: str, maxval: int = V.MAXVAL) -> tuple[DataFrame, float, float]:
    """(id, v, freq) of the complete lines, quantised from the range of all dimensions together, and that range.

    Ids follow the order of lines in the file, with gaps. Incomplete lines and those with other things than numbers are
    left out; profile counts them.
    """
    about = profile(spark, path).first()
    low, high = float(about["low"] or 0), float(about["high"] or 0)
    x = raw_vectors(spark, path).where((F.size("x") == about["dim"]) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e)))
    return x.select(F.monotonically_increasing_id().alias("id"), V.quantise(F.col("x"), F.lit(low), F.lit(high), maxval).alias("v"), F.lit(1).cast("bigint").alias("freq")), low, high


def read_floats(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(id, x array<double>) of the complete lines, and how many were dropped because attributes are missing."""
    about = profile(spark, path).first()
    rows = raw_vectors(spark, path).where((F.size("x") == about["dim"]) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e)))
    return rows.select(F.monotonically_increasing_id().alias("id"), "x"), about["rows"] - about["complete"]


def precision(low: float, high: float, maxval: int) -> int:
    """Digits after the point that show a step of the quantisation."""
    import math

    step = (high - low) / maxval if maxval else 0
    return max(0, 1 - int(math.log10(step))) if 0 < step < 1 else 0


def write_text(df: DataFrame, path: str, low: float = 0.0, high: float | None = None, maxval: int = V.MAXVAL, repeat: bool = False) -> None:
    """The vectors in the original scale, a line each, or as many as freq says. high None: the integers as they are."""
    rows = df.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("freq", F.lit(1).cast("bigint"))))) if repeat else df
    if high is None:
        line = F.array_join(F.transform("v", lambda x: x.cast("string")), " ")
    else:
        digits = precision(low, high, maxval)
        line = F.array_join(F.transform(V.dequantise(F.col("v"), F.lit(low), F.lit(high), maxval), lambda x: F.format_string(f"%.{digits}f", x)), " ")
    rows.select(line.alias("value")).write.text(path)


# binary codebooks and training sets


def parse_codebook(data: bytes) -> tuple[dict, list[tuple[str | None, list[int], int]]]:
    """The header and the records (name, v, freq) of a file of version 0, 1 or 2; ValueError if it is cut short."""
    lines, at = [], 0

    def line() -> str:
        nonlocal at
        end = data.index(b"\n", at)
        lines.append(data[at:end].decode("latin-1"))
        at = end + 1
        return lines[-1]

    version = re.search(r"\d", line())
    if not version or int(version[0]) > 2:
        raise ValueError("no known version in the header")
    new = int(version[0]) == 2
    names = ("block_x", "block_y", "size", "total_freq", "bytes", "low", "high", "preprocessing") if new else ("block_x", "block_y", "size", "preprocessing", "_1", "_2", "_3", "high")
    head: dict = {"version": lines[0]} | {k: int(line()) for k in names}
    head |= {} if new else {"bytes": 1, "low": 0}
    text = line()
    head["method"] = "" if text.startswith("-") else text
    if not text.startswith("-"):
        line()
    dim, order, wide = head["block_x"] * head["block_y"], "big" if new else "little", 4 if new else 2
    out = []
    for _ in range(head["size"]):
        name = None
        if new:
            end = data.index(b"\0", at)
            name, at = data[at:end].decode("utf-8", "replace") or None, end + 1
        stop = at + dim * head["bytes"] + wide
        if stop > len(data):
            raise ValueError("the file ends before its last record")
        v = [int.from_bytes(data[i : i + head["bytes"]], order) for i in range(at, stop - wide, head["bytes"])]
        out.append((name, v, int.from_bytes(data[stop - wide : stop], order)))
        at = stop
    return head, out


def format_codebook(rows: list[tuple[str | None, list[int], int]], training: bool = False, method: str = "") -> bytes:
    """A file of version 2 with as many bytes an element as the largest needs."""
    high = max((max(v) for _, v, _ in rows), default=0)
    low = min((min(v) for _, v, _ in rows), default=0)
    wide = max(1, (int(high).bit_length() + 7) // 8)
    dim = len(rows[0][1]) if rows else 0
    head = [f"{TRAINING if training else CODEBOOK} 2.0", dim, 1, len(rows), sum(f for *_, f in rows), wide, low, high, 0, *([method] if method else []), DASHES]
    body = b"".join((name or "").encode() + b"\0" + b"".join(int(x).to_bytes(wide, "big") for x in v) + int(freq).to_bytes(4, "big") for name, v, freq in rows)
    return ("\n".join(map(str, head)) + "\n").encode() + body


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, v, freq) of a binary codebook or training set; ids from 0 in the file's order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                found = parse_codebook(data.as_py())[1]
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(range(i, i + len(part)), pa.int64()), "name": pa.array([r[0] for r in part], pa.string()), "v": pa.array([r[1] for r in part], pa.list_(pa.int64())), "freq": pa.array([r[2] for r in part], pa.int64())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, name string, v array<long>, freq long")


def put(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """Writes one small file to whatever store the path is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, overwrite)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


#: Vectors that the driver writes to one binary file; larger sets belong in Parquet.
IN_A_FILE = 65_536


def _bounded(rows: DataFrame, most: int = IN_A_FILE) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many rows for a file that one task reads; write Parquet")
    return found


def write_codebook(codebook: DataFrame, path: str, method: str = "", overwrite: bool = False) -> None:
    """A codebook (cid, c, freq) of at most IN_A_FILE vectors, written by the driver."""
    rows = _bounded(codebook.orderBy("cid"))
    put(codebook.sparkSession, path, format_codebook([(None, list(r["c"]), r["freq"]) for r in rows], method=method), overwrite)


def write_training_set(points: DataFrame, path: str, method: str = "", overwrite: bool = False) -> None:
    """A training set (id, v, freq and, if there is one, name) of at most IN_A_FILE vectors, in order of ids."""
    named = points if "name" in points.columns else points.withColumn("name", F.lit(None).cast("string"))
    rows = _bounded(named.orderBy("id").select("name", "v", "freq"))
    put(points.sparkSession, path, format_codebook([(r["name"], list(r["v"]), r["freq"]) for r in rows], True, method), overwrite)


def write_like(codebook: DataFrame, path: str, source: str, low: float = 0.0, high: float | None = None, maxval: int = V.MAXVAL, method: str = "") -> str:
    """Writes a codebook as text if the points came from a text file, else in binary; the path, with the right extension."""
    text = source.endswith(".txt")
    path = re.sub(r"\.[^./]*$", "", path) + (".txt" if text else ".cb")
    if text:
        write_text(codebook.select(F.col("c").alias("v"), "freq").coalesce(1), path, low, high, maxval)
    else:
        write_codebook(codebook, path, method, True)
    return path


def with_method(method: str, step: str) -> str:
    """The provenance of a file with one step more."""
    return f"{method}, {step}" if method else step


# partitions


def parse_partition(data: bytes) -> tuple[dict, list[int], list[str]]:
    """The header (clusters, size, method), the labels, from 0, and the names. ValueError if a label is missing or out of
    range."""
    lines = data.decode().split("\n")
    end = next((i for i, x in enumerate(lines) if x.startswith("-")), -1)
    if not lines[0].startswith(PARTITION) or end < 3:
        raise ValueError("no partition file")
    head = {"version": lines[0], "clusters": int(lines[1]), "size": int(lines[2]), "method": " ".join(lines[3:end])}
    body = [x.split(" ", 1) for x in lines[end + 1 : end + 1 + head["size"]]]
    labels = [int(x[0] or 0) for x in body]
    if len(labels) < head["size"] or not all(1 <= x <= head["clusters"] for x in labels):
        raise ValueError("a label is missing or out of range")
    return head, [x - 1 for x in labels], [x[1] if len(x) > 1 else "" for x in body]


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(row, cid): the lines after the dashes, labels from 1 in the file, from 0 here. A label out of range is an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                _, labels, _ = parse_partition(data.as_py())
                yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(labels)), pa.int64()), "cid": pa.array(labels, pa.int32())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "row long, cid int")


def write_partition(assigned: DataFrame, clusters: int, path: str, method: str = "", overwrite: bool = False) -> None:
    """The labels of (id, cid), from 1, in order of ids, one a line after the header. The driver streams the rows, a
    partition at a time, into one file."""
    spark, size = assigned.sparkSession, assigned.count()
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, overwrite)
    try:
        head = [f"{PARTITION} 2.0", clusters, size, *([method] if method else []), DASHES]
        stream.write(bytearray(("\n".join(map(str, head)) + "\n").encode()))
        held: list[str] = []
        for r in assigned.select("id", "cid").orderBy("id").toLocalIterator():
            held.append(str(r["cid"] + 1))
            if len(held) == 10_000:
                stream.write(bytearray(("\n".join(held) + "\n").encode()))
                held = []
        if held:
            stream.write(bytearray(("\n".join(held) + "\n").encode()))
    finally:
        stream.close()


def write_list(rows: DataFrame, column: str, path: str, order: str = "id") -> None:
    """A column's values as text, one a line, in an order; doubles with nine digits after the point."""
    kind = rows.schema[column].dataType.simpleString()
    text = F.format_string("%.9f", F.col(column)) if kind in ("double", "float") else F.col(column).cast("string")
    rows.orderBy(order).select(text.alias("value")).write.text(path)


def format_partition(labels: list[int], size: int, names: list[str | None] | None = None, method: str = "") -> bytes:
    head = [f"{PARTITION} 2.0", size, len(labels), *([method] if method else []), DASHES]
    named = names or [None] * len(labels)
    return "".join(f"{x}\n" for x in [*head, *(f"{c + 1} {n}" if n else c + 1 for c, n in zip(labels, named, strict=True))]).encode()


# graphs


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, rank, weight) of a graph file of version 2: a count, then lines of id, k, neighbours and weights."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(part.alias("p")).where(F.size("p") >= 2)
    k = F.col("p")[1].cast("int")
    each = rows.select(F.col("p")[0].cast("long").alias("src"), F.posexplode(F.slice("p", F.lit(3), k)).alias("i", "dst"), F.slice("p", k + 3, k).alias("w"))
    return each.select("src", F.col("dst").cast("long").alias("dst"), (F.col("i") + 1).alias("rank"), F.get("w", F.col("i")).cast("double").alias("weight"))


def read_graph_v1(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, v) and (src, dst, rank) of a graph file of version 1: a header with the number of vectors, of neighbours and of
    dimensions, dashes, then a line of coordinates and neighbours for each vector, whose id is its place."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    head = lines.orderBy("line").limit(16).collect()
    end = next((i for i, r in enumerate(head) if r["value"].startswith("-")), None)
    if end is None or not head[0]["value"].startswith(GRAPH):
        raise ValueError("no graph file of version 1")
    dim, part = int(head[3]["value"]), F.split("value", r"\s+")
    rows = lines.where((F.col("line") > head[end]["line"]) & (F.col("value") != "")).select("line", part.alias("p"))
    rows = rows.select((F.row_number().over(Window.orderBy("line")) - 1).cast("long").alias("id"), "p")  # one file of text
    points = rows.select("id", F.transform(F.slice("p", 1, dim), lambda x: x.cast("double")).alias("v"))
    edges = rows.where(F.size("p") > dim).select(F.col("id").alias("src"), F.posexplode(F.slice("p", F.lit(dim + 1), F.size("p") - dim)).alias("i", "dst"))
    return points, edges.select("src", F.col("dst").cast("long").alias("dst"), (F.col("i") + 1).alias("rank"))


def _lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("n"))


def write_graph_v1(points: DataFrame, edges: DataFrame, path: str, simple: bool = False, overwrite: bool = False) -> None:
    """Version 1 in one file: the vectors (id, v) and the ids of their neighbours (src, dst, rank, dist), in order of ids.
    simple: the neighbours alone, without a header. For graphs of at most IN_A_FILE vectors."""
    own = F.concat_ws(" ", F.array_join(F.transform("v", lambda x: x.cast("string")), " "), F.array_join(F.transform("n", lambda x: x["dst"].cast("string")), " "))
    if simple:
        own = F.concat_ws(" ", F.array_join(F.transform("n", lambda x: x["dst"].cast("string")), " "))
    rows = _bounded(points.join(_lists(edges).withColumnRenamed("src", "id"), "id", "left").orderBy("id").select(own.alias("line"), F.size("v").alias("d"), F.size("n").alias("k")))
    head = [] if simple else [f"{GRAPH}1", len(rows), max((r["k"] or 0 for r in rows), default=0), rows[0]["d"] if rows else 0, DASHES]
    put(points.sparkSession, path, ("\n".join([*map(str, head), *(r["line"] for r in rows)]) + "\n").encode(), overwrite)


def write_graph(edges: DataFrame, path: str, count: int | None = None) -> None:
    """Edges (src, dst, rank, dist) as lines of version 2 in Spark's text files; with a count, which begins a single file,
    in one file."""
    text = lambda f: F.array_join(F.transform("n", f), " ")
    line = F.concat_ws(" ", F.col("src"), F.size("n"), text(lambda x: x["dst"].cast("string")), text(lambda x: F.format_string("%f", x["dist"].cast("double"))))
    rows = _lists(edges).select("src", line.alias("value"))
    if count is None:
        rows.select("value").write.text(path)
    else:
        head = edges.sparkSession.createDataFrame([(-1, str(count))], "src long, value string")
        head.union(rows.select(F.col("src").cast("long").alias("src"), "value")).coalesce(1).sortWithinPartitions("src").select("value").write.text(path)


def kind_of(data: bytes) -> str:
    """codebook, training, partition, graph or text, by how a file begins."""
    start = data[:64].decode("latin-1")
    kinds = {CODEBOOK: "codebook", TRAINING: "training", PARTITION: "partition", GRAPH: "graph"}
    return next((v for k, v in kinds.items() if start.startswith(k)), "text")


# files of any kind


def head_of(spark: SparkSession, path: str, size: int = 64) -> bytes:
    """The first bytes of a file in any store."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    stream = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(source)
    try:
        found = bytearray()
        while len(found) < size:
            b = stream.read()
            if b < 0:
                break
            found.append(b)
        return bytes(found)
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def find(spark: SparkSession, name: str, extensions: tuple[str, ...] = ("", ".ts", ".cb", ".pa", ".txt")) -> tuple[str, str]:
    """(path, kind) of the first file there is, the extensions tried in this order; FileNotFoundError if there is none."""
    for e in extensions:
        if exists(spark, name + e):
            return name + e, "text" if (name + e).endswith(".txt") else kind_of(head_of(spark, name + e))
    raise FileNotFoundError(name)


def read_vectors(spark: SparkSession, path: str, maxval: int = V.MAXVAL) -> DataFrame:
    """(id, v, freq) of a training set, a codebook or a text file, by how it begins."""
    path, kind = find(spark, path)
    if kind in ("codebook", "training"):
        return read_codebook(spark, path).select("id", "v", "freq")
    if kind != "text":
        raise ValueError(f"{path} holds a {kind}, no vectors")
    return read_text(spark, path, maxval)[0]


def read_solution(spark: SparkSession, path: str, points: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(codebook, assignment) of a file that holds either: points go to their nearest vector, or centroids are the means of
    a partition of the points, which are in the file's order by id. ValueError if the sizes are others than k or the points'.
    """
    from ..operators import relational as R

    path, kind = find(spark, path)
    if kind == "partition":
        labels, size = read_partition(spark, path), parse_partition(_bytes(spark, path))[0]
        if size["size"] != points.count() or (k and size["clusters"] != k):
            raise ValueError(f"{path} is of {size['size']} points and {size['clusters']} clusters")
        from ..operators.sets import all_in_own

        own = all_in_own(points.select("id", "v", "freq")).withColumnRenamed("cid", "row")
        assigned = own.join(labels, "row").select("id", "v", "freq", "cid")
        empty = spark.range(size["clusters"]).select(F.col("id").cast("int").alias("cid"), F.lit(None).cast("array<bigint>").alias("c"))
        book = R.centroids(assigned, empty)
        d2 = V.squared(F.col("v"), F.col("c"))
        return book, assigned.join(F.broadcast(book.select("cid", "c").limit(R.LARGEST)), "cid").select("id", "v", "freq", "cid", d2.alias("d2")) if size["clusters"] <= R.LARGEST else R.with_centroid(assigned, book).select("id", "v", "freq", "cid", d2.alias("d2"))
    rows = read_codebook(spark, path) if kind in ("codebook", "training") else read_text(spark, path)[0]
    book = rows.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("cid"), F.col("v").alias("c"), "freq")  # a codebook
    if k and book.count() != k:
        raise ValueError(f"{path} is not of {k} vectors")
    return book, R.assign(points, book)


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def check_inputs(spark: SparkSession, inputs: list[str], output: str | None, points: int, k: int, overwrite: bool = False) -> None:
    """Raises what is wrong with a run's parameters: an input that is not there, an output that is, more clusters than
    points."""
    for path in inputs:
        if not exists(spark, path):
            raise FileNotFoundError(path)
    if output and not overwrite and exists(spark, output):
        raise FileExistsError(output)
    if not 1 <= k <= points:
        raise ValueError(f"{k} clusters of {points} points")


def history_table(spark: SparkSession, history: list[int]) -> DataFrame:
    """(step, error, gain) of a run, for reports."""
    rows = [(i, float(e), float(history[i - 1] - e) if i else None) for i, e in enumerate(history)]
    return spark.createDataFrame(rows, "step int, error double, gain double")


def report(history: list[int], level: int = 1) -> str:
    """A run in words: nothing (0), its end (1), or every step (2 and more)."""
    if not level or not history:
        return ""
    end = f"{len(history) - 1} steps, error {history[0]} to {history[-1]}"
    return end if level == 1 else "\n".join([*(f"{i}: {e}" for i, e in enumerate(history)), end])
