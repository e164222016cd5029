"""The queries of this subpackage, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, class_model, decontamination, jaccard_join, neighbours, pii, repeats, sharding, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents"), "doc_id", "text", 3, 90).withColumnRenamed("key", "doc_id")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "id % 20 = 0", k=20)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontamination.contained(docs, "doc_id", "text", items, "item_id", "text", 5, 80).withColumnRenamed("key", "doc_id")


def tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip_digests(_table(spark, sf_dir, "documents"), "doc_id", "text", *tokenizer())
    return out.withColumnRenamed("key", "doc_id")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text", 400)
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extract(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_added")).alias("n_spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), "doc_id", "text", sharding.even_tree(8), sharding.even_tree(9))
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zlib

    learns = lambda key: zlib.crc32(str("" if key is None else key).encode()) % 7 != 2
    out = class_model.score(_table(spark, sf_dir, "documents"), "doc_id", "text", learns)
    held_out = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % 7 == 2
    return out.select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> toxicity.Model:
    """Fitted on the first `rows` labelled doc_ids by a hash, of those that training may use. A doc_id with several labels
    is toxic if one says so; of several texts the one with the smallest hash is used. Null doc_ids and labels are left out.
    """
    labels = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    may = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    few = F.broadcast(toxicity.sample(may, "doc_id", rows))  # at most `rows` rows
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.join(few, own["id"] == few["doc_id"]).groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return toxicity.fit(own, "text", "toxic")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, "doc_id", "text", toxicity_model(spark, docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("key").cast("string")) % 4 == 2
    return out.select(F.col("key").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_neighbours, op3_decontamination, op4_bpe, op5_repeats, op6_pii, op7_sharding, op8_class_model, op9_warc, op10_toxicity)}


def _tree_sql(shards: int) -> str:
    """SQL for the shard of doc_id k in even_tree(shards)."""
    draw = lambda name: f"-ln((('0x' || substr(md5(k || '|{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    weight = lambda x: x if isinstance(x, float) else sum(map(weight, x.values()))

    def pick(options: list[tuple[str, float, str]]) -> str:
        if len(options) == 1:
            return options[0][2]
        items = ", ".join(f"{{'d': {draw(n)} / {w}, 'i': {i}}}" for i, (n, w, _) in enumerate(options))
        return f"CASE list_min([{items}]).i " + " ".join(f"WHEN {i} THEN {v}" for i, (_, _, v) in enumerate(options)) + " END"

    regions = []
    for r, racks in sharding.even_tree(shards).items():
        inside = [(f"{r}/{k}", weight(v), pick([(f"{r}/{k}/{s}", w, str(s)) for s, w in v.items()])) for k, v in racks.items()]
        regions.append((r, weight(racks), pick(inside)))
    return pick(regions)


#: CRC-32 by its usual rule: a table of 256 values from eight shifts each, then one look-up a byte.
_SHARDING = f"""
    WITH RECURSIVE s(i, k, v) AS (
        SELECT i, 0, i FROM range(256) r(i)
        UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM s WHERE k < 8),
    tab AS (SELECT list(v ORDER BY i) AS tab FROM s WHERE k = 8),
    d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, coalesce(text, '') AS t FROM documents),
    c AS (
        SELECT doc_id, k, strlen(t)::BIGINT + 1 AS size,
               xor(4294967295, list_reduce(
                   list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(t)), '..')]),
                   lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]))) AS text_crc32
        FROM d, tab),
    p AS (SELECT *, {_tree_sql(8)} AS shard, {_tree_sql(9)} AS grown_shard, substr(md5('slot|' || k || '|' || text_crc32), 1, 3) AS bucket FROM c)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
    FROM p
"""

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _shingle_sql(table: str, key: str, n: int) -> str:
    """Rows (k, s): the distinct n-word shingles of each text, the whole sequence where it is shorter."""
    return f"""SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})] END) AS s
        FROM (SELECT {key} AS k, {_WORDS.format(_LOW.format("text"))} AS w FROM {table})"""


def _jaccard_sql(n: int, percent: int) -> str:
    return f"""
    WITH RECURSIVE sh AS ({_shingle_sql("documents", "doc_id", n)}),
    sz AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
    li AS (
        SELECT a.k AS a, b.k AS b FROM sh a JOIN sh b ON a.s = b.s AND a.k <> b.k JOIN sz x ON x.k = a.k JOIN sz y ON y.k = b.k
        GROUP BY a.k, b.k, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
    reach(a, b) AS (SELECT DISTINCT a, a FROM li UNION SELECT r.a, li.b FROM reach r JOIN li ON r.b = li.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(deg, 0) AS n_links
    FROM documents LEFT JOIN sz ON sz.k = doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = doc_id
    LEFT JOIN (SELECT a, count(*) AS deg FROM li GROUP BY a) g ON g.a = doc_id
    """


#: Every run of five words of each text; of items all shingles; items of fewer words are looked for in the joined words.
_CONTAINED = f"""
    WITH it AS ({_shingle_sql("benchmark", "item_id", 5)}), n AS (SELECT k, count(*) AS n FROM it GROUP BY k),
    w AS (SELECT doc_id AS k, {_WORDS.format(_LOW.format("text"))} AS w FROM documents),
    lens AS (SELECT DISTINCT len(string_split(s, ' ')) AS z FROM it),
    sh AS (SELECT DISTINCT k, unnest([array_to_string(w[i:i + z - 1], ' ') FOR i IN range(1, len(w) - z + 2)]) AS s FROM w, lens)
    SELECT sh.k AS doc_id, it.k AS item_id, n AS item_shingles, count(*) AS shared
    FROM sh JOIN it ON sh.s = it.s JOIN n ON n.k = it.k GROUP BY sh.k, it.k, n HAVING 100 * count(*) >= 80 * n
"""

ORACLES = {
    "op3_decontamination": _CONTAINED,
    "op1_jaccard": _jaccard_sql(3, 90),
    "op7_sharding": _SHARDING,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d
    """,
}
