"""A corpus pipeline: each stage calls one operator of clustral.llm on all documents that its predecessor kept.

Rows with null or empty texts go through all stages: they are not toxic unless the classifier's bias is, near no other, hold
no benchmark item and no personal data, and have no tokens. A null doc_id is a key like any other. Further columns stay up
to the last stage, whatever their names but those that begin with __. Empty tables give empty results. doc_ids are taken to
be unique: where rows share one, stages that choose by it keep or drop them together, and of rows that also share the text
the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustral.llm import bpe, decontamination, jaccard_join, pii, queries, toxicity

#: Documents scored at least this are rejected.
TOXIC = 0.3


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from the labelled documents among docs; without labels
    of both kinds all documents have the same score, the share of toxic labels. Repeated rows are judged alike."""
    model = queries.toxicity_model(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, "text", model, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near duplicates (five words, similarity 0.8). Documents
    without words are near no other and stay; of rows equal in doc_id and text one stays."""
    found = jaccard_join.classes(docs, "doc_id", "text", 5, 80).select(F.col("key").alias("__key"), F.col("component_id").alias("__class")).distinct()
    stays = found.where(F.col("__key").eqNullSafe(F.col("__class"))).select("__key")
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["__key"]), "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark: at least 80 % of its five-word shingles. Null and empty
    items are in none; repeated rows go or stay alike."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contained(docs, "doc_id", "text", items, "item_id", "text").select(F.col("key").alias("__key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__key"]), "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts the characters anew if there is a column n_chars. All rows stay."""
    out = pii.redacted(docs, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids: doc_id, ids, n_tokens; none for null and empty texts. Repeated rows stay."""
    ranks, pattern = queries.tokenizer()
    coded = bpe.encode(docs, "doc_id", "text", ranks, pattern)
    return coded.select(F.col("key").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("bpe", encoded)]
#: SQL can express neither the classifier nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
