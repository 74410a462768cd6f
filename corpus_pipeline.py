"""The corpus pipeline: quality, toxicity, near-duplicates, pseudonyms, packing, each stage over all its predecessor kept.

Stages but the last return the columns of documents. Null and empty texts are scored like any other. Of a class of near
duplicates one row stays, that of the smallest id; rows without an id come after all others, by a hash of their text, and
rows that repeat an id and its text are one document. With no labels, or none of both classes, the classifiers keep
everything. A stage's intermediate tables are removed once it is written, and a stage's table once the next one is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import dedup, packing, pii, quality, toxicity
from papyra.llm.common import fresh, read, remove, staged, staging, staging_root

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, score, threshold: float, above: bool) -> DataFrame:
    (name,) = fresh(docs, "stage_score")
    marked = docs.withColumn(name, score(F.col("text").cast("string")))
    return marked.where(F.col(name) >= threshold if above else F.col(name) < threshold).drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return _kept(docs, quality._score(model), quality.THRESHOLD, True)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return _kept(docs, toxicity._score(model), toxicity.THRESHOLD, False)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    node, keep = fresh(docs, "dedup_node", "dedup_keep")
    # rows without an id: a number above all ids, so that equal texts share it
    unnamed = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    marked = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    classes = dedup.near_duplicates(marked.select(F.col(node).alias("doc_id"), "text"), dedup.MinHash(words=5, percent=80))
    classes = staged(classes, "dedup-classes")
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias(keep)).distinct()
    rest = marked.join(gone, F.col(node) == F.col(keep), "left_anti")
    # rows that share an id are few or none; only they are compared by their texts
    repeated = classes.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(keep))
    once = rest.join(repeated, F.col(node) == F.col(keep), "left_anti")
    again = rest.join(repeated, F.col(node) == F.col(keep), "left_semi").dropDuplicates([node, "text"])
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.packed_documents(docs.select("doc_id", "text"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models, keyed permutations and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    root, before = f"{staging_root(spark)}/papyra/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}-{name}")
        if before:
            remove(spark, before)
        before = f"{root}/{i}-{name}"
        docs = spark.read.parquet(before)
    return docs
