"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, mixture.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwell.llm import queries as q
from panelwell.llm.common import table
from panelwell.llm.decontamination import contamination, small
from panelwell.llm.jaccard_join import similarity_join
from panelwell.session import store


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents without those whose (doc_id, text) is in ``rejected`` (doc_id, text_hash); ids may be null."""
    right = small(store(rejected.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct(), "rejected"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.xxhash64("text").eqNullSafe(F.col("__hash"))
    return docs.join(right, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the nearest labelled examples call toxic."""
    scored = q.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where("predicted = 1"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity is far over that of trusted ones of their language."""
    scored = q.quality_scores(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where(~F.col("keep")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class of near duplicates; of repeated rows one."""
    joined = store(similarity_join(docs), "joined")
    kept = without(docs, joined.where(~F.col("representative")))
    again = joined.where("representative").groupBy("doc_id", "text_hash").count().where("count > 1")
    if again.isEmpty():
        return kept
    repeated = store(again.select("doc_id", "text_hash"), "repeated")
    same = docs.withColumn("text_hash", F.xxhash64("text")).join(
        small(repeated.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"))),
        F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("text_hash").eqNullSafe(F.col("__hash")),
    )
    return without(kept, repeated).unionByName(same.dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages by the contamination rule."""
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, judged.where("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples the documents by their calibrated probabilities."""
    return q.mixed(docs).where("mix_sampled").drop("mix_sampled")


STAGES = [
    ("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture),
]

#: The scores of the first two stages have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
