"""The corpus pipeline: every stage calls one training-data operator on all that its predecessor kept.

``run`` applies the stages to ``documents``; between stages the documents are written as Parquet to the
shared checkpoint folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import shared_folder, table
from lastmile.llm.minhash import one_of_each_group
from lastmile.llm.mixing import take
from lastmile.llm.packing import pack_documents
from lastmile.llm.quality import judge
from lastmile.llm.substring_dedup import remove_repeats


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are distributed like their language."""
    # observed first: a filter right on the verdict would be pushed below the columns it is made of, and
    # the arrays that its lambdas look into would be made again for every element
    kept = F.col("_quality.kept")
    judged = judge(docs).observe("quality_rules", F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"))
    return judged.where(kept).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, rows that repeat an id and rows without one among them."""
    return one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; n_chars is counted anew."""
    return with_length(remove_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut so that every source gives its target of words; n_chars is counted anew."""
    return with_length(take(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The near-duplicate, substring and packing stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            path = f"{folder}/{place}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
