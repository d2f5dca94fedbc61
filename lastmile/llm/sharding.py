"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key's jumps are drawn from keyed hashes, so they do not depend on the number of shards: standing
at bucket ``b`` the key next leaves it when the shard count reaches ``floor((b + 1) / u) + 1`` with
``u`` uniform in (0, 1]. Its shard among ``n`` is the last bucket below ``n``. No ring table is kept,
and adding a shard moves only the rows that land in it.

Defined cases: a null key is a key like any other (all null keys share a shard); a null text has no
bytes and CRC 0; repeated rows share a shard and get slots of their own; an empty table gives no rows;
further columns are passed through ``place`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastmile.llm.common import bucket_of, given_back, held, held_name, table, utf8_crc32

SHARDS = 24
SLOT_BUCKETS = 1024  # hash ranges a shard is numbered in, so that no task holds a whole shard
ROW_OVERHEAD = 8


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to ``shards`` - 1) of a key. Every jump moves up by one bucket at least, so ``shards`` steps end it."""
    if shards < 1:
        raise ValueError("there must be one shard at least")

    def step(at: Column, _: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(key, at["next"]), 11) + 1) / F.lit(float(1 << 53))
        after = F.floor((at["next"] + 1) / uniform).cast("long")
        return F.when(at["next"] < shards, F.struct(at["next"].alias("bucket"), after.alias("next"))).otherwise(at)

    start = F.struct(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda at: at["bucket"]).cast("int")


def number_slots(df: DataFrame, shard: str, order: list[str], slot: str, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows are counted per (shard, hash range), the counts are summed up along the ranges, and rows are
    numbered within their range; so a task sorts one range of a shard, never the shard.
    """
    names = [c for c in df.columns if c != slot]
    df, shard, order = held(df), held_name(shard), [held_name(c) for c in order]
    df = df.withColumn("_bucket", bucket_of(F.xxhash64(*order), buckets))
    starts = (
        df.groupBy(shard, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    numbered = df.withColumn("_within", within).join(starts, [shard, "_bucket"])
    return given_back(numbered, names, (F.col("_start") + F.col("_within") - 1).alias(slot))


def place(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``docs`` with a struct ``_place``: shard, and grown_shard, where the row goes with one more shard."""
    return docs.withColumn(
        "_place",
        F.struct(jump_shard(F.col(key), shards).alias("shard"), jump_shard(F.col(key), shards + 1).alias("grown_shard")),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        utf8_crc32(F.col("text")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "_place.shard",
        "_place.grown_shard",
    )
    numbered = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
