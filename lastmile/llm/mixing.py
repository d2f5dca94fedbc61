"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source documents stand in key order; prefix sums of
their token counts say which of them fit the source's budget. The order is cut into fixed ranges of
the hash space: sums per (source, range) are added up along the ranges, and running sums are formed
inside a range only, so a source holding a third of all rows is spread over all ranges. A budget
beyond one pass over the source repeats whole epochs, then takes the rest from the front of the order;
the document at the cut gives only the words still missing, so a budget is met to the word.

Defined cases: a null source is a source of its own, last in order; a null or blank text has size 0 and
is never taken; rows with the same key stand in (id, size, CRC) order, so equal rows are interchangeable;
an empty table gives no rows; further columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastmile.llm.common import bucket_of, given_back, held, held_name, table, utf8_crc32, words

WEIGHTS = (3, 1, 2)  # by place of the source, repeating
SHARE = 1.5  # of all sizes
MOST_EPOCHS = 2
RANGES = 1024
SEED = 20_003


def source_key(source: Column) -> Column:
    """Text that sorts as the sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (_src, _source_size) with _target: shares by weight, none above ``most`` epochs of its source.

    What a capped source leaves is shared among the others by weight until none is above its cap. That
    ends where every target is min(cap, level x weight); with sources in the order of cap / weight the
    level follows from prefix sums. The windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy("_src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", "_src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.col("_source_size").cast("double") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("_source_size").over(everything).cast("double"))
        .withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
        .withColumn("_target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap"))))
        .select("_src", "_source_size", "_target")
    )


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """``docs`` with a struct ``_mix``: size, source_size, target, taken (words, repeats counted)."""
    names = [c for c in docs.columns if c != "_mix"]
    docs, source, key, text = held(docs), *map(held_name, (source, key, text))
    keyed = (
        docs.withColumn("_src", source_key(F.col(source)))
        .withColumn("_size", F.size(words(F.col(text))).cast("long"))
        .withColumn("_crc", utf8_crc32(F.col(text)))
        .withColumn("_key", F.xxhash64(F.lit(SEED), F.col(key), F.col("_crc")))
        .withColumn("_range", bucket_of(F.col("_key"), ranges))
    )
    per_range = keyed.groupBy("_src", "_range").agg(F.sum("_size").alias("_sum"))
    plan = targets(per_range.groupBy("_src").agg(F.sum("_sum").alias("_source_size")))
    starts = (
        per_range.withColumn("_start", F.sum("_sum").over(Window.partitionBy("_src").orderBy("_range")) - F.col("_sum"))
        .drop("_sum")
        .join(plan, "_src")
    )
    inside = Window.partitionBy("_src", "_range").orderBy("_key", key, "_size", "_crc").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.round("_target").cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(budget / F.greatest("_source_size", F.lit(1)))).otherwise(0).cast("long")
    before = F.col("_start") + F.col("_run") - F.col("_size")
    rest = budget - epochs * F.col("_source_size") - before
    taken = epochs * F.col("_size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), rest))
    mixed = keyed.withColumn("_run", F.sum("_size").over(inside)).join(starts, ["_src", "_range"])
    numbers = F.struct(F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))
    return given_back(mixed.withColumn("_mix", numbers), names, "_mix")


def take(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the mix: one per repeat, the last one holding a document's leading words where the budget cuts it."""
    names = docs.columns
    source, key, text = map(held_name, (source, key, text))
    mixed = mix(held(docs), source, key, text)
    size, taken = F.col("_mix.size"), F.col("_mix.taken")
    whole = F.floor(taken / F.greatest(size, F.lit(1))).cast("int")
    rest = (taken - whole * size).cast("int")
    copies = F.when(taken > 0, F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    rows = mixed.withColumn("_words", F.explode(copies))
    cut_text = F.when(F.col("_words") < 0, F.col(text)).otherwise(F.array_join(F.slice(words(F.col(text)), 1, F.greatest("_words", F.lit(1))), " "))
    return given_back(rows.withColumn(text, cut_text), names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")
