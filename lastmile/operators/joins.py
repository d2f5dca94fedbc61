"""Join helpers shared by the operators.

Broadcast policy: dimension tables (area, fee group, region, ...) are left to Spark's own
size-based choice (``autoBroadcastJoinThreshold`` on file statistics, and AQE re-planning on the
measured size of each materialised shuffle stage), and so are derived sides of one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastmile.session import reuse


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on several keys where NULL matches NULL (SQL ``IS NOT DISTINCT FROM``)."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL keys as equal; the result keeps one copy of each key."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


HEAVY_SHARE = 0.001  # a key with more than this share of all rows is heavy; so there are fewer than a thousand
ROWS_A_TASK = 200_000  # rows that one task joins with their totals and makes distinct: few enough to need no spilling


def partition_total(
    df: DataFrame, keys: list[str], value: str | Column, name: str, method: str = "aggregate", heavy: float = HEAVY_SHARE,
    distinct_as: list[Column] | None = None,
) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys)`` added as column ``name``.

    ``method="aggregate"`` (default, scale form): partial+final hash aggregate per key, which combines map-side, joined
    back null-safely. The totals also count their rows. Keys with more than the share ``heavy`` of all rows, of which
    there are fewer than 1 / ``heavy``, are broadcast and joined where their rows are; those rows then take
    no part in the shuffled join, for which they are dealt out by a hash of the row. So a key with a third of all
    rows is never sorted or joined in one task, whatever the size at which adaptive execution splits partitions.
    ``method="window"`` is the literal window for parity checks; it sorts a whole key in one task.

    ``distinct_as`` gives distinct rows of these columns and the total instead: equal rows are dealt to one task by the
    join already, so they are found there and not shuffled once more. The number of tasks follows from the rows.
    """
    v = F.col(value) if isinstance(value, str) else value
    row = [F.col(c) for c in df.columns] if distinct_as is None else distinct_as
    if method == "window":
        windowed = df.withColumn(name, F.sum(v).over(Window.partitionBy(*keys)))
        return windowed if distinct_as is None else windowed.select(*row, name).distinct()
    df = reuse(df)  # read for the totals, their number of rows and the result; a report's lines are a long chain of joins
    totals = df.groupBy(*keys).agg(F.sum(v).alias(name), F.count(F.lit(1)).alias("__rows"))
    all_rows = df.count()
    large = totals.where(F.col("__rows") > F.lit(heavy) * all_rows).select(*keys, F.col(name).alias("__heavy"), F.lit(True).alias("__is_heavy"))
    marked = join_null_safe(df, F.broadcast(large), keys, "left")
    # where a row lies: by a hash of its keys (null-safe keys alone leave no plain column to lie by) and its deal
    part, deal = F.hash(*keys), F.when(F.col("__is_heavy"), 1 + F.pmod(F.xxhash64(*row), F.lit(1 << 31))).otherwise(0)
    # fewer partitions than the session's are dealt again by the join; few rows are left to adaptive execution
    tasks = [max(-(-all_rows // ROWS_A_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if all_rows > ROWS_A_TASK else []
    dealt = marked.withColumn("__part", part).withColumn("__deal", deal).repartition(*tasks, "__part", "__deal")
    # 0, but no literal: a literal would be taken out of the join's keys and the heavy rows not be dealt out
    light = totals.select(*keys, name, part.alias("__r_part"), F.least("__rows", F.lit(0)).alias("__r_deal"))
    light = light.select(*[F.col(k).alias(f"__r_{k}") for k in keys], name, "__r_part", "__r_deal")
    same = (F.col("__part") == F.col("__r_part")) & (F.col("__deal") == F.col("__r_deal"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    joined = dealt.join(light, same, "left")
    total = F.when(F.col("__is_heavy"), F.col("__heavy")).otherwise(F.col(name))
    if distinct_as is None:
        return joined.select(*row, total.alias(name))
    return joined.select(*row, total.alias(name), "__part", "__deal").distinct().drop("__part", "__deal")
