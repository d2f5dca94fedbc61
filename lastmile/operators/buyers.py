"""Buyer roll-ups (D8, D9, D10) and the per-area method share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastmile.functions.columns import PLATFORM, SELF_PICKUP, STORE_COURIER

# Method columns of the mix reports, in report order: (output name, delivery method).
MIX_METHODS = [("platform_delivery", PLATFORM), ("self_pickup", SELF_PICKUP), ("store_courier", STORE_COURIER)]


def buyer_rollup(fact: DataFrame, keys: list[str], metric: Column, name: str) -> DataFrame:
    """One row per ``keys`` with ``metric`` (an aggregate expression) as ``name``.

    A partial aggregate runs before the shuffle, so a buyer with a third of all rows costs one
    row per map task in the exchange.
    """
    return fact.groupBy(*keys).agg(metric.alias(name))


def buyer_gmv(fact: DataFrame, keys: list[str], gmv: str, name: str = "gmv_per_buyer") -> DataFrame:
    """Σ GMV per buyer grain (NULL when every GMV of the group is NULL)."""
    return buyer_rollup(fact, keys, F.sum(gmv), name)


def buyer_order_count(fact: DataFrame, keys: list[str], name: str = "count_order") -> DataFrame:
    """Distinct orders per buyer grain (as bigint)."""
    return buyer_rollup(fact, keys, F.count_distinct("order_id"), name)


def buyer_method_mix(fact: DataFrame, keys: list[str], methods=MIX_METHODS) -> DataFrame:
    """Distinct orders plus one conditional **row** count per delivery method.

    Rows, not orders: the fact repeats an order per fulfilment × payment (T6), so a method count
    can exceed ``total_order``. Written as explicit conditional sums (one aggregate, no pivot job).
    """
    aggs = [F.count_distinct("order_id").alias("total_order")]
    for name, method in methods:
        aggs.append(F.sum(F.when(F.col("delivery_method") == F.lit(method), F.lit(1)).otherwise(F.lit(0))).alias(name))
    return fact.groupBy(*keys).agg(*aggs)


MEAN_SCALE = 18  # decimals of a mean before it is rounded: those of a quotient of decimal(27,7) and decimal(10,0)
GUARD = 14  # of which so many count: the rest only absorbs the last place of each division


def method_share(
    buyers: DataFrame, area: str, digits: int, exact_int: bool = False, methods=MIX_METHODS
) -> DataFrame:
    """Per area Σ orders, Σ method rows, and the mean over buyers of (method rows / orders),
    rounded half up to ``digits`` and × 100 (``<method>_share_pct``; the report repeated the sum names, T9).

    ``exact_int=False`` divides as a true ratio; ``exact_int=True`` uses integer division like the
    bigint ``/`` of the report's source database (T2).

    Buyers of one area with equally many orders share a denominator: their numerators are summed as integers and
    divided once, so the mean is a sum of a few exact quotients (one for each number of orders) in decimal,
    whatever order rows come in (T11). A buyer without orders has no ratio and does not count in the mean.
    """
    named = [name for name, _ in methods]
    top = [F.expr(f"`{n}` div total_order") if exact_int else F.col(n) for n in named]
    per_count = buyers.groupBy(area, "total_order").agg(
        F.count(F.lit(1)).alias("__buyers"),
        *[F.sum(n).alias(n) for n in named],
        *[F.sum(c).cast("decimal(27,7)").alias(f"__top_{n}") for n, c in zip(named, top, strict=True)],
        # a buyer counts where the numerator is known
        *[F.count(c).alias(f"__known_{n}") for n, c in zip(named, top, strict=True)],
    )
    under = F.lit(1) if exact_int else F.when(F.col("total_order") != 0, F.col("total_order"))
    some = F.col("total_order") != 0
    per_area = per_count.groupBy(area).agg(
        F.sum(F.col("total_order") * F.col("__buyers")).alias("total_order"),
        *[F.sum(n).alias(n) for n in named],
        *[F.sum((F.col(f"__top_{n}") / under.cast("decimal(10,0)")).cast(f"decimal(38,{MEAN_SCALE})")).alias(f"__sum_{n}") for n in named],
        *[F.sum(F.when(some, F.col(f"__known_{n}"))).alias(f"__n_{n}") for n in named],
    )

    def percent(name: str) -> Column:
        mean = F.expr(f"try_divide(`__sum_{name}`, CAST(`__n_{name}` AS DECIMAL(19,0)))").cast(f"decimal(38,{MEAN_SCALE})")
        return F.round(F.round(mean, GUARD), digits).cast("double") * F.lit(100)

    return per_area.select(area, "total_order", *named, *[percent(n).alias(f"{n}_share_pct") for n in named])
