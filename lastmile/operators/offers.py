"""Offer operators of the price benchmark: active offers (D17), best offer (D18), buyer basket (D19),
price gap (D20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastmile.functions.columns import ratio
from lastmile.sources.domain import Tables


def active_offers(t: Tables, sellers: list[str] | DataFrame | None = None) -> DataFrame:
    """Product unit × store × price tier where inventory, store and tier are active and
    inventory and tier are live; optionally only stores whose code is in ``sellers``.

    The activity filters reject NULLs of inventory, store and tier, so those joins are inner;
    product name and unit of measure stay left joins. A literal list becomes an IN filter
    (Catalyst turns long lists into a hash set); a DataFrame of codes joins as a semi-join.
    """
    pu = t.mk_product_unit.select(F.col("id").alias("product_unit_id"), "product_variant_id", "unit_of_measurement_id")
    inv = t.mk_inventory.where(F.col("is_active") & F.col("deleted").isNull()).select(
        F.col("id").alias("inv_id"), F.col("product_unit_id").alias("inv_pu"), "store_id"
    )
    s = t.mk_store.where(F.col("is_active")).select(F.col("id").alias("s_id"), F.col("unique_id").alias("store_code"))
    if sellers is not None:
        if isinstance(sellers, DataFrame):
            s = s.join(sellers.select(F.col("unique_id").alias("__code")), F.col("store_code") == F.col("__code"), "left_semi")
        else:
            s = s.where(F.col("store_code").isin(list(sellers)))
    pt = t.mk_price_tier.where(F.col("is_active") & F.col("deleted").isNull()).select("inventory_id", "unit_price")
    pv = t.mk_product_variant.select(F.col("id").alias("pv_id"), F.col("name").alias("product"))
    uom = t.mk_unit_of_measurement.select(F.col("id").alias("uom_id"), F.col("long_name").alias("uom"))
    # names and units of measure are found once per product unit, not once per offer
    named = pu.join(pv, pu.product_variant_id == pv.pv_id, "left").join(uom, pu.unit_of_measurement_id == uom.uom_id, "left")
    x = inv.join(pt, inv.inv_id == pt.inventory_id).join(s, inv.store_id == s.s_id)
    x = x.join(named, x.inv_pu == named.product_unit_id)
    return x.select("store_code", "product_unit_id", "product", "uom", "unit_price")


def best_offer(offers: DataFrame) -> DataFrame:
    """Per product unit (with its name and unit of measure) the number of distinct offering
    stores and the lowest price."""
    return offers.groupBy("product_unit_id", "product", "uom").agg(
        F.count_distinct("store_code").alias("available_store"), F.min("unit_price").alias("min_unit_price")
    )


def buyer_basket(item_fact: DataFrame) -> DataFrame:
    """Per buyer × product: lowest paid unit price, Σ GMV, distinct sellers (item-grain fact rows)."""
    return item_fact.groupBy(
        F.col("unique_id").alias("buyer_unique_id"), "product_unit_id", "product", F.col("long_name").alias("uom")
    ).agg(
        F.min("unit_price").alias("unit_price"),
        F.sum("GMV_order").alias("total_gmv"),
        F.count_distinct("seller_unique_id").alias("count_seller"),
    )


def price_gap(basket: DataFrame, best: DataFrame) -> DataFrame:
    """Basket LEFT JOIN best offer USING (product unit); margin = (paid − best) / paid as a double
    (NULL without an offer, and NULL for a zero paid price instead of a division error, T12)."""
    b = best.select("product_unit_id", "available_store", "min_unit_price")
    x = basket.join(b, "product_unit_id", "left")
    return x.select(
        "buyer_unique_id",
        "product_unit_id",
        "product",
        "uom",
        "count_seller",
        "total_gmv",
        F.col("unit_price").alias("buyer_unit_price"),
        F.col("min_unit_price").alias("best_unit_price"),
        ratio(F.col("unit_price") - F.col("min_unit_price"), F.col("unit_price")).alias("margin_pct"),
        F.col("available_store").alias("available_store"),
    )
