"""Marketplace order operators: order GMV (D3), order-item GMV (D4), order fact (D5), seller fees (M2),
method-aware GMV (M3), and the area hierarchy (D24)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastmile.functions.columns import (
    COMPLETED,
    PLATFORM,
    acquisition_channel,
    local_month,
    payment_bucket,
    ts_literal,
)
from lastmile.session import reuse
from lastmile.sources.domain import Tables
from lastmile.sources.stored import in_order_months, laid_by_order, order_months

Months = tuple[str | None, str | None]


def _of_orders(rows: DataFrame, orders: DataFrame | None, months: Months = (None, None)) -> DataFrame:
    """The rows of the given orders (column ``order_id``), all without them, out of the months' partitions."""
    rows = in_order_months(rows, months)
    return rows if orders is None else rows.join(orders, "order_id", "left_semi")


def _fulfilment_counts(t: Tables, platform: str = PLATFORM, orders: DataFrame | None = None, months: Months = (None, None)) -> DataFrame:
    """Per order: number of fulfilment rows, and how many of them use the platform fleet."""
    f = _of_orders(t.mk_order_fulfilment, orders, months)
    return f.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_fulfilment"),
        F.count_if(F.col("delivery_method") == F.lit(platform)).alias("n_platform"),
    )


def _fanout(n: Column) -> Column:
    """Rows an order unit turns into after ``LEFT JOIN order_fulfilment``: one per fulfilment, at least one."""
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))


def order_gmv(
    t: Tables, fanout: bool = True, with_fees: bool = False, method_aware: bool = False, platform: str = PLATFORM,
    orders: DataFrame | None = None, months: Months = (None, None),
) -> DataFrame:
    """D3 per order: ``GMV_order`` = Σ price × ordered qty, ``GMV_final`` = Σ price × delivered qty.

    The reports compute it as ``order_unit LEFT JOIN order_fulfilment GROUP BY order_id`` without
    using the fulfilment columns, so each unit is counted once per fulfilment of its order (T6).
    ``fanout=True`` reproduces that exactly without the row explosion: the units are summed per
    order (partial aggregation before the shuffle), the fulfilments are counted per order, and the
    sum is multiplied by max(1, count) — exact in decimal. ``fanout=False`` gives the plain sums.

    ``with_fees`` adds the seller fee sums (M2); ``method_aware`` adds ``GMV_final_seller`` (M3):
    per joined fulfilment row, picked − returned when it is a platform delivery, else delivered.
    ``orders`` (column ``order_id``) keeps these orders only, before anything is summed; ``months`` reads only
    the partitions of orders of these months where the tables are stored by month.
    """
    ou = _of_orders(t.mk_order_unit, orders, months)
    price = F.col("unit_price")
    aggs = [
        F.sum(price * F.col("ordered_quantity")).alias("s_order"),
        F.sum(price * F.col("final_delivered_quantity")).alias("s_final"),
    ]
    if with_fees:
        aggs += [
            F.sum("seller_fee_amount").alias("s_fee"),
            F.sum("seller_fee_discount").alias("s_disc"),
            F.sum(F.col("seller_fee_amount") - F.col("seller_fee_discount")).alias("s_nett"),
        ]
    if method_aware:
        aggs.append(
            F.sum(price * (F.col("final_picked_quantity") - F.col("final_returned_quantity"))).alias("s_platform")
        )
    per_order = ou.groupBy("order_id").agg(*aggs)
    if not fanout:
        out = [F.col("order_id"), F.col("s_order").alias("GMV_order"), F.col("s_final").alias("GMV_final")]
        if with_fees:
            out += [
                F.col("s_fee").alias("seller_fee_amount"),
                F.col("s_disc").alias("seller_fee_discount"),
                F.col("s_nett").alias("total_nett_fee"),
            ]
        if method_aware:
            out.append(F.col("s_final").alias("GMV_final_seller"))
        return per_order.select(*out)

    counts = _fulfilment_counts(t, platform, orders, months)
    j = per_order.join(counts, "order_id", "left")
    m = _fanout(F.col("n_fulfilment"))
    out = [F.col("order_id"), (F.col("s_order") * m).alias("GMV_order"), (F.col("s_final") * m).alias("GMV_final")]
    if with_fees:
        out += [
            (F.col("s_fee") * m).alias("seller_fee_amount"),
            (F.col("s_disc") * m).alias("seller_fee_discount"),
            (F.col("s_nett") * m).alias("total_nett_fee"),
        ]
    if method_aware:
        n_f = F.coalesce(F.col("n_fulfilment"), F.lit(0))
        n_p = F.coalesce(F.col("n_platform"), F.lit(0))
        # platform rows use picked − returned; other rows (and the NULL row of an order without
        # fulfilments) use delivered quantities
        other_rows = F.when(n_f == 0, F.lit(1)).otherwise(n_f - n_p)
        out.append((F.col("s_platform") * n_p + F.col("s_final") * other_rows).alias("GMV_final_seller"))
    return j.select(*out)


def order_item_gmv(t: Tables, fanout: bool = True, orders: DataFrame | None = None, months: Months = (None, None)) -> DataFrame:
    """GMV at grain (order, product unit, product name, unit of measure, unit price).

    Same fulfilment fan-out as D3, applied as a per-order multiplier after grouping the units.
    The product lookups are left joins (a unit without product keeps NULL names).
    """
    ou = _of_orders(t.mk_order_unit, orders, months)
    pu = t.mk_product_unit
    pv = t.mk_product_variant.select(F.col("id").alias("pv_id"), F.col("name").alias("product"))
    uom = t.mk_unit_of_measurement.select(F.col("id").alias("uom_id"), "long_name")
    # names and units of measure are found once per product unit: order units are shuffled to them once
    pu = pu.select(F.col("id").alias("pu_id"), "product_variant_id", "unit_of_measurement_id")
    named = pu.join(pv, pu.product_variant_id == pv.pv_id, "left").join(uom, pu.unit_of_measurement_id == uom.uom_id, "left")
    x = ou.join(named.select("pu_id", "product", "long_name"), ou.product_unit_id == F.col("pu_id"), "left")
    keys = [F.col("order_id"), F.col("pu_id").alias("product_unit_id"), F.col("product"), F.col("long_name"), F.col("unit_price")]
    price = F.col("unit_price")
    # grouped where the fulfilment counts and the order fact join them
    g = laid_by_order(x, t).groupBy(*keys).agg(
        F.sum(price * F.col("ordered_quantity")).alias("s_order"),
        F.sum(price * F.col("final_delivered_quantity")).alias("s_final"),
    )
    if not fanout:
        return g.select(
            "order_id", "product_unit_id", "product", "long_name", "unit_price",
            F.col("s_order").alias("GMV_order"), F.col("s_final").alias("GMV_final"),
        )
    counts = _fulfilment_counts(t, orders=orders, months=months).select("order_id", "n_fulfilment")
    m = _fanout(F.col("n_fulfilment"))
    return g.join(counts, "order_id", "left").select(
        "order_id", "product_unit_id", "product", "long_name", "unit_price",
        (F.col("s_order") * m).alias("GMV_order"), (F.col("s_final") * m).alias("GMV_final"),
    )


def with_area(df: DataFrame, t: Tables, city_id: str, city: str = "city", province: str = "province") -> DataFrame:
    """Store city -> parent province via two left joins to the same area dimension."""
    a = t.mk_address_area
    c = a.select(F.col("id").alias("__city_id"), F.col("name").alias(city), F.col("parent_area_id").alias("__parent"))
    p = a.select(F.col("id").alias("__prov_id"), F.col("name").alias(province))
    out = df.join(c, df[city_id] == c["__city_id"], "left")
    out = out.join(p, out["__parent"] == p["__prov_id"], "left")
    return out.drop("__city_id", "__parent", "__prov_id")


def _of_buyers(orders: DataFrame, t: Tables, buyers: list[str] | DataFrame, months: Months) -> DataFrame:
    """The orders of the listed buyers, kept once: units, fulfilments and the fact itself are joined to them."""
    store = t.mk_store.select(F.col("id").alias("w_id"), "unique_id")
    if isinstance(buyers, DataFrame):
        store = store.join(buyers.select("unique_id"), "unique_id", "left_semi")
    else:
        store = store.where(F.col("unique_id").isin(list(buyers)))
    tr = in_order_months(t.mk_transaction, months).select(F.col("id").alias("w_t_id"), "buyer_store_id")
    bought = tr.join(store, tr.buyer_store_id == F.col("w_id"), "left_semi")
    return reuse(orders.join(bought, orders.transaction_id == bought.w_t_id, "left_semi"))


def order_fact(
    t: Tables,
    start: str | dt.datetime | None,
    end: str | dt.datetime | None = None,
    cap: float | int | None = None,
    cap_inclusive: bool = False,
    cohort: DataFrame | None = None,
    cohort_how: str = "left",
    buyers: list[str] | DataFrame | None = None,
    with_seller: bool = False,
    grain: str = "order",
    status: str = COMPLETED,
) -> DataFrame:
    """The marketplace order fact, one row per order × fulfilment × payment.

    transaction → order → fulfilment → payment → buyer store → fee group → city → province → GMV
    (+ seller store, + cohort), kept when ``start < created_at < end`` (both exclusive), the
    fulfilment has ``status`` and GMV is under ``cap`` (``<``, or ``<=`` with ``cap_inclusive``).

    The WHERE clause of the reports rejects NULLs from order, fulfilment and GMV, so those joins are
    inner (same rows as the left joins; the filters reach the scans); the transaction is the FROM
    table, so it is inner as well. Payment, store and the
    dimensions stay left joins. Order, fulfilment and GMV are all keyed by order id and are joined
    while the rows are partitioned by it.

    ``cohort`` (columns ``unique_id`` [+ ``order_date``]):
      * ``"left"``  – tag column ``platform_tag`` = cohort id or NULL (J5),
      * ``"inner"`` – keep cohort buyers only; tag = their id (J4, as a semi-join: the cohort is distinct),
      * ``"since"`` – keep orders created at/after the buyer's first use (J7 range join).
    ``grain="item"`` uses the order-item GMV (D4), so the cap applies per item group (T18).
    ``buyers`` keeps the listed buyer codes (P12; a DataFrame of ``unique_id`` joins as a semi-join).
    """
    months = order_months(start, end)
    tr = in_order_months(t.mk_transaction, months).select(F.col("id").alias("t_id"), "buyer_store_id")
    o = in_order_months(t.mk_order, months).select(
        F.col("id").alias("order_id"), F.col("transaction_id"), F.col("created_at"), F.col("seller_store_id")
    )
    if start is not None:
        o = o.where(F.col("created_at") > ts_literal(start))
    if end is not None:
        o = o.where(F.col("created_at") < ts_literal(end))
    f = in_order_months(t.mk_order_fulfilment, months).where(F.col("status") == F.lit(status)).select(
        F.col("order_id").alias("f_order_id"), F.col("status").alias("fulfilment_status"), "delivery_method"
    )
    # a join cannot be pushed below an aggregate: the orders of listed buyers are found first, once, and only
    # their units and fulfilments are summed. A date window prunes by partition, a cohort may hold most buyers.
    ids = None
    if buyers is not None:
        o = _of_buyers(o, t, buyers, months)
        ids = o.select("order_id")
    gmv = order_gmv(t, orders=ids, months=months) if grain == "order" else order_item_gmv(t, orders=ids, months=months)
    gmv = gmv.withColumnRenamed("order_id", "g_order_id")
    if cap is not None:
        cap_lit = F.lit(cap)
        gmv = gmv.where(F.col("GMV_order") <= cap_lit if cap_inclusive else F.col("GMV_order") < cap_lit)
    pay = in_order_months(t.mk_payment, months).select(F.col("transaction_id").alias("p_t_id"), "payment_method_detail_type")

    # order-keyed part first: order ⨝ fulfilment ⨝ GMV share the order-id partitioning
    x = o.join(f, o.order_id == f.f_order_id).join(gmv, o.order_id == gmv.g_order_id)
    # the reports read FROM transaction, so an order without its transaction drops (inner)
    x = x.join(tr, x.transaction_id == tr.t_id).join(pay, F.col("t_id") == pay.p_t_id, "left")

    s = t.mk_store.select(
        F.col("id").alias("s_id"), "unique_id", "address_city_id", "address_latitude", "address_longitude", "fee_group_id"
    )
    x = x.join(s, x.buyer_store_id == s.s_id, "left")
    fg = t.mk_fee_group.select(F.col("id").alias("fg_id"), F.col("name").alias("fee_group_name"))
    x = x.join(fg, x.fee_group_id == fg.fg_id, "left")
    x = with_area(x, t, "address_city_id")
    if with_seller:
        sel = t.mk_store.select(F.col("id").alias("sel_id"), F.col("unique_id").alias("seller_unique_id"))
        x = x.join(sel, x.seller_store_id == sel.sel_id, "left")

    if buyers is not None:
        if isinstance(buyers, DataFrame):
            x = x.join(buyers.select(F.col("unique_id").alias("__b")), F.col("unique_id") == F.col("__b"), "left_semi")
        else:
            x = x.where(F.col("unique_id").isin(list(buyers)))

    tag = F.lit(None).cast("string")
    if cohort is not None:
        if cohort_how == "left":
            c = cohort.select(F.col("unique_id").alias("platform_tag"))
            x = x.join(c, x.unique_id == c.platform_tag, "left")
            tag = F.col("platform_tag")
        elif cohort_how == "inner":
            c = cohort.select(F.col("unique_id").alias("__cid"))
            x = x.join(c, x.unique_id == c.__cid, "left_semi")
            tag = F.col("unique_id")
        elif cohort_how == "since":
            c = cohort.select(F.col("unique_id").alias("__cid"), F.col("order_date").alias("__first_use"))
            x = x.join(c, (x.unique_id == c.__cid) & (x.created_at >= c.__first_use), "inner")
            tag = F.col("__cid")
        else:
            raise ValueError(f"cohort_how={cohort_how!r}")

    cols = [
        local_month("created_at").alias("order_date"),
        F.col("unique_id"),
        F.col("city"),
        F.col("province"),
        F.col("address_latitude"),
        F.col("address_longitude"),
        F.col("order_id"),
        acquisition_channel("fee_group_name").alias("acquisition_channel"),
        payment_bucket("payment_method_detail_type").alias("payment_method"),
        F.col("GMV_order"),
        F.col("GMV_final"),
        F.col("fulfilment_status"),
        tag.alias("platform_tag"),
        F.col("delivery_method"),
    ]
    if with_seller:
        cols.append(F.col("seller_unique_id"))
    if grain == "item":
        cols += [F.col("product_unit_id"), F.col("product"), F.col("long_name"), F.col("unit_price")]
    return x.select(*cols)
