"""Logistics operators: shipped GMV (D6), delivery fact (D7), manifest link (D15), manifest total."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastmile.functions.columns import date_literal, is_false, region_side
from lastmile.operators.joins import partition_total
from lastmile.sources.domain import Tables
from lastmile.sources.stored import ADDRESS, MONTH, RIDE, StoredTables, laid_by_order


def shipped_gmv(t: Tables, full: bool = True, orders: DataFrame | None = None) -> DataFrame:
    """D6 per logistics order: order line ⨝ delivery line, summed per order.

    ``full``: Σ quantity, Σ allocated, Σ checked (``qty``) and the three price-weighted sums
    (``order_gmv``, ``allocated_gmv``, ``tot_gmv``); otherwise only ``qty`` and ``tot_gmv``.
    The report's consumers keep ``qty > 0`` inside their join condition (J9).

    ``orders`` (column ``order_id``) keeps the lines of these orders only, before they are joined and summed. With
    the orders' month (``MONTH``) on both sides, partitions of other months are not read. Delivery lines that
    name their order are kept likewise, and both lines meet where the order lies: each is shuffled once, by order, and
    where both are derived from the same lines they share that exchange (``Tables.lines_of``).
    """
    ol, dl = t.lg_order_line, t.lg_delivery_line
    by_month = [MONTH] if MONTH in ol.columns and MONTH in dl.columns else []
    # stored lines are pruned by month and lie by order: they keep the line id as their only other key
    by_order = ["order_id"] if orders is not None and "order_id" in dl.columns and not isinstance(t, StoredTables) else []
    drawn = bool(by_order) and isinstance(t, Tables)
    if drawn:
        ol, dl = t.lines_of(orders)
    dl = dl.select(*by_order, "order_line_id", "quantity", "allocated_quantity", "checked_quantity", *by_month)
    if orders is not None and not drawn:
        of_orders = lambda rows: rows.join(orders, [c for c in ("order_id", MONTH) if c in rows.columns and c in orders.columns], "left_semi")
        ol, dl = of_orders(ol), of_orders(dl) if by_order else dl
    if by_order and not drawn:
        ol, dl = laid_by_order(ol, t), laid_by_order(dl, t)
    # both lines of an order lie in its month, so the month only saves reading
    x = ol.withColumnRenamed("id", "order_line_id").join(dl, [*by_order, "order_line_id", *by_month])
    p = F.col("price_unit")
    aggs = [F.sum("checked_quantity").alias("qty"), F.sum(p * F.col("checked_quantity")).alias("tot_gmv")]
    if full:
        aggs = [
            F.sum("quantity").alias("order_qty"),
            F.sum("allocated_quantity").alias("allocated_qty"),
            aggs[0],
            F.sum(p * F.col("quantity")).alias("order_gmv"),
            F.sum(p * F.col("allocated_quantity")).alias("allocated_gmv"),
            aggs[1],
        ]
    return x.groupBy("order_id").agg(*aggs)


def manifest_link(t: Tables) -> DataFrame:
    """Each delivery's own task → its ride, then the pick-up task of that ride at the delivery's
    pick-up address → the manifest (``rpb_number``). Composite-key left join on (ride, address).

    Returns delivery_id, order_id, ride_id, pickup_id, manifest_no (one row per delivery × task × match).
    """
    d = t.lg_delivery.select(F.col("id").alias("delivery_id"), "order_id", "pickup_address_id")
    return attach_manifest(d, t).select("delivery_id", "order_id", "ride_id", "pickup_id", "manifest_no")


def pickup_manifests(t: Tables) -> DataFrame:
    """Pick-up tasks with their pick-up (report: ``task LEFT JOIN pickup WHERE pickup_id IS NOT NULL``).

    Stored pick-ups name their ride and are bucketed by it: the ride is the join's only key there (a further key would
    ask for an exchange by both), and the pick-up is compared among those of the ride.
    """
    tk = t.lg_task.where(F.col("pickup_id").isNotNull()).select(F.col("ride_id").alias("tp_ride_id"), "pickup_id")
    p = t.lg_pickup.select(
        F.col("id").alias("p_id"), F.col("pickup_address_id").alias("tp_pickup_address_id"), F.col("rpb_number"),
        *[c for c in t.lg_pickup.columns if c == RIDE],
    )
    same = tk.pickup_id == p.p_id
    if RIDE in p.columns:
        same = (tk.tp_ride_id == p[RIDE]) & tk.pickup_id.between(p.p_id, p.p_id)
    return tk.join(p, same, "left").select(
        "tp_ride_id", "pickup_id", "tp_pickup_address_id", F.col("rpb_number").alias("manifest_no")
    )


def linked_tasks(t: Tables) -> DataFrame:
    """Stored delivery tasks with the manifest of their ride at their delivery's pick-up address, joined where rides lie."""
    tk = t.lg_task.where(F.col("delivery_id").isNotNull()).select(F.col("delivery_id").alias("tk_delivery_id"), "ride_id", "driver_id", ADDRESS)
    tp = pickup_manifests(t)
    same = (tk.ride_id == tp.tp_ride_id) & tk[ADDRESS].between(tp.tp_pickup_address_id, tp.tp_pickup_address_id)
    return tk.join(tp, same, "left").drop(ADDRESS, "tp_ride_id", "tp_pickup_address_id")


def attach_manifest(d: DataFrame, t: Tables, on_the_way: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Left join a delivery-keyed frame (delivery_id, pickup_address_id, ...) to its task and manifest.

    ``pickup_address_id`` is the delivery's own; stored tasks hold it too, and deliveries then join the linked tasks.
    ``on_the_way`` adds further left joins, made before the one by ride: after it the rows of a manifest lie together, so
    they are summed before they are shuffled, and take less room when they are.
    """
    if ADDRESS in t.lg_task.columns:
        tk = linked_tasks(t)
        return on_the_way(d.join(tk, d.delivery_id == tk.tk_delivery_id, "left").drop("tk_delivery_id"))
    tk = t.lg_task.select(F.col("delivery_id").alias("tk_delivery_id"), "ride_id", "driver_id")
    x = on_the_way(d.join(tk, d.delivery_id == tk.tk_delivery_id, "left").drop("tk_delivery_id"))
    tp = pickup_manifests(t)
    x = x.join(
        tp, (x.ride_id == tp.tp_ride_id) & (x.pickup_address_id == tp.tp_pickup_address_id), "left"
    )
    return x.drop("tp_ride_id", "tp_pickup_address_id")


def with_manifest_total(
    df: DataFrame, key: str = "manifest_no", value: str | Column = "line_total", name: str = "manifest_total",
    dedupe_first: bool = False, method: str = "aggregate", distinct_as: list[Column] | None = None,
) -> DataFrame:
    """Total of ``value`` over all rows of the same manifest (NULL manifest is one group).

    The report sums **before** its DISTINCT, so duplicate lines inflate the total (T7); that is the
    default. ``dedupe_first=True`` removes duplicate rows first. See ``partition_total`` for why the
    default form is aggregate + join rather than a window, and for ``distinct_as``: the report's DISTINCT.
    """
    if dedupe_first:
        df = df.distinct()
    return partition_total(df, [key], value, name, method=method, distinct_as=distinct_as)


def delivery_fact(
    t: Tables,
    after: str | dt.date,
    cohort: DataFrame | None = None,
    sides: dict[str, str] | None = None,
) -> DataFrame:
    """The less-than-truckload delivery fact of report F3.

    ride → delivery task → delivery → order → address → shipped GMV (D6, qty > 0) → route → batch →
    region (+ cohort tag), for live rides and deliveries, non-full-truck-load orders (``IS FALSE``:
    NULL flags drop) and batches delivered after ``after`` (exclusive).

    The filters on order, delivery (its row must exist because the order must) and batch make the
    chain ride → task → delivery → order and ride → route → batch inner; address, GMV, region and
    cohort stay left joins.
    """
    r = t.lg_ride.where(F.col("deleted").isNull()).select(F.col("id").alias("r_id"), "route_id")
    td = t.lg_task.where(F.col("delivery_id").isNotNull()).select(F.col("ride_id").alias("td_ride_id"), "delivery_id")
    d = t.lg_delivery.where(F.col("deleted").isNull()).select(F.col("id").alias("d_id"), F.col("order_id"))
    o = t.lg_order.where(is_false("is_full_truck_load")).select(F.col("id").alias("o_id"), "delivery_address_id")
    ro = t.lg_route.select(F.col("id").alias("ro_id"), "batch_id")
    b = t.lg_batch.where(F.col("delivery_date") > date_literal(after)).select(
        F.col("id").alias("b_id"), "region_id", F.col("delivery_date").alias("batch_date")
    )
    x = r.join(ro, r.route_id == ro.ro_id).join(b, F.col("batch_id") == b.b_id)
    x = x.join(td, x.r_id == td.td_ride_id).join(d, F.col("delivery_id") == d.d_id).join(o, F.col("order_id") == o.o_id)
    # the filter on the order prunes its lines, which are joined while the rows lie by order
    ol = shipped_gmv(t, full=False, orders=o.select(F.col("o_id").alias("order_id"))).where(F.col("qty") > 0).select(
        F.col("order_id").alias("ol_order_id"), F.col("tot_gmv")
    )
    x = x.join(ol, x.order_id == ol.ol_order_id, "left")
    da = t.lg_delivery_address.select(F.col("id").alias("da_id"), "buyer_code", "lat", "lng", "city", "province")
    tag = F.lit(None).cast("string")
    if cohort is not None:  # the tag belongs to the address's buyer: addresses are tagged, not every delivery
        c = cohort.select(F.col("unique_id").alias("platform_tag"))
        da = da.join(c, da.buyer_code == c.platform_tag, "left")
        tag = F.col("platform_tag")
    x = x.join(da, x.delivery_address_id == da.da_id, "left")
    reg = t.lg_region.select(F.col("id").alias("reg_id"), F.col("name").alias("province_region"))
    x = x.join(reg, x.region_id == reg.reg_id, "left")
    return x.select(
        F.date_format("batch_date", "yyyy-MM-dd").alias("delivery_date"),
        "order_id",
        "buyer_code",
        "lat",
        "lng",
        tag.alias("platform_tag"),
        "tot_gmv",
        "city",
        "province_region",
        "province",
        region_side("province_region", sides).alias("regional_seller"),
    )
