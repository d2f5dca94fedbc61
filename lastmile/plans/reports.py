"""The nine reports (R1–R9) and their dormant variants (M4–M8), composed from the operators.

Each report returns a DataFrame; money is summed as decimal and cast to double only in the final
projection (T1). Sorting follows the report (NULLs first on descending keys, as its source database
does, T13); consumers that do not need the order can drop it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastmile.functions.columns import (
    cod_fee,
    cod_tax_split,
    is_cod,
    region_side,
)
from lastmile.operators.buyers import buyer_gmv, buyer_method_mix, buyer_order_count, method_share
from lastmile.operators.cohorts import adopter_cohort, first_use_cohort
from lastmile.operators.deciles import decile_threshold, top_decile_leads, top_decile_summary
from lastmile.operators.deliveries import attach_manifest, delivery_fact, shipped_gmv, with_manifest_total
from lastmile.operators.offers import active_offers, best_offer, buyer_basket, price_gap
from lastmile.operators.orders import order_fact
from lastmile.session import reuse
from lastmile.sources.domain import Tables
from lastmile.sources.stored import MONTH, in_order_months


def money(col: str | Column, name: str | None = None) -> Column:
    """Final projection of a decimal amount as double."""
    c = F.col(col) if isinstance(col, str) else col
    alias = name or (col if isinstance(col, str) else None)
    return c.cast("double").alias(alias) if alias else c.cast("double")


def _persist(df: DataFrame) -> DataFrame:
    """Roll-ups read twice (threshold and join, S6/J14) are kept once (see ``session.reuse``)."""
    return reuse(df)


MARKET_BUYER_KEYS = ["buyer_code", "city", "province", "platform_tag", "address_latitude", "address_longitude"]


def market_fact(fact: DataFrame) -> DataFrame:
    """The order fact with the buyer code named as the reports' buyer roll-ups name it."""
    return fact.withColumnRenamed("unique_id", "buyer_code")


# ----------------------------------------------------------------------------- R9 / R5 method mix
def method_mix(
    t: Tables,
    month_from: str,
    month_to: str | None,
    start,
    end,
    cap,
    digits: int = 2,
    since_first_use: bool = False,
    exact_int: bool = False,
) -> DataFrame:
    """R9 (``since_first_use=False``, 2 digits) / R5 (``True``, 4 digits): delivery-method mix per
    province for adopter buyers — orders of the adopters in the date window (R9), or only those
    created at/after each buyer's first platform-delivered order (R5, range join)."""
    if since_first_use:
        fact = order_fact(t, start, end, cap, cohort=first_use_cohort(t, month_from, month_to), cohort_how="since")
    else:
        fact = order_fact(t, start, end, cap, cohort=adopter_cohort(t, month_from, month_to), cohort_how="inner")
    buyers = buyer_method_mix(market_fact(fact), MARKET_BUYER_KEYS)
    share = method_share(buyers, "province", digits, exact_int=exact_int)
    return share.orderBy(F.col("total_order").desc_nulls_first())


# ----------------------------------------------------------------------------- R4 / R7 leads, M4 summaries
def gmv_buyers(t: Tables, month_from: str, start) -> DataFrame:
    """R4's buyer roll-up: delivered GMV per buyer × area × cohort tag × method (kept for reuse)."""
    cohort = adopter_cohort(t, month_from)
    fact = order_fact(t, start, None, None, cohort=cohort, cohort_how="left")
    return _persist(buyer_gmv(market_fact(fact), MARKET_BUYER_KEYS + ["delivery_method"], "GMV_final"))


def order_buyers(t: Tables, month_from: str, month_to: str, start, end, cap) -> DataFrame:
    """R7's buyer roll-up: distinct orders per buyer × area × cohort tag × method (kept for reuse)."""
    cohort = adopter_cohort(t, month_from, month_to)
    fact = order_fact(t, start, end, cap, cohort=cohort, cohort_how="left")
    return _persist(buyer_order_count(market_fact(fact), MARKET_BUYER_KEYS + ["delivery_method"]))


def leads_by_gmv(t: Tables, month_from: str, start, buyer: str | None = None, method: str = "bracket") -> DataFrame:
    """Non-adopter buyers whose delivered GMV (per buyer × method) is above their province's
    0.9-decile threshold; optional single buyer."""
    ab = gmv_buyers(t, month_from, start)
    thr = decile_threshold(ab, ["province"], "gmv_per_buyer", "gmv_percentile", method=method)
    leads = top_decile_leads(ab, thr, ["province"], "gmv_per_buyer", "gmv_percentile", buyer=buyer)
    return leads.select(
        "buyer_code", "city", "province",
        F.col("address_latitude").alias("buyer_lat"), F.col("address_longitude").alias("buyer_long"),
        "is_platform_user", "percentile", money("gmv_percentile"), money("gmv_per_buyer"),
    ).orderBy(F.col("gmv_per_buyer").desc_nulls_first())


def leads_by_orders(t: Tables, month_from: str, month_to: str, start, end, cap, method: str = "bracket") -> DataFrame:
    """Non-adopter buyers whose distinct order count (per buyer × method) is above their
    province's 0.9-decile threshold."""
    ab = order_buyers(t, month_from, month_to, start, end, cap)
    thr = decile_threshold(ab, ["province"], "count_order", "order_percentile", method=method)
    leads = top_decile_leads(ab, thr, ["province"], "count_order", "order_percentile")
    return leads.select(
        "buyer_code", "city", "province",
        F.col("address_latitude").alias("buyer_lat"), F.col("address_longitude").alias("buyer_long"),
        "is_platform_user", "percentile", "order_percentile", "count_order",
    ).orderBy(F.col("count_order").desc_nulls_first())


def province_coverage_gmv(t: Tables, month_from: str, start, having_min: int | None, method: str = "bracket") -> DataFrame:
    """M4 on R4: per province the buyers above the GMV threshold, adopters / non-adopters and their
    ratio, kept when adopters above it > ``having_min``."""
    ab = gmv_buyers(t, month_from, start)
    thr = decile_threshold(ab, ["province"], "gmv_per_buyer", "gmv_percentile", method=method)
    s = top_decile_summary(ab, thr, ["province"], ["province"], "gmv_per_buyer", "gmv_percentile", having_min=having_min)
    return s.select(
        "province", "percentile", money("gmv_percentile"), "all_buyer", "adopter_buyer", "non_adopter_buyer",
        "non_adopter_pct",
    ).orderBy(F.col("adopter_buyer").desc_nulls_first())


def province_coverage_orders(
    t: Tables, month_from: str, month_to: str, start, end, cap, having_min: int | None, method: str = "bracket"
) -> DataFrame:
    """M4 on R7: as ``province_coverage_gmv`` on order counts; counts use ``>=``, HAVING uses ``>``."""
    ab = order_buyers(t, month_from, month_to, start, end, cap)
    thr = decile_threshold(ab, ["province"], "count_order", "order_percentile", method=method)
    s = top_decile_summary(
        ab, thr, ["province"], ["province"], "count_order", "order_percentile", inclusive=True, having_min=having_min
    )
    return s.select(
        "province", "percentile", "order_percentile", "all_buyer", "adopter_buyer", "non_adopter_buyer",
        "non_adopter_pct",
    ).orderBy(F.col("adopter_buyer").desc_nulls_first())


# ----------------------------------------------------------------------------- R3 region coverage, M5
REGION_BUYER_KEYS = ["buyer_code", "city", "province_region", "regional_seller", "platform_tag", "lat", "lng"]


def region_buyers(t: Tables, month_from: str, after, sides) -> DataFrame:
    """R3's buyer roll-up: shipped GMV per buyer × city × delivery region × side × tag (kept for reuse)."""
    fact = delivery_fact(t, after, cohort=adopter_cohort(t, month_from), sides=sides)
    return _persist(buyer_gmv(fact, REGION_BUYER_KEYS, "tot_gmv"))


def region_coverage(
    t: Tables, month_from: str, after, sides: dict[str, str] | None = None, method: str = "bracket",
    distinct_buyers: bool = False,
) -> DataFrame:
    """Per (delivery region, side) the 0.9-decile buyer GMV threshold, buyers above it split into
    adopters / non-adopters, and non-adopters per adopter × 100."""
    ab = region_buyers(t, month_from, after, sides)
    thr = decile_threshold(ab, ["province_region", "regional_seller"], "gmv_per_buyer", "gmv_percentile", method=method)
    s = top_decile_summary(
        ab, thr, ["province_region"], ["province_region", "regional_seller"], "gmv_per_buyer", "gmv_percentile",
        distinct_buyers=distinct_buyers,
    )
    cols = ["province_region", "regional_seller", "percentile", money("gmv_percentile"), "all_buyer", "adopter_buyer",
            "non_adopter_buyer", "non_adopter_pct"]
    if distinct_buyers:
        cols.append("distinct_buyer")
    return s.select(*cols).orderBy(F.col("all_buyer").desc_nulls_first())


def region_leads(t: Tables, month_from: str, after, sides: dict[str, str] | None = None, method: str = "bracket") -> DataFrame:
    """M5: the dormant buyer-list tail of R3 — non-adopters above their region's threshold."""
    ab = region_buyers(t, month_from, after, sides)
    thr = decile_threshold(ab, ["province_region", "regional_seller"], "gmv_per_buyer", "gmv_percentile", method=method)
    leads = top_decile_leads(ab, thr, ["province_region"], "gmv_per_buyer", "gmv_percentile")
    return leads.select(
        "buyer_code", "city", "province_region", "regional_seller", "lat", "lng", "is_platform_user", "percentile",
        money("gmv_percentile"), money("gmv_per_buyer"),
    )


# ----------------------------------------------------------------------------- R1 / R2 COD escrow, M1, M6, M8
def cod_escrow(
    t: Tables,
    view: str = "finance",
    delivery_status: str = "done",
    cod_only: bool = True,
    delivery_date: dt.date | None = None,
    tag_status: str | None = None,
    manifest_search: str | None = None,
    detailed: bool = False,
    with_tax: bool = False,
    dedupe_first: bool = False,
    sides: dict[str, str] | None = None,
    total_method: str = "aggregate",
) -> DataFrame:
    """R1 (``view="finance"``: with the order id) / R2 (``"logistics"``: with ordered GMV instead).

    One line per distinct live delivery with ``delivery_status``, paid COD (case-insensitive): shipped
    GMV (D6, only when checked quantity > 0), COD fee (D25), line total and the manifest total (D16,
    computed before DISTINCT, T7), newest delivery date first.

    Optional report parameters (M6): ``delivery_date``, ``tag_status``, ``manifest_search`` (manifest
    number contains the text, case-insensitive). ``detailed`` adds the descriptive columns (M8),
    ``with_tax`` the fee's tax base and VAT (M1). The ride/batch/region joins of the report feed no
    output column and are planned only for ``detailed`` (J19).
    """
    d = t.lg_delivery
    by_month = [c for c in d.columns if c == MONTH]
    d = d.where(F.col("deleted").isNull() & (F.col("status") == F.lit(delivery_status))).select(
        F.col("id").alias("delivery_id"), F.col("order_id"), "pickup_address_id", "delivery_address_id",
        "delivery_tag_id", "batch_id", *by_month,
    )
    months = (None, None) if delivery_date is None else (f"{delivery_date:%Y-%m}",) * 2
    d = in_order_months(d, months)
    o = in_order_months(t.lg_order, months)
    o = o.select(
        F.col("id").alias("o_id"), F.to_date("delivery_date").alias("delivery_date"),
        *[F.col(c).alias(MONTH) for c in o.columns if c == MONTH], "payment_type", "delivery_fee_value",
        *(["store_name"] if detailed else []),
    )
    if cod_only:
        o = o.where(is_cod("payment_type"))
    if delivery_date is not None:
        o = o.where(F.col("delivery_date") == F.lit(delivery_date))
    x = d.join(o.drop(MONTH), F.col("order_id") == F.col("o_id"))
    # lines of the kept orders only
    ol = shipped_gmv(t, orders=o.select(F.col("o_id").alias("order_id"), *[c for c in o.columns if c == MONTH])).where(F.col("qty") > 0).select(F.col("order_id").alias("ol_order_id"), "order_gmv", "tot_gmv")
    x = x.join(ol, x.order_id == ol.ol_order_id, "left")
    pom = t.lg_provider_order_mappings.select(F.col("order_id").alias("pom_order_id"), "entity_id")
    x = x.join(pom, x.order_id == pom.pom_order_id, "left")  # the last join by order, while the rows lie by it
    da = t.lg_delivery_address.select(
        F.col("id").alias("da_id"), "buyer_code", "line1", F.col("city").alias("buyer_city"), "district", "village"
    )
    addressed = lambda x: x.join(da, x.delivery_address_id == da.da_id, "left")
    # a searched manifest leaves few rows, so those are looked up after it
    x = attach_manifest(x, t, on_the_way=addressed) if manifest_search is None else addressed(attach_manifest(x, t))
    pa = t.lg_pickup_address.select(F.col("id").alias("pa_id"), "seller_code", F.col("name").alias("seller_name"))
    x = x.join(pa, x.pickup_address_id == pa.pa_id, "left")
    # driver, user and fleet one by one: Spark knows the size of a table, not of a join, and broadcasts small ones at once
    dr = t.lg_driver.select(F.col("id").alias("dr_id"), "vendor_name", "user_id", "fleet_id")
    u = t.lg_user.select(F.col("id").alias("u_id"), F.col("name").alias("driver_name"))
    fl = t.lg_fleet.select(F.col("id").alias("fl_id"), "license_plate")
    x = x.join(dr, x.driver_id == dr.dr_id, "left")
    x = x.join(u, x.user_id == u.u_id, "left").join(fl, x.fleet_id == fl.fl_id, "left")
    tag = t.lg_delivery_tag.select(F.col("id").alias("tag_id"), F.col("status").alias("delivery_tag_status"))
    x = x.join(tag, x.delivery_tag_id == tag.tag_id, "left")
    if tag_status is not None:
        x = x.where(F.col("delivery_tag_status") == F.lit(tag_status))
    if manifest_search is not None:
        x = x.where(F.col("manifest_no").cast("string").ilike(f"%{manifest_search}%"))
    if detailed:
        b = t.lg_batch.select(F.col("id").alias("b_id"), "region_id")
        reg = t.lg_region.select(F.col("id").alias("reg_id"), F.col("name").alias("buyer_area"))
        x = x.join(b, x.batch_id == b.b_id, "left").join(reg, F.col("region_id") == reg.reg_id, "left")

    fee = cod_fee("payment_type", "delivery_fee_value")
    cols = [F.col("delivery_date"), F.col("manifest_no")]
    if view == "finance":
        cols.append(F.col("order_id"))
    cols += [
        F.col("entity_id"), F.col("delivery_tag_status"), F.col("payment_type"), F.col("buyer_code"),
    ]
    if detailed:
        cols += [
            F.col("store_name").alias("buyer_name"), F.col("line1").alias("buyer_address"), "buyer_city", "district",
            "village", "buyer_area", region_side("buyer_area", sides).alias("buyer_side"),
            "seller_name",
        ]
    cols += [F.col("seller_code"), F.col("vendor_name").alias("vendor"), F.col("license_plate"), F.col("driver_name")]
    if view == "logistics":
        cols.append(F.col("order_gmv"))
    cols += [F.col("tot_gmv").alias("shipped_gmv"), fee.alias("cod_fee")]
    if with_tax:
        base, vat = cod_tax_split(fee)
        cols += [base.alias("fee_base"), vat.alias("fee_vat")]
    lines = x.select(*cols)
    # what is the same for every line, or follows from its other columns, is not kept and shuffled with it
    line_total = F.col("shipped_gmv") + F.col("cod_fee")
    money_cols = {"order_gmv", "shipped_gmv", "cod_fee", "fee_base", "fee_vat"}
    row = [money(c) if c in money_cols else F.col(c) for c in lines.columns]
    row.append(money(line_total, "line_total"))
    final = with_manifest_total(lines, "manifest_no", line_total, "manifest_total", dedupe_first=dedupe_first,
                                method=total_method, distinct_as=row)
    final = final.withColumn("manifest_total", money("manifest_total")).orderBy(F.col("delivery_date").desc_nulls_first())
    after = final.columns.index("entity_id") + 1
    status = F.lit(delivery_status).alias("delivery_status")
    return final.select(*final.columns[:after], status, *final.columns[after:])


# ----------------------------------------------------------------------------- R6 price benchmark
def price_benchmark(
    t: Tables, start, end, cap, buyer: str | list[str] | None = None, sellers: list[str] | DataFrame | None = None
) -> DataFrame:
    """A buyer's basket (lowest paid price, GMV, distinct sellers per product) against the
    cheapest active offer among ``sellers``: price gap and number of offering stores.

    ``buyer=None`` benchmarks every buyer; ``sellers=None`` uses every active seller.
    """
    buyers = [buyer] if isinstance(buyer, str) else buyer
    fact = order_fact(t, start, end, cap, cap_inclusive=True, with_seller=True, grain="item", buyers=buyers)
    gap = price_gap(buyer_basket(fact), best_offer(active_offers(t, sellers)))
    return gap.select(
        "buyer_unique_id", "product_unit_id", "product", "uom", "count_seller", money("total_gmv"),
        money("buyer_unit_price"), money("best_unit_price"), "margin_pct", "available_store",
    )


# ----------------------------------------------------------------------------- R8 buyer orders
def buyer_orders(t: Tables, start, end, cap, buyers: list[str] | DataFrame | None = None) -> DataFrame:
    """Completed orders with GMV ≤ ``cap`` created strictly inside (start, end), for ``buyers``
    (all buyers when None); one row per order × fulfilment × payment, as the report lists them."""
    fact = order_fact(t, start, end, cap, cap_inclusive=True, buyers=buyers)
    return fact.select(
        "order_date", "order_id", "unique_id", "city", "province", "address_latitude", "address_longitude",
        "acquisition_channel", "payment_method", money("GMV_order"), money("GMV_final"), "fulfilment_status",
        "delivery_method",
    )
