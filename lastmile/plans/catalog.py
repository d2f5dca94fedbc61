"""

Every entry takes ``(spark, sf_dir)``, derives the domain tables from the whole star tables in
``sf_dir`` and returns a DataFrame. Column names match the DuckDB twins in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.functions import columns as C
from lastmile.operators import buyers as B
from lastmile.operators import cohorts as CO
from lastmile.operators import deciles as D
from lastmile.operators import deliveries as DL
from lastmile.operators import offers as OF
from lastmile.operators import orders as O
from lastmile.operators.joins import partition_total
from lastmile.plans import params as P
from lastmile.plans import reports as R
from lastmile.plans.reports import money
from lastmile.session import configure
from lastmile.sources import namespaces
from lastmile.sources.domain import Tables

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
_PLANS: dict[str, Callable] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        _PLANS[name] = fn
        return fn

    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def plans() -> dict[str, Callable]:
    """The same queries as functions of a ``Tables``-like object (e.g. ``StoredTables``)."""
    return dict(_PLANS)


# ============================================================================ reports R1–R9
@query("cod_escrow_finance")
def _r1(t):
    """COD escrow lines, finance view."""
    return R.cod_escrow(t, "finance")


@query("cod_escrow_logistics")
def _r2(t):
    """R2: COD escrow lines, logistics view."""
    return R.cod_escrow(t, "logistics")


@query("region_coverage")
def _r3(t):
    """Top-decile buyer coverage per delivery region."""
    return R.region_coverage(t, P.OPEN_ADOPTION_FROM, P.DELIVERIES_AFTER, sides=C.STAR_REGION_SIDES)


@query("leads_by_gmv")
def _r4(t):
    """Non-adopter buyers above their province's GMV decile threshold."""
    return R.leads_by_gmv(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER)


@query("method_mix_since_first_use")
def _r5(t):
    """Delivery-method mix per province since each buyer's first platform delivery."""
    return R.method_mix(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, digits=4,
                        since_first_use=True)


@query("price_benchmark")
def _r6(t):
    """Every buyer's basket against the best active offer."""
    return R.price_benchmark(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)


@query("leads_by_orders")
def _r7(t):
    """Non-adopter buyers above their province's order-count decile threshold."""
    return R.leads_by_orders(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)


@query("buyer_orders")
def _r8(t):
    """Completed orders under the value cap in the date window."""
    return R.buyer_orders(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)


@query("method_mix")
def _r9(t):
    """Delivery-method mix per province for adopters."""
    return R.method_mix(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, digits=2)


@query("buyer_orders_selected")
def _r8_selected(t):
    """R8 in its narrow form: the orders of the selected buyers."""
    return R.buyer_orders(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, buyers=P.SELECTED_BUYERS)


@query("price_benchmark_buyer")
def _r6_buyer(t):
    """R6 in its narrow form: one buyer's basket against the offers of sixteen sellers."""
    return R.price_benchmark(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, buyer=P.SELECTED_BUYERS[0], sellers=P.SELECTED_SELLERS)


@query("leads_by_gmv_buyer")
def _r4_buyer(t):
    """R4 for one buyer: the thresholds are those of all buyers."""
    return R.leads_by_gmv(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER, buyer=P.SELECTED_LEAD)


# ============================================================================ domain operators D1–D25
@query("adopter_cohort")
def _d1(t):
    return CO.adopter_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)


@query("adopter_cohort_open")
def _d1o(t):
    return CO.adopter_cohort(t, P.OPEN_ADOPTION_FROM)


@query("first_use_cohort")
def _d2(t):
    return CO.first_use_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)


@query("order_gmv")
def _d3(t):
    g = O.order_gmv(t)
    return g.select("order_id", money("GMV_order", "gmv_order"), money("GMV_final", "gmv_final"))


@query("order_gmv_no_fanout")
def _d3n(t):
    g = O.order_gmv(t, fanout=False)
    return g.select("order_id", money("GMV_order", "gmv_order"), money("GMV_final", "gmv_final"))


@query("order_item_gmv")
def _d4(t):
    g = O.order_item_gmv(t)
    return g.select("order_id", "product_unit_id", "product", "long_name", money("unit_price"),
                    money("GMV_order", "gmv_order"), money("GMV_final", "gmv_final"))


@query("order_fact")
def _d5(t):
    cohort = CO.adopter_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)
    f = O.order_fact(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, cohort=cohort, cohort_how="left",
                     with_seller=True)
    return f.select(
        "order_date", "unique_id", "city", "province", "address_latitude", "address_longitude", "order_id",
        "acquisition_channel", "payment_method", money("GMV_order", "gmv_order"), money("GMV_final", "gmv_final"),
        "fulfilment_status", "platform_tag", "delivery_method", "seller_unique_id",
    )


@query("shipped_gmv")
def _d6(t):
    g = DL.shipped_gmv(t)
    return g.select("order_id", money("order_qty"), money("allocated_qty"), money("qty"), money("order_gmv"),
                    money("allocated_gmv"), money("tot_gmv"))


@query("delivery_fact")
def _d7(t):
    f = DL.delivery_fact(t, P.DELIVERIES_AFTER, cohort=CO.adopter_cohort(t, P.OPEN_ADOPTION_FROM), sides=C.STAR_REGION_SIDES)
    return f.withColumn("tot_gmv", money("tot_gmv"))


def region_buyers(t):
    return R.region_buyers(t, P.OPEN_ADOPTION_FROM, P.DELIVERIES_AFTER, C.STAR_REGION_SIDES)


@query("buyer_gmv")
def _d8(t):
    return region_buyers(t).withColumn("gmv_per_buyer", money("gmv_per_buyer"))


@query("buyer_gmv_by_method")
def _d8m(t):
    return R.gmv_buyers(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER).withColumn("gmv_per_buyer", money("gmv_per_buyer"))


@query("buyer_order_count")
def _d9(t):
    return R.order_buyers(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)


def _mix_buyers(t):
    cohort = CO.adopter_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)
    fact = O.order_fact(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, cohort=cohort, cohort_how="inner")
    return B.buyer_method_mix(R.market_fact(fact), R.MARKET_BUYER_KEYS)


@query("buyer_method_mix")
def _d10(t):
    return _mix_buyers(t)


@query("decile_threshold_gmv")
def _d11g(t):
    ab = R.gmv_buyers(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER)
    thr = D.decile_threshold(ab, ["province"], "gmv_per_buyer", "gmv_percentile")
    return thr.withColumn("gmv_percentile", money("gmv_percentile"))


@query("decile_threshold_orders")
def _d11o(t):
    ab = R.order_buyers(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)
    return D.decile_threshold(ab, ["province"], "count_order", "order_percentile")


@query("top_decile_summary")
def _d12(t):
    """D12 on the GMV buyers per province, no HAVING, with the distinct buyer count (M7)."""
    ab = R.gmv_buyers(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER)
    thr = D.decile_threshold(ab, ["province"], "gmv_per_buyer", "gmv_percentile")
    s = D.top_decile_summary(ab, thr, ["province"], ["province"], "gmv_per_buyer", "gmv_percentile",
                             distinct_buyers=True)
    return s.withColumn("gmv_percentile", money("gmv_percentile"))


@query("top_decile_leads_anti")
def _d13a(t):
    """D13 by GMV as an anti-join on the cohort."""
    ab = R.gmv_buyers(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER)
    thr = D.decile_threshold(ab, ["province"], "gmv_per_buyer", "gmv_percentile")
    leads = D.top_decile_leads_anti(ab, thr, ["province"], "gmv_per_buyer", "gmv_percentile",
                                    CO.adopter_cohort(t, P.OPEN_ADOPTION_FROM))
    return leads.select(
        "buyer_code", "city", "province", F.col("address_latitude").alias("buyer_lat"),
        F.col("address_longitude").alias("buyer_long"), "is_platform_user", "percentile", money("gmv_percentile"),
        money("gmv_per_buyer"),
    )


@query("method_share")
def _d14(t):
    """D14 over every buyer (cohort as tag), 4 digits."""
    cohort = CO.adopter_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)
    fact = O.order_fact(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, cohort=cohort, cohort_how="left")
    buyers = B.buyer_method_mix(R.market_fact(fact), R.MARKET_BUYER_KEYS)
    return B.method_share(buyers, "province", 4)


@query("method_share_intdiv")
def _d14i(t):
    """D14 with integer division (the report's source-database semantics, T2)."""
    return R.method_mix(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, digits=2,
                        exact_int=True)


@query("manifest_link")
def _d15(t):
    return DL.manifest_link(t)


@query("manifest_total")
def _d16(t):
    """D16 on the escrow lines of every payment type (prepaid lines carry a zero fee)."""
    return R.cod_escrow(t, "finance", cod_only=False)


@query("manifest_total_deduped")
def _d16d(t):
    return R.cod_escrow(t, "finance", dedupe_first=True)


@query("active_offers")
def _d17(t):
    return OF.active_offers(t).withColumn("unit_price", money("unit_price"))


@query("best_offer")
def _d18(t):
    return OF.best_offer(OF.active_offers(t)).withColumn("min_unit_price", money("min_unit_price"))


@query("buyer_basket")
def _d19(t):
    fact = O.order_fact(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, cap_inclusive=True, with_seller=True,
                        grain="item")
    b = OF.buyer_basket(fact)
    return b.select("buyer_unique_id", "product_unit_id", "product", "uom", money("unit_price"), money("total_gmv"),
                    "count_seller")


@query("price_gap")
def _d20(t):
    """D20 for every buyer, without date window or value cap."""
    return R.price_benchmark(t, None, None, None)


@query("acquisition_channel")
def _d21(t):
    tr = t.mk_transaction.select(F.col("id").alias("order_id"), "buyer_store_id")
    s = t.mk_store.select(F.col("id").alias("s_id"), "fee_group_id")
    fg = t.mk_fee_group.select(F.col("id").alias("fg_id"), F.col("name").alias("fee_group"))
    x = tr.join(s, tr.buyer_store_id == s.s_id, "left").join(fg, F.col("fee_group_id") == fg.fg_id, "left")
    return x.select("order_id", "fee_group", C.acquisition_channel("fee_group").alias("acquisition_channel"))


@query("payment_bucket")
def _d22(t):
    p = t.mk_payment
    return p.select("transaction_id", "payment_method_detail_type",
                    C.payment_bucket("payment_method_detail_type").alias("payment_method"))


@query("region_side")
def _d23(t):
    da = t.lg_delivery_address
    return da.select("id", "province", C.region_side("province", C.STAR_REGION_SIDES).alias("side"))


@query("area_hierarchy")
def _d24(t):
    s = t.mk_store.select("id", "unique_id", "address_city_id")
    return O.with_area(s, t, "address_city_id").select("id", "unique_id", "city", "province")


@query("cod_fee")
def _d25(t):
    o = t.lg_order
    return o.select("id", "payment_type", money(C.cod_fee("payment_type", "delivery_fee_value"), "cod_fee"))


# ============================================================================ dormant features M1–M8
@query("cod_tax_split")
def _m1(t):
    o = t.lg_order
    fee = C.cod_fee("payment_type", "delivery_fee_value")
    base, vat = C.cod_tax_split(fee)
    return o.select("id", money(fee, "cod_fee"), money(base, "fee_base"), money(vat, "fee_vat"))


@query("seller_fees")
def _m2(t):
    g = O.order_gmv(t, with_fees=True)
    return g.select("order_id", money("seller_fee_amount"), money("seller_fee_discount"), money("total_nett_fee"))


@query("order_gmv_method_aware")
def _m3(t):
    g = O.order_gmv(t, method_aware=True)
    return g.select("order_id", money("GMV_final", "gmv_final"), money("GMV_final_seller", "gmv_final_seller"))


@query("province_coverage_gmv")
def _m4g(t):
    return R.province_coverage_gmv(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER, P.HAVING_MIN_GMV)


@query("province_coverage_orders")
def _m4o(t):
    return R.province_coverage_orders(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE,
                                      P.VALUE_CAP, P.HAVING_MIN_ORDERS)


@query("region_leads")
def _m5(t):
    return R.region_leads(t, P.OPEN_ADOPTION_FROM, P.DELIVERIES_AFTER, sides=C.STAR_REGION_SIDES)


@query("manifest_search")
def _m6(t):
    return R.cod_escrow(t, "finance", manifest_search=P.MANIFEST_SEARCH)


@query("cod_escrow_detailed")
def _m8(t):
    """R1 with the descriptive columns (M8) and the fee tax split (M1)."""
    return R.cod_escrow(t, "finance", detailed=True, with_tax=True, sides=C.STAR_REGION_SIDES)


# ============================================================================ primitives (§2.D–§2.J)
@query("left_join_on_predicate")
def _j9(t):
    o = t.lg_order.select("id")
    ol = DL.shipped_gmv(t, full=False)
    x = o.join(ol, (o.id == ol.order_id) & (ol.qty > 0), "left")
    return x.select("id", money("qty"), money("tot_gmv"))


@query("semi_join_cohort")
def _j4(t):
    s = t.mk_store.select("id", "unique_id")
    c = CO.adopter_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)
    return s.join(c, "unique_id", "left_semi").select("id", "unique_id")


@query("anti_join_cohort")
def _j6(t):
    s = t.mk_store.select("id", "unique_id")
    c = CO.adopter_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)
    return s.join(c, "unique_id", "left_anti").select("id", "unique_id")


@query("range_join_first_use")
def _j7(t):
    fu = CO.first_use_cohort(t, P.ADOPTION_FROM, P.ADOPTION_TO)
    tr = t.mk_transaction.select(F.col("id").alias("t_id"), "buyer_store_id")
    o = t.mk_order.select(F.col("id").alias("order_id"), "transaction_id", "created_at")
    s = t.mk_store.select(F.col("id").alias("s_id"), "unique_id")
    x = o.join(tr, o.transaction_id == tr.t_id).join(s, F.col("buyer_store_id") == s.s_id)
    x = x.join(fu, (x.unique_id == fu.unique_id) & (x.created_at >= fu.order_date)).drop(fu.unique_id)
    return x.select("order_id", "unique_id", "created_at", F.col("order_date").alias("first_use"))


@query("using_join")
def _j15(t):
    best = OF.best_offer(OF.active_offers(t)).select("product_unit_id", "min_unit_price")
    ou = t.mk_order_unit.select("order_id", "product_unit_id", "unit_price")
    x = ou.join(best, "product_unit_id", "left")
    return x.select("order_id", "product_unit_id", money("unit_price"), money("min_unit_price"))


@query("self_join_area")
def _j11(t):
    a = t.mk_address_area.where(F.col("parent_area_id").isNotNull()).select(
        F.col("id").alias("city_id"), "parent_area_id", F.col("name").alias("city_name"))
    p = t.mk_address_area.select(F.col("id").alias("p_id"), F.col("name").alias("province_name"))
    x = a.join(p, a.parent_area_id == p.p_id, "left")
    s = t.mk_store.select(F.col("id").alias("store_id"), "address_city_id")
    return s.join(x, s.address_city_id == x.city_id, "left").select("store_id", "city_name", "province_name")


@query("composite_key_join")
def _j10(t):
    d = t.lg_delivery.select(F.col("id").alias("delivery_id"), "pickup_address_id")
    # only a match has a pick-up, so the left joins become inner ones
    return DL.attach_manifest(d, t).where(F.col("pickup_id").isNotNull()).select("delivery_id", "ride_id", "manifest_no")


@query("is_false_filter")
def _p10(t):
    o = t.lg_order.where(C.is_false("is_full_truck_load"))
    return o.select("id", "is_full_truck_load")


@query("in_list_filter")
def _p12(t):
    f = t.mk_order_fulfilment.where(F.col("delivery_method").isin(C.PLATFORM, C.STORE_COURIER))
    return f.select("order_id", "delivery_method", "status")


@query("like_bucket")
def _p13(t):
    p = t.mk_payment.select(C.payment_bucket("payment_method_detail_type").alias("payment_method"))
    return p.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n_payment"))


@query("month_prefix_filter")
def _p16(t):
    f = t.mk_order_fulfilment.where(C.in_months("status_updated_at", P.ADOPTION_FROM, P.ADOPTION_TO))
    return f.groupBy("delivery_method", "status").agg(F.count(F.lit(1)).alias("n_fulfilment"))


@query("local_day_trunc")
def _x2(t):
    e = t.star.events.select("ts", "value")
    x = e.select(C.local_day("ts").alias("local_day"), C.local_month("ts").alias("local_month"), "value")
    return x.groupBy("local_day", "local_month").agg(
        F.count(F.lit(1)).alias("n_event"), money(F.sum(F.col("value").cast("decimal(18,2)")), "value_sum"))


@query("having_filter")
def _a13(t):
    f = O.order_fact(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)
    g = f.groupBy("unique_id").agg(F.count_distinct("order_id").alias("n_order"))
    return g.where(F.col("n_order") > F.lit(5))


@query("distinct_count")
def _a6(t):
    f = O.order_fact(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)
    return f.groupBy("province").agg(F.count_distinct("unique_id").alias("n_buyer"),
                                     F.count_distinct("order_id").alias("n_order"))


@query("percent_rank_window")
def _w1(t):
    ab = R.gmv_buyers(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER)
    pr = D.percent_rank(ab, ["province"], "gmv_per_buyer", method="distributed")
    return pr.select("buyer_code", "province", "delivery_method", money("gmv_per_buyer"), "pct_rank",
                     (C.tenth_bucket("pct_rank") / 10).alias("percentile"))


@query("partition_total_window")
def _w4(t):
    d = t.lg_delivery.select(F.col("id").alias("delivery_id"), "order_id", "batch_id")
    ol = DL.shipped_gmv(t, full=False).select(F.col("order_id").alias("ol_order_id"), "tot_gmv")
    x = d.join(ol, d.order_id == ol.ol_order_id, "left").select("delivery_id", "batch_id", "tot_gmv")
    x = partition_total(x, ["batch_id"], "tot_gmv", "batch_total")
    return x.select("delivery_id", "batch_id", money("tot_gmv"), money("batch_total"))


@query("search_path")
def _s2(t):
    """One statement by unqualified name, and the other system's table of that name: orders per buyer in both."""
    namespaces.publish(t.spark, t.sf_dir)
    bought = namespaces.resolve(t.spark, namespaces.MARKET, """
        SELECT s.unique_id AS buyer_code, count(*) AS bought, max(o.created_at) AS last_order
        FROM `order` o JOIN `transaction` t ON t.id = o.transaction_id JOIN store s ON s.id = t.buyer_store_id GROUP BY 1""")
    brought = namespaces.resolve(t.spark, namespaces.FLEET, """
        SELECT a.buyer_code, count(*) AS brought, count(DISTINCT o.priority) AS priorities
        FROM `order` o JOIN delivery_address a ON a.id = o.delivery_address_id GROUP BY 1""")
    return bought.join(brought, "buyer_code", "full")


@query("mixed_sort")
def _o3(t):
    ab = R.gmv_buyers(t, P.OPEN_ADOPTION_FROM, P.ORDERS_AFTER)
    return ab.select("buyer_code", "delivery_method", money("gmv_per_buyer")).orderBy(
        F.col("buyer_code").asc(), F.col("delivery_method").asc(), F.col("gmv_per_buyer").desc_nulls_first())
