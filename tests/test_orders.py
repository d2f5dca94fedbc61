"""Order operators: fulfilment fan-out (T6), method-aware GMV (M3), cohorts (D1/D2), order fact, method share."""

import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from lastmile.operators import buyers as B
from lastmile.operators import cohorts as CO
from lastmile.operators import orders as O
from lastmile.sources.domain import Tables

from conftest import SMOKE_DIR

UNIT = ("order_id long, product_unit_id long, unit_price decimal(18,2), ordered_quantity decimal(18,2), "
        "final_delivered_quantity decimal(18,2), final_picked_quantity decimal(18,2), "
        "final_returned_quantity decimal(18,2), seller_fee_amount decimal(18,4), seller_fee_discount decimal(18,4)")
FUL = "order_id long, status string, delivery_method string, status_updated_at timestamp_ntz, deleted timestamp_ntz"


def _units():
    d = Dec
    return [
        (1, 10, d("10.00"), d("2.00"), d("2.00"), d("2.00"), d("0.00"), d("1.0000"), d("0.5000")),
        (2, 10, d("10.00"), d("1.00"), d("1.00"), d("1.00"), d("0.00"), d("1.0000"), d("0.0000")),
        (2, 11, d("3.50"), d("4.00"), d("0.00"), d("4.00"), d("1.00"), d("0.2000"), d("0.1000")),
        (3, 12, d("7.00"), d("1.00"), d("1.00"), d("1.00"), d("1.00"), d("0.0000"), d("0.0000")),
    ]


def _fulfilments():
    ts = dt.datetime(2021, 2, 3)
    return [
        # order 1: none; order 2: one; order 3: three (two platform)
        (2, "COMPLETED", "SELF_PICKUP", ts, None),
        (3, "COMPLETED", "PLATFORM", ts, None),
        (3, "COMPLETED", "PLATFORM", ts, None),
        (3, "COMPLETED", "STORE_COURIER", ts, None),
    ]


def _literal_gmv(t):
    """The report's form: LEFT JOIN fulfilments, then sum (fan-out included)."""
    x = t.mk_order_unit.join(t.mk_order_fulfilment.select("order_id", "delivery_method"), "order_id", "left")
    p = F.col("unit_price")
    seller_q = F.when(F.col("delivery_method") == "PLATFORM",
                      F.col("final_picked_quantity") - F.col("final_returned_quantity")).otherwise(F.col("final_delivered_quantity"))
    return x.groupBy("order_id").agg(
        F.sum(p * F.col("ordered_quantity")).alias("GMV_order"),
        F.sum(p * F.col("final_delivered_quantity")).alias("GMV_final"),
        F.sum(p * seller_q).alias("GMV_final_seller"),
        F.sum("seller_fee_amount").alias("seller_fee_amount"),
    )


def test_fanout_rewrite_equals_literal_join(tables):
    t = tables(mk_order_unit=(UNIT, _units()), mk_order_fulfilment=(FUL, _fulfilments()))
    cols = ["order_id", "GMV_order", "GMV_final", "GMV_final_seller", "seller_fee_amount"]
    ours = O.order_gmv(t, with_fees=True, method_aware=True)
    got = sorted(tuple(r[c] for c in cols) for r in ours.collect())
    want = sorted(tuple(r[c] for c in cols) for r in _literal_gmv(t).collect())
    assert got == want
    by_order = {r[0]: r for r in got}
    # property: fan-out GMV = plain GMV × max(1, fulfilments of the order)
    plain = {r["order_id"]: r["GMV_order"] for r in O.order_gmv(t, fanout=False).collect()}
    assert by_order[1][1] == plain[1] * 1 and by_order[2][1] == plain[2] * 1 and by_order[3][1] == plain[3] * 3


def test_order_item_gmv_fanout(tables):
    t = tables(
        mk_order_unit=(UNIT, _units()), mk_order_fulfilment=(FUL, _fulfilments()),
        mk_product_unit=("id long, product_variant_id long, unit_of_measurement_id long", [(10, 10, 10), (12, 12, 12)]),
        mk_product_variant=("id long, name string", [(10, "ten"), (12, "twelve")]),
        mk_unit_of_measurement=("id long, long_name string", [(10, "box"), (12, "crate")]),
    )
    got = {(r["order_id"], r["product_unit_id"]): (r["product"], r["GMV_order"]) for r in O.order_item_gmv(t).collect()}
    assert got[(3, 12)] == ("twelve", Dec("21.0000"))  # 7 × 1 × 3 fulfilments
    assert got[(2, None)] == (None, Dec("14.0000"))  # unit without product keeps NULL names


def test_cohort_month_edges_and_first_use(tables):
    ts = dt.datetime
    ful = [
        (1, "COMPLETED", "PLATFORM", ts(2021, 2, 1, 0, 0), None),  # first instant: in
        (2, "COMPLETED", "PLATFORM", ts(2021, 2, 28, 23, 59, 59), None),  # last instant: in
        (3, "COMPLETED", "PLATFORM", ts(2021, 3, 1, 0, 0), None),  # next month: out
        (4, "OPEN", "PLATFORM", ts(2021, 2, 10), None),  # not completed
        (5, "COMPLETED", "PLATFORM", ts(2021, 2, 10), None),  # transaction deleted
    ]
    t = tables(
        mk_order_fulfilment=(FUL, ful),
        mk_order=("id long, transaction_id long, created_at timestamp_ntz, deleted timestamp_ntz",
                  [(i, i, ts(2021, 1, 20 + i), None) for i in range(1, 6)]),
        mk_transaction=("id long, buyer_store_id long, deleted timestamp_ntz",
                        [(1, 100, None), (2, 100, None), (3, 300, None), (4, 400, None), (5, 500, ts(2021, 1, 1))]),
        mk_store=("id long, unique_id string", [(100, "A"), (300, "C"), (400, "D"), (500, "E")]),
    )
    assert sorted(r[0] for r in CO.adopter_cohort(t, "2021-02", "2021-03").collect()) == ["A"]
    assert sorted(r[0] for r in CO.adopter_cohort(t, "2021-02").collect()) == ["A", "C"]
    fu = {r["unique_id"]: r["order_date"] for r in CO.first_use_cohort(t, "2021-02", "2021-03").collect()}
    assert fu == {"A": ts(2021, 1, 21)}


def test_one_store_table_in_both_roles(tables):
    day = dt.datetime(2021, 2, 3)
    t = tables(
        mk_transaction=("id long, buyer_store_id long, deleted timestamp_ntz", [(1, 100, None), (2, 200, None), (3, 100, None), (4, 900, None)]),
        mk_order=("id long, transaction_id long, seller_store_id long, created_at timestamp_ntz, deleted timestamp_ntz",
                  [(1, 1, 200, day, None), (2, 2, 100, day, None), (3, 3, 100, day, None), (4, 4, None, day, None)]),
        mk_order_fulfilment=(FUL, [(k, "COMPLETED", "PLATFORM", day, None) for k in (1, 2, 3, 4)]),
        mk_payment=("transaction_id long, payment_method_detail_type string", [(1, None)]),
        mk_store=("id long, unique_id string, address_city_id long, address_latitude double, address_longitude double, fee_group_id string, is_active boolean",
                  [(100, "A", 7, 1.0, 2.0, "x", True), (200, "B", 8, 3.0, 4.0, None, True)]),
        mk_fee_group=("id string, name string", [("x", "ONLINE")]),
        mk_address_area=("id long, name string, parent_area_id long", [(7, "seven", 70), (8, "eight", None), (70, "seventy", None)]),
        mk_order_unit=(UNIT, [(k, 10, Dec(1), Dec(1), Dec(1), Dec(1), Dec(0), Dec(0), Dec(0)) for k in (1, 2, 3, 4)]),
    )
    got = O.order_fact(t, None, with_seller=True).select("order_id", "unique_id", "city", "province", "seller_unique_id").collect()
    # stores that buy and sell, from themselves too; an unknown store or none leaves nulls
    assert sorted(map(tuple, got)) == [(1, "A", "seven", "seventy", "B"), (2, "B", "eight", None, "A"), (3, "A", "seven", "seventy", "A"),
                                       (4, None, None, None, None)]


def test_method_share_counts_rows_and_intdiv(spark):
    # one buyer: 2 orders, one of them repeated by 2 payments -> platform rows 3 > orders 2 (share > 100, T6)
    fact = spark.createDataFrame(
        [("b1", "P1", 1, "PLATFORM"), ("b1", "P1", 1, "PLATFORM"), ("b1", "P1", 2, "PLATFORM"),
         ("b2", "P1", 3, "SELF_PICKUP"), ("b2", "P1", 4, "PLATFORM")],
        "buyer_code string, province string, order_id long, delivery_method string",
    )
    buyers = B.buyer_method_mix(fact, ["buyer_code", "province"])
    r = B.method_share(buyers, "province", 2).first()
    assert (r["total_order"], r["platform_delivery"], r["self_pickup"]) == (4, 4, 1)
    assert r["platform_delivery_share_pct"] == round((3 / 2 + 1 / 2) / 2, 2) * 100
    ri = B.method_share(buyers, "province", 2, exact_int=True).first()
    assert ri["platform_delivery_share_pct"] == round((1 + 0) / 2, 2) * 100


def test_order_fact_filters_and_fanout_on_smoke_data(spark):
    t = Tables(spark, SMOKE_DIR)
    f = O.order_fact(t, "19960101", "20000101", 15_000_000)
    rows = f.select("order_id", "fulfilment_status", "GMV_order").collect()
    assert rows and all(r["fulfilment_status"] == "COMPLETED" and r["GMV_order"] < 15_000_000 for r in rows)
    created = t.mk_order.where(F.col("id").isin([r["order_id"] for r in rows[:50]])).collect()
    assert all(dt.datetime(1996, 1, 1) < r["created_at"] < dt.datetime(2000, 1, 1) for r in created)
