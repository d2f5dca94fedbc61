"""Logistics (D6, D15, D16, T7, T14) and offer operators."""

from decimal import Decimal as Dec

from pyspark.sql import functions as F

from lastmile.operators import deliveries as DL
from lastmile.operators import offers as OF
from lastmile.operators.joins import partition_total

from conftest import rows_of


def test_shipped_gmv_and_checked_zero(tables):
    t = tables(
        lg_order_line=("id string, order_id long, price_unit decimal(18,2)",
                       [("l1", 1, Dec("10.00")), ("l2", 1, Dec("5.00")), ("l3", 2, Dec("4.00"))]),
        lg_delivery_line=("order_line_id string, order_id long, quantity decimal(18,2), allocated_quantity decimal(18,2), "
                          "checked_quantity decimal(18,2)",
                          [("l1", 1, Dec("2"), Dec("2"), Dec("2")), ("l2", 1, Dec("1"), Dec("1"), Dec("0")),
                           ("l3", 2, Dec("3"), Dec("3"), Dec("0"))]),
    )
    got = {r["order_id"]: (r["qty"], r["tot_gmv"], r["order_gmv"]) for r in DL.shipped_gmv(t).collect()}
    assert got[1] == (Dec("2.00"), Dec("20.0000"), Dec("25.0000"))
    assert got[2][0] == 0  # consumers drop it through ``qty > 0`` in the join condition (J9)


def test_manifest_link_two_tasks_and_missing_pickup(tables):
    t = tables(
        lg_delivery=("id string, order_id long, pickup_address_id long", [("d1", 1, 7), ("d2", 2, 8)]),
        lg_task=("delivery_id string, ride_id string, pickup_id string, driver_id long",
                 [("d1", "r1", None, 1), ("d1", "r2", None, 1), (None, "r1", "p1", 1), (None, "r2", "p2", 1),
                  ("d2", "r3", None, 2)]),
        lg_pickup=("id string, pickup_address_id long, rpb_number string", [("p1", 7, "M-1"), ("p2", 9, "M-2")]),
    )
    got = rows_of(DL.manifest_link(t), "delivery_id", "ride_id", "manifest_no")
    # d1 has two tasks: r1 matches its address, r2's pick-up is elsewhere; d2's ride has no pick-up
    assert sorted(map(str, got)) == sorted(map(str, [("d1", "r1", "M-1"), ("d1", "r2", None), ("d2", "r3", None)]))


def test_manifest_total_before_distinct_and_null_manifest(spark):
    df = spark.createDataFrame(
        [("M1", "a", Dec("10.00")), ("M1", "a", Dec("10.00")), ("M1", "b", None), (None, "c", Dec("1.00")),
         (None, "d", Dec("2.00"))],
        "manifest_no string, line string, line_total decimal(18,2)",
    )
    agg = DL.with_manifest_total(df)
    win = DL.with_manifest_total(df, method="window")
    key = ("manifest_no", "line", "line_total", "manifest_total")
    assert sorted(map(str, rows_of(agg, *key))) == sorted(map(str, rows_of(win, *key)))
    totals = {(r["manifest_no"], r["line"]): r["manifest_total"] for r in agg.collect()}
    assert totals[("M1", "a")] == Dec("20.00")  # duplicate line counted twice (T7); NULL line ignored (T14)
    assert totals[(None, "c")] == Dec("3.00")  # NULL manifest is one group
    dd = {(r["manifest_no"], r["line"]): r["manifest_total"] for r in DL.with_manifest_total(df, dedupe_first=True).collect()}
    assert dd[("M1", "a")] == Dec("10.00")


def test_partition_total_hot_key(spark):
    # one key with most rows: aggregate form stays equal to the window
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v long")
    a = partition_total(df, ["k"], "v", "tot").groupBy("k").agg(F.max("tot")).collect()
    w = partition_total(df, ["k"], "v", "tot", method="window").groupBy("k").agg(F.max("tot")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, w))


def test_offers_price_gap(tables):
    t = tables(
        mk_product_unit=("id long, product_variant_id long, unit_of_measurement_id long", [(1, 1, 1), (2, 2, 2), (3, 3, 3)]),
        mk_product_variant=("id long, name string", [(1, "one"), (2, "two"), (3, "three")]),
        mk_unit_of_measurement=("id long, long_name string", [(1, "pc"), (2, "pc"), (3, "pc")]),
        mk_inventory=("id string, product_unit_id long, store_id long, is_active boolean, deleted timestamp_ntz",
                      [("i1", 1, 10, True, None), ("i2", 1, 11, True, None), ("i3", 2, 10, False, None),
                       ("i4", 3, 12, True, None)]),
        mk_store=("id long, unique_id string, is_active boolean", [(10, "S10", True), (11, "S11", True), (12, "S12", False)]),
        mk_price_tier=("inventory_id string, unit_price decimal(18,2), is_active boolean, deleted timestamp_ntz",
                       [("i1", Dec("8.00"), True, None), ("i2", Dec("12.00"), True, None), ("i3", Dec("1.00"), True, None),
                        ("i4", Dec("1.00"), True, None)]),
    )
    offers = OF.active_offers(t)
    best = {r["product_unit_id"]: (r["available_store"], r["min_unit_price"]) for r in OF.best_offer(offers).collect()}
    assert best == {1: (2, Dec("8.00"))}  # inactive inventory and inactive store drop
    assert {r["store_code"] for r in OF.active_offers(t, ["S11"]).collect()} == {"S11"}
    basket = t.mk_product_unit.sparkSession.createDataFrame(
        [("B", 1, "one", "pc", Dec("10.00"), Dec("10.00"), 1), ("B", 2, "two", "pc", Dec("5.00"), Dec("5.00"), 1),
         ("C", 1, "one", "pc", Dec("0.00"), Dec("0.00"), 1), ("D", 1, "one", "pc", Dec("4.00"), Dec("4.00"), 1)],
        "buyer_unique_id string, product_unit_id long, product string, uom string, unit_price decimal(18,2), "
        "total_gmv decimal(18,2), count_seller long")
    gap = {(r["buyer_unique_id"], r["product_unit_id"]): r["margin_pct"] for r in OF.price_gap(basket, OF.best_offer(offers)).collect()}
    assert gap[("B", 1)] == (10.0 - 8.0) / 10.0
    assert gap[("B", 2)] is None  # no offer
    assert gap[("C", 1)] is None  # zero paid price (T12)
    assert gap[("D", 1)] == (4.0 - 8.0) / 4.0  # offer above paid price -> negative


def test_escrow_report_parameters(spark):
    # M6: delivery date, tag status and delivery status narrow the lines; the manifest total is
    # taken over the narrowed lines (the filters sit in the report's WHERE, before the window)
    import datetime as dt

    from lastmile.plans import reports as R
    from lastmile.sources.domain import Tables

    from conftest import SMOKE_DIR

    t = Tables(spark, SMOKE_DIR)
    full = R.cod_escrow(t, "finance").collect()
    day = full[0]["delivery_date"]
    by_day = R.cod_escrow(t, "finance", delivery_date=day).collect()
    assert by_day and {r["delivery_date"] for r in by_day} == {day}
    assert len(by_day) == sum(1 for r in full if r["delivery_date"] == day)
    returned = R.cod_escrow(t, "finance", tag_status="returned").collect()
    assert returned and {r["delivery_tag_status"] for r in returned} == {"returned"}
    opened = R.cod_escrow(t, "finance", delivery_status="open").collect()
    assert opened and {r["delivery_status"] for r in opened} == {"open"}
    for r in by_day:  # totals over the narrowed lines: at least the distinct lines (duplicates add, T7)
        same = [x["line_total"] for x in by_day if x["manifest_no"] == r["manifest_no"] and x["line_total"] is not None]
        if same:
            assert r["manifest_total"] >= sum(same) - 1e-6
        else:
            assert r["manifest_total"] is None
    assert isinstance(day, dt.date)
    spark.catalog.clearCache()
