"""Stored domain tables: bucketed by order id, partitioned by month, same results, no shuffle in order-keyed steps."""

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lastmile.operators import orders as O
from lastmile.operators import deliveries as DL
from lastmile.plans import params as P
from lastmile.plans import reports as R
from lastmile.plans.catalog import plans
from lastmile.sources.domain import Tables
from lastmile.sources.stored import StoredTables, order_months, save_domain
from tools.plan_report import walk

from conftest import SMOKE_DIR


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_stored_tables_match_and_skip_order_shuffles(spark, tmp_path):
    save_domain(Tables(spark, SMOKE_DIR), "t_stored", str(tmp_path), 4)
    stored = StoredTables(spark, "t_stored", SMOKE_DIR)
    derived = Tables(spark, SMOKE_DIR)
    for name in ("method_mix", "leads_by_gmv", "cod_escrow_logistics", "price_benchmark"):
        assert _rows(plans()[name](stored)) == _rows(plans()[name](derived)), name
        spark.catalog.clearCache()
    gmv = O.order_gmv(stored)
    gmv.collect()
    acc = Counter()
    walk(gmv._jdf.queryExecution().executedPlan(), acc, [])
    assert acc["Exchange"] == 0  # per-order sums and fulfilment counts read co-bucketed files


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    save_domain(Tables(spark, SMOKE_DIR), "t_months", str(tmp_path_factory.mktemp("months")), 2, by_month=True)
    return StoredTables(spark, "t_months", SMOKE_DIR)


def scans(df):
    """(table, partition filters) of every file scan of a plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"FileScan parquet \S*?t_months_(\w+)\[.*?PartitionFilters: \[(.*?), PushedFilters", text)
    assert found
    return found


ORDER_KEYED = ("mk_transaction", "mk_payment", "mk_order", "mk_order_fulfilment", "mk_order_unit")


def test_local_months_of_exclusive_utc_bounds():
    assert order_months("19960101", "19960125") == ("1996-01", "1996-01")
    assert order_months(dt.datetime(1996, 1, 31, 18), None) == ("1996-02", None)  # 01:00 of 1 February there


def test_a_date_window_reads_its_months_only(spark, by_month):
    report = R.buyer_orders(by_month, "19960105", "19960129", P.VALUE_CAP)
    keyed = [(name, filters) for name, filters in scans(report) if name in ORDER_KEYED]
    assert {name for name, _ in keyed} == set(ORDER_KEYED)
    assert all("order_month" in filters and "1996-01" in filters for _, filters in keyed)
    derived = Tables(spark, SMOKE_DIR)
    assert _rows(report) == _rows(R.buyer_orders(derived, "19960105", "19960129", P.VALUE_CAP))
    assert _rows(report)
    # 31 January 18:00 UTC and later is February in local time
    late = ("19960131", "19960205")
    assert _rows(R.buyer_orders(by_month, *late, P.VALUE_CAP)) == _rows(R.buyer_orders(derived, *late, P.VALUE_CAP))


def test_one_delivery_day_prunes_its_lines(spark, by_month):
    day = R.cod_escrow(Tables(spark, SMOKE_DIR)).first()["delivery_date"]
    report = R.cod_escrow(by_month, delivery_date=day)
    kept = by_month.lg_order.where(F.to_date("delivery_date") == F.lit(day)).where(F.col("order_month") == f"{day:%Y-%m}")
    lines = DL.shipped_gmv(by_month, orders=kept.select(F.col("id").alias("order_id"), "order_month"))
    filters = dict(scans(lines))
    assert f"{day:%Y-%m}" in filters["lg_order"]
    assert all("order_month" in filters[name] and "dynam" in filters[name] for name in ("lg_order_line", "lg_delivery_line"))
    assert _rows(report) == _rows(R.cod_escrow(Tables(spark, SMOKE_DIR), delivery_date=day)) != []
    for name in ("method_mix", "region_coverage"):
        assert _rows(plans()[name](by_month)) == _rows(plans()[name](Tables(spark, SMOKE_DIR))), name
        spark.catalog.clearCache()


def test_the_chain_of_rides_is_planned_once(spark, by_month):
    counted = Counter(name for name, _ in scans(DL.delivery_fact(by_month, P.DELIVERIES_AFTER)))
    assert counted["lg_task"] == counted["lg_ride"] == counted["lg_route"] == counted["lg_batch"] == counted["lg_delivery"] == 1
    counted = Counter(name for name, _ in scans(R.buyer_orders(by_month, "19960101", "20000101", P.VALUE_CAP)))
    assert counted["mk_order"] == counted["mk_transaction"] == counted["mk_order_unit"] == 1
    # the orders of listed buyers are found once, before units and fulfilments are read
    counted = Counter(name for name, _ in scans(R.buyer_orders(by_month, "19960101", "20000101", P.VALUE_CAP, buyers=P.SELECTED_BUYERS)))
    assert counted["mk_order"] == 0 and counted["mk_order_unit"] == 1


def test_both_roles_read_the_one_store_table(spark, by_month):
    fact = O.order_fact(by_month, "19960101", "20000101", with_seller=True).select("order_id", "unique_id", "seller_unique_id")
    read = re.findall(r"t_months_mk_store\[([^\]]*)\]", fact._jdf.queryExecution().executedPlan().toString())
    # one table, each role with its own columns: the city and fee group are the buyer's
    assert sorted(re.sub(r"#\d+L?", "", columns) for columns in read) == ["id,unique_id", "id,unique_id,address_city_id,fee_group_id"]
    both = {r["unique_id"] for r in by_month.mk_store.collect()}
    rows = fact.collect()
    assert rows and {r["unique_id"] for r in rows} <= both and {r["seller_unique_id"] for r in rows} <= both
    stores = by_month.mk_store
    assert stores.count() == stores.select("id").distinct().count()


def test_the_manifest_link_joins_rides_where_they_lie(spark, tmp_path):
    names = ("lg_delivery", "lg_task", "lg_pickup", "lg_ride")
    derived = Tables(spark, SMOKE_DIR)
    save_domain(derived, "t_rides", str(tmp_path), 4, names=names)
    stored = StoredTables(spark, "t_rides")
    for name in ("manifest_link", "composite_key_join"):
        assert _rows(plans()[name](stored)) == _rows(plans()[name](derived)) != [], name
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = DL.linked_tasks(stored)
        linked.collect()
        acc = Counter()
        walk(linked._jdf.queryExecution().executedPlan(), acc, [])
        assert acc["SortMergeJoin Inner"] == acc["SortMergeJoin LeftOuter"] == 1 and acc["Exchange"] == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_a_ride_with_several_pickups_and_a_pickup_of_two_rides(spark, tables, tmp_path):
    t = tables(
        lg_delivery=("id long, order_id long, pickup_address_id long", [(1, 10, 7), (2, 11, 9), (3, 12, 5), (4, 13, None), (5, 14, 7)]),
        lg_task=("delivery_id long, ride_id long, pickup_id long, driver_id long",
                 [(1, 100, None, 1), (2, 100, None, 1), (3, 100, None, 1), (4, 100, None, 1), (1, 200, None, 2),
                  (None, 100, 50, 1), (None, 100, 60, 1), (None, 200, 50, 2), (None, 300, 80, 3)]),
        lg_pickup=("id long, pickup_address_id long, rpb_number string", [(50, 7, "M-1"), (60, 9, None), (70, 5, "M-3")]),
        lg_ride=("id long", [(100,), (200,), (300,)]),
    )
    save_domain(t, "t_several", str(tmp_path), 2, names=("lg_delivery", "lg_task", "lg_pickup", "lg_ride"))
    stored = StoredTables(spark, "t_several")
    want = [(1, 10, 100, 50, "M-1"), (1, 10, 200, 50, "M-1"), (2, 11, 100, 60, None), (3, 12, 100, None, None),
            (4, 13, 100, None, None), (5, 14, None, None, None)]
    assert _rows(DL.manifest_link(stored)) == _rows(DL.manifest_link(t)) == sorted(map(str, want))
    assert _rows(plans()["composite_key_join"](stored)) == sorted(map(str, [(1, 100, "M-1"), (1, 200, "M-1"), (2, 100, None)]))
