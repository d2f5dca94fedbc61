"""Rows that lie by order id, or by manifest, are joined, summed and made distinct there: exchanges counted in the plans."""

import os

import pytest
from pyspark.sql import functions as F

from lastmile.operators import deliveries as DL
from lastmile.operators import joins
from lastmile.operators.joins import partition_total
from lastmile.operators.orders import order_item_gmv
from lastmile.plans import reports as R
from lastmile.sources.domain import Tables

SMOKE_DIR = "/root/testdata/sf0.001"
AS_AT_SIZE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture()
def star(spark):
    """The star tables' domain, planned as at size: nothing is small enough to be broadcast unasked."""
    old = {k: spark.conf.get(k, None) for k in AS_AT_SIZE}
    for k, v in AS_AT_SIZE.items():
        spark.conf.set(k, v)
    yield Tables(spark, SMOKE_DIR)
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in plan.splitlines())


def test_both_lines_of_kept_orders_are_shuffled_once(star):
    orders = star.lg_order.where("payment_type = 'COD'").select(F.col("id").alias("order_id"))
    got = DL.shipped_gmv(star, orders=orders)
    assert exchanges(got) <= 3  # order lines, delivery lines and the orders, which are reused
    want = DL.shipped_gmv(star).join(orders, "order_id", "left_semi")
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_lines_and_deliveries_are_grouped_by_order_in_one_exchange(star):
    lines = star.star.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate").distinct().count()
    assert lines > 0
    plan = star._delivery_base._jdf.queryExecution().optimizedPlan().toString()
    assert "manifest" not in plan.splitlines()[0]
    assert set(star._delivery_base.columns) >= {"order_id", "supplier", "ship_month"} and "manifest_no" not in star._delivery_base.columns


def test_item_groups_meet_their_fulfilment_counts_where_they_are(star):
    # units to products, products to names and to units of measure, grouped by order, counts: both sides of two joins
    # between products, one of them with units, and fulfilments by (order, flag), by order
    assert exchanges(order_item_gmv(star)) <= 11


def test_distinct_rows_with_their_total_are_not_shuffled_again(spark, star):
    rows = [("a", 1, 2), ("a", 1, 2), ("a", 3, 4), (None, 5, 6), (None, 5, 6), ("b", 7, None), *[("hot", k % 3, 1) for k in range(3000)]]
    df = spark.createDataFrame(rows, "manifest string, x long, v long")
    row = [F.col("manifest"), F.col("x").cast("double").alias("x"), F.col("v").cast("double").alias("v")]
    got = partition_total(df, ["manifest"], "v", "total", distinct_as=row, heavy=0.5)
    plain = partition_total(df, ["manifest"], "v", "total", heavy=0.5)
    assert exchanges(got) == exchanges(plain)
    want = partition_total(df, ["manifest"], "v", "total", method="window", distinct_as=row)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert {(r["manifest"], r["total"]) for r in got.collect()} == {("a", 8), (None, 12), ("b", None), ("hot", 3000)}


def test_both_lines_of_kept_orders_share_one_exchange(star):
    orders = star.lg_order.select(F.col("id").alias("order_id"))
    assert exchanges(DL.shipped_gmv(star, orders=orders)) <= 2  # lines and orders: the second line table reuses both


def test_lines_drawn_for_orders_are_those_of_the_line_tables(spark, tmp_path):
    rows = [
        (1, 10, 5, 1, 2.0, 10.25, 0.0, 0.0, "R", "F", "2024-01-31 10:00:00"),
        (1, 10, 5, 1, 2.0, 10.25, 0.0, 0.0, "R", "F", "2024-01-31 10:00:00"),
        (1, None, 6, 2, None, 7.5, 0.0, 0.0, None, "F", None),
        (None, 11, 5, 1, 3.0, 1.0, 0.0, 0.0, "A", "F", "2024-02-01 00:00:00"),
        (2, 12, None, None, 4.0, None, 0.0, 0.0, "N", "O", "2024-02-29 23:59:59"),
        (3, 13, 7, 1, 5.0, 9.99, 0.0, 0.0, "N", "O", "2024-03-01 00:00:00"),
    ]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
              "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string")
    lines = spark.createDataFrame(rows, schema).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    orders = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,)], "order_id long")
    for drawn, table, n in zip(t.lines_of(orders), (t.lg_order_line, t.lg_delivery_line), (4, 4), strict=True):
        want = table.join(orders, "order_id", "left_semi").select(table.columns)
        assert drawn.schema == want.schema and drawn.count() == n
        assert sorted(drawn.collect(), key=str) == sorted(want.collect(), key=str)


def test_drivers_users_and_fleets_are_broadcast_by_their_own_size(spark, star):
    size = os.path.getsize(f"{SMOKE_DIR}/supplier.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * size))
    plan = R.cod_escrow(star, cod_only=False, total_method="window")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ride_id" in plan
    assert "hashpartitioning(driver_id" not in plan and "hashpartitioning(user_id" not in plan


def test_rows_of_a_manifest_lie_together_before_they_are_summed(star):
    plan = R.cod_escrow(star, cod_only=False, total_method="window")._jdf.queryExecution().executedPlan().toString().splitlines()
    # the last exchanges are printed first
    by = [next(c for c in ("delivery_address_id", "ride_id") if f"hashpartitioning({c}" in x) for x in plan if "hashpartitioning(delivery_address_id" in x or "hashpartitioning(ride_id" in x]
    assert by[:2] == ["ride_id", "delivery_address_id"]


def test_tasks_that_add_totals_hold_a_bounded_number_of_rows(spark, star, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_A_TASK", 100)
    rows = [(None if k % 3 == 1 else f"m{k % 900}", k % 50, k) for k in range(6000)]
    df = spark.createDataFrame(rows, "manifest string, x long, v long")
    row = [F.col("manifest"), F.col("x"), (F.col("v") * 2).alias("w")]
    got = partition_total(df, ["manifest"], F.col("v") + 1, "total", distinct_as=row)
    # the lines once, and the totals by manifest and to their lines
    assert exchanges(got) <= 4
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 40 and max(r["count"] for r in tasks) < 400
    want = partition_total(df, ["manifest"], F.col("v") + 1, "total", method="window", distinct_as=row)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
