"""Narrow reports prune before they aggregate; result order; line joins without an order id on the delivery line."""

import datetime as dt
from decimal import Decimal

from conftest import SMOKE_DIR
from lastmile.operators.deliveries import shipped_gmv
from lastmile.plans import params as P
from lastmile.plans import reports as R
from lastmile.plans.catalog import plans
from lastmile.sources.domain import Tables


def test_one_buyer_orders_semi_join_the_units_before_summing(spark):
    plan = R.buyer_orders(Tables(spark, SMOKE_DIR), "19960101", "19960125", P.VALUE_CAP, buyers=P.SELECTED_BUYERS[:1])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    sums = [k for k, line in enumerate(lines) if "Aggregate [order_id" in line and "sum(" in line]
    assert sums
    assert all("LeftSemi" in "\n".join(lines[k : k + 6]) for k in sums)


def test_buyer_argument_keeps_that_buyer_only(spark):
    t = Tables(spark, SMOKE_DIR)
    whole = R.buyer_orders(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP)
    buyer = whole.first()["unique_id"]
    narrow = R.buyer_orders(t, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP, buyers=[buyer])
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.where(whole.unique_id == buyer).collect()))


def test_reports_are_sorted_with_nulls_first(spark):
    t = Tables(spark, SMOKE_DIR)
    totals = [r["total_order"] for r in R.method_mix(t, P.ADOPTION_FROM, P.ADOPTION_TO, P.ORDERS_AFTER, P.ORDERS_BEFORE, P.VALUE_CAP).collect()]
    assert totals == sorted(totals, key=lambda x: (x is not None, -(x or 0)))
    days = [r["delivery_date"] for r in R.cod_escrow(t).collect()]
    assert days == sorted(days, key=lambda x: (x is not None, -(x or dt.date.min).toordinal()))


def test_lines_join_on_the_line_id_alone(tables):
    money = "decimal(18,2)"
    t = tables(
        lg_order_line=(f"id string, order_id long, price_unit {money}", [("a", 1, Decimal(2)), ("b", 2, Decimal(3))]),
        lg_delivery_line=(
            f"order_line_id string, quantity {money}, allocated_quantity {money}, checked_quantity {money}",
            [("a", Decimal(5), Decimal(4), Decimal(3)), ("b", Decimal(1), Decimal(1), Decimal(1))],
        ),
    )
    kept = t.lg_order_line.where("order_id = 1").select("order_id")
    got = [(r["order_id"], int(r["order_qty"]), int(r["tot_gmv"])) for r in shipped_gmv(t, orders=kept).collect()]
    assert got == [(1, 5, 6)]


def test_the_mixed_sort_is_in_order(spark):
    rows = plans()["mixed_sort"](Tables(spark, SMOKE_DIR)).collect()
    # texts ascending with nulls first, values descending with nulls first
    key = [((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or ""), (r[2] is not None, -(r[2] or 0))) for r in rows]
    assert len(rows) > 1 and key == sorted(key)
