"""Buyer cohorts: adopters of a delivery method (D1) and their first use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastmile.functions.columns import COMPLETED, PLATFORM, in_months
from lastmile.sources.domain import Tables


def adoption_rows(
    t: Tables, month_from: str, month_to: str | None, method: str, fulfilments: DataFrame | None = None
) -> DataFrame:
    """Live completed fulfilments by ``method`` whose status changed in [month_from, month_to),
    with the buyer code and the order creation time.

    The filters reject NULLs of transaction, order and fulfilment, so those joins are inner;
    the buyer store stays a left join (a missing store gives a NULL code, as in the report).
    The city/province joins of the report are never read and are not planned (J19).
    ``fulfilments`` replaces the fulfilment table (e.g. a stream of status changes).
    """
    f = (t.mk_order_fulfilment if fulfilments is None else fulfilments).where(
        in_months("status_updated_at", month_from, month_to)
        & (F.col("status") == F.lit(COMPLETED))
        & (F.col("delivery_method") == F.lit(method))
        & F.col("deleted").isNull()
    ).select(F.col("order_id").alias("f_order_id"))
    o = t.mk_order.where(F.col("deleted").isNull()).select(
        F.col("id").alias("o_id"), "transaction_id", "created_at"
    )
    tr = t.mk_transaction.where(F.col("deleted").isNull()).select(F.col("id").alias("t_id"), "buyer_store_id")
    b = t.mk_store.select(F.col("id").alias("b_id"), "unique_id")
    x = f.join(o, f.f_order_id == o.o_id).join(tr, F.col("transaction_id") == tr.t_id)
    return x.join(b, x.buyer_store_id == b.b_id, "left").select("unique_id", "created_at")


def adopter_cohort(t: Tables, month_from: str, month_to: str | None = None, method: str = PLATFORM) -> DataFrame:
    """Distinct buyer codes with a live completed ``method`` fulfilment in [from, to) (to optional)."""
    return adoption_rows(t, month_from, month_to, method).select("unique_id").distinct()


def first_use_cohort(t: Tables, month_from: str, month_to: str | None = None, method: str = PLATFORM) -> DataFrame:
    """Adopters with their first qualifying order time (``order_date`` = min created_at)."""
    rows = adoption_rows(t, month_from, month_to, method)
    return rows.groupBy("unique_id").agg(F.min("created_at").alias("order_date"))
