"""Stored domain tables: write once (order-keyed tables bucketed by order id), read as ``Tables``.

In production the marketplace and logistics tables exist as tables; the reports should not re-derive
them. ``save_domain`` writes each domain table through the DataFrameWriter, bucketing the tables that
the reports join and aggregate by order id into the same number of buckets (sorted by that key).
``StoredTables`` exposes them under the same attribute names as ``Tables``, so every operator and
report runs on them unchanged. With equal bucket counts, order ⨝ fulfilment ⨝ order-unit GMV and
the per-order aggregates read co-partitioned files and plan no shuffle for those steps. With ``by_month`` they are also
partitioned by the month of the order, so a date window prunes units and lines as well as orders.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.functions.columns import LOCAL_TZ, local_time
from lastmile.sources.domain import Tables

# order-keyed tables and their order key
BUCKET_KEYS = {
    "mk_transaction": "id",
    "mk_payment": "transaction_id",
    "mk_order": "id",
    "mk_order_fulfilment": "order_id",
    "mk_order_unit": "order_id",
    "lg_order": "id",
    "lg_delivery": "order_id",
    "lg_order_line": "order_id",
    "lg_delivery_line": "order_id",
    "lg_provider_order_mappings": "order_id",
}

#: Column that a stored task has besides: the pick-up address of its delivery.
ADDRESS = "delivery_pickup_address_id"
#: Column that a stored pick-up has besides: the ride that serves it.
RIDE = "pickup_ride_id"
# ride-keyed tables and their ride key
RIDE_KEYS = {"lg_ride": "id", "lg_task": "ride_id", "lg_pickup": RIDE}

DOMAIN_TABLES = tuple(n for n in dir(Tables) if n.startswith(("mk_", "lg_")))

#: Partition column of the order-keyed tables: the month of the order, in the reports' local time.
MONTH = "order_month"


def order_months(after: str | dt.datetime | None, before: str | dt.datetime | None) -> tuple[str | None, str | None]:
    """First and last local month of orders created strictly between two UTC times."""

    def month(at: str | dt.datetime | None) -> str | None:
        if at is None:
            return None
        at = dt.datetime.strptime(at, "%Y%m%d") if isinstance(at, str) else at
        return at.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(LOCAL_TZ)).strftime("%Y-%m")

    return month(after), month(before)


def in_order_months(rows: DataFrame, months: tuple[str | None, str | None]) -> DataFrame:
    """The rows of orders of these months. Tables without the partition column stay as they are: it only saves reading."""
    first, last = months
    if MONTH not in rows.columns:
        return rows
    if first is not None:
        rows = rows.where(F.col(MONTH) >= F.lit(first))
    return rows if last is None else rows.where(F.col(MONTH) <= F.lit(last))


def with_order_month(t: Tables, name: str) -> DataFrame:
    """An order-keyed table with the month of its order."""
    if name.startswith("mk_"):
        orders = t.mk_order.select(F.col("id").alias("__of"), F.date_format(local_time("created_at"), "yyyy-MM").alias(MONTH))
    else:
        orders = t.lg_order.select(F.col("id").alias("__of"), F.date_format("delivery_date", "yyyy-MM").alias(MONTH))
    rows = getattr(t, name)
    return rows.join(orders, rows[BUCKET_KEYS[name]] == orders["__of"], "left").drop("__of")


def with_ride_columns(t: Tables, name: str) -> DataFrame:
    """A ride-keyed table with what the manifest link compares: tasks their delivery's address, pick-ups their ride.

    A pick-up that several rides serve has a row for each, one that none serves a row without a ride.
    """
    rows = getattr(t, name)
    if name == "lg_task":
        to = t.lg_delivery.select(F.col("id").alias("__of"), F.col("pickup_address_id").alias(ADDRESS))
        return rows.join(to, F.col("delivery_id") == F.col("__of"), "left").drop("__of")
    if name == "lg_pickup":
        by = t.lg_task.where(F.col("pickup_id").isNotNull()).select(F.col("pickup_id").alias("__of"), F.col("ride_id").alias(RIDE))
        return rows.join(by.distinct(), F.col("id") == F.col("__of"), "left").drop("__of")
    return rows


def save_domain(t: Tables, prefix: str, location: str, buckets: int, names=DOMAIN_TABLES, by_month: bool = False) -> None:
    """Write the domain tables of ``t`` as catalog tables ``<prefix>_<name>`` stored under ``location``.

    ``by_month`` also partitions the order-keyed tables by the month of their order, which is carried into every
    one of them: a report's date window then reads only its months, of units and lines as of orders. Rows are
    dealt by the bucket key first, so a month has one file per bucket. Meant for months of many gigabytes.

    Rides, tasks and pick-ups are bucketed by ride id, so the manifest link joins them where they are.
    """
    for name in names:
        key = BUCKET_KEYS.get(name)
        rows = with_order_month(t, name).repartition(buckets, key) if key and by_month else with_ride_columns(t, name)
        writer = rows.write.mode("overwrite").option("path", f"{location.rstrip('/')}/{name}")
        if key and by_month:
            writer = writer.partitionBy(MONTH)
        key = key or RIDE_KEYS.get(name)
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{prefix}_{name}")


class StoredTables:
    """Domain tables read from the catalog (``spark.table``), with the attribute names of ``Tables``."""

    def __init__(self, spark: SparkSession, prefix: str, star_dir: str | None = None):
        self.spark = spark
        self.prefix = prefix
        self.star = Tables(spark, star_dir).star if star_dir else None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith(("mk_", "lg_")):
            return self.spark.table(f"{self.prefix}_{name}")
        raise AttributeError(name)


def laid_by_order(rows: DataFrame, t: Tables | StoredTables) -> DataFrame:
    """``rows`` in one exchange by their ``order_id``: what joins and sums them by order next finds them there.

    Stored tables lie by order already.
    """
    return rows if isinstance(t, StoredTables) else rows.repartition("order_id")
