"""Domain tables by unqualified name (S2): two catalog namespaces with a current one, as a search path has it.

Marketplace and logistics both have a table ``order``. ``publish`` defines the tables of each system as views of a
namespace of its own, without the prefix that tells them apart elsewhere. ``resolve`` looks names up in
the current namespace, so the same text reads another system's table after the namespace is changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MARKET, FLEET = "marketplace", "logistics"

#: Tables of each namespace over the star tables; FIXTURES.md has the derivations.
VIEWS = {
    MARKET: {
        "order": "SELECT o_orderkey AS id, o_orderkey AS transaction_id, o_orderdate AS created_at FROM {orders}",
        "transaction": "SELECT o_orderkey AS id, o_custkey AS buyer_store_id FROM {orders}",
        "store": "SELECT c_custkey AS id, c_name AS unique_id FROM {customer}",
    },
    FLEET: {
        "order": "SELECT o_orderkey AS id, o_orderdate AS delivery_date, o_orderpriority AS priority, o_custkey AS delivery_address_id FROM {orders}",
        "delivery_address": "SELECT c_custkey AS id, c_name AS buyer_code FROM {customer}",
    },
}


def publish(spark: SparkSession, sf_dir: str) -> None:
    """Define both namespaces over the star tables of one folder."""
    folder = sf_dir.rstrip("/")
    for namespace, views in VIEWS.items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`")
        for name, text in views.items():
            body = text.format(orders=f"parquet.`{folder}/orders.parquet`", customer=f"parquet.`{folder}/customer.parquet`")
            spark.sql(f"CREATE OR REPLACE VIEW `{namespace}`.`{name}` AS {body}")


@contextmanager
def current(spark: SparkSession, namespace: str) -> Iterator[None]:
    """Make ``namespace`` the current one for a while."""
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(namespace)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)


def resolve(spark: SparkSession, namespace: str, text: str) -> DataFrame:
    """A query whose table names are looked up in ``namespace``. They are bound at once, not when it runs."""
    with current(spark, namespace):
        return spark.sql(text)
