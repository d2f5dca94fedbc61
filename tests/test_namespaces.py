"""Unqualified names in the current namespace."""

from conftest import SMOKE_DIR
from lastmile.sources import namespaces as N


def test_one_name_is_another_table_in_another_namespace(spark):
    N.publish(spark, SMOKE_DIR)
    before = spark.catalog.currentDatabase()
    text = "SELECT * FROM `order`"
    market, fleet = N.resolve(spark, N.MARKET, text), N.resolve(spark, N.FLEET, text)
    assert "created_at" in market.columns and "delivery_date" not in market.columns
    assert "delivery_date" in fleet.columns and "created_at" not in fleet.columns
    assert spark.catalog.currentDatabase() == before
    assert market.count() == fleet.count() > 0


def test_the_namespace_is_restored_after_an_error(spark):
    before = spark.catalog.currentDatabase()
    try:
        N.resolve(spark, N.MARKET, "SELECT * FROM no_such_table")
        raise AssertionError
    except Exception as error:  # noqa: BLE001
        assert "no_such_table" in str(error)
    assert spark.catalog.currentDatabase() == before


def test_a_user_table_of_the_current_namespace_hides_nothing_else(spark):
    N.publish(spark, SMOKE_DIR)
    with N.current(spark, N.FLEET):
        assert spark.catalog.tableExists("delivery_address") and not spark.catalog.tableExists("store")
