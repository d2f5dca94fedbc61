"""Session independence and the size-checked broadcast."""

from pyspark.sql import functions as F

import __spark_entry__ as entry

from conftest import SMOKE_DIR


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_reports_do_not_depend_on_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        utc = {n: _rows(entry.queries()[n](spark, SMOKE_DIR)) for n in ("buyer_orders", "adopter_cohort", "local_day_trunc")}
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        for n, rows in utc.items():
            assert _rows(entry.queries()[n](spark, SMOKE_DIR)) == rows, n
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.catalog.clearCache()
