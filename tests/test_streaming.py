"""Streaming cohorts equal the batch cohorts once the stream has seen every fulfilment."""

import tempfile

from pyspark.sql import functions as F

from lastmile.operators import cohorts as CO
from lastmile.sources.domain import Tables
from lastmile.streaming import adopter_stream, first_use_stream, read_fulfilment_changes, start

from conftest import SMOKE_DIR


def test_stream_cohorts_match_batch(spark):
    t = Tables(spark, SMOKE_DIR)
    src = tempfile.mkdtemp(prefix="lastmile-stream-src-")
    f = t.mk_order_fulfilment
    # three arrival batches of status changes
    for part in range(3):
        f.where(F.col("order_id") % 3 == part).write.mode("append").parquet(src)
    changes = read_fulfilment_changes(spark, src, files_per_trigger=2)

    q1 = start(adopter_stream(changes, t, "1997-01", "1998-01"), "adopters_test", "append", "memory")
    q2 = start(first_use_stream(changes, t, "1997-01", "1998-01"), "first_use_test", "complete", "memory")
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
        streamed = sorted(r[0] for r in spark.table("adopters_test").collect())
        batch = sorted(r[0] for r in CO.adopter_cohort(t, "1997-01", "1998-01").collect())
        assert streamed == batch and batch
        fu_s = {r["unique_id"]: r["order_date"] for r in spark.table("first_use_test").collect()}
        fu_b = {r["unique_id"]: r["order_date"] for r in CO.first_use_cohort(t, "1997-01", "1998-01").collect()}
        assert fu_s == fu_b
    finally:
        q1.stop()
        q2.stop()
