"""Adopter cohorts maintained incrementally from a stream of fulfilment status changes.

The batch cohorts (D1, D2) re-read every fulfilment. Here the same filters run on each micro-batch
of new fulfilment rows; order, transaction and buyer store are stream-static joins against the
current tables. The cohort state — one row per buyer code — lives in the state store, hash
partitioned by buyer across executors, so it grows with the number of buyers, not with the stream.
Streams restart from their checkpoint, kept under the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lastmile.functions.columns import PLATFORM
from lastmile.operators.cohorts import adoption_rows
from lastmile.session import checkpoint_dir
from lastmile.sources.domain import Tables

FULFILMENT_SCHEMA = "order_id bigint, status string, delivery_method string, status_updated_at timestamp_ntz, deleted timestamp_ntz"


def read_fulfilment_changes(spark, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of fulfilment rows arriving as parquet files under ``path`` (explicit schema)."""
    reader = spark.readStream.schema(FULFILMENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def adopter_stream(
    changes: DataFrame, t: Tables, month_from: str, month_to: str | None = None, method: str = PLATFORM
) -> DataFrame:
    """D1 on a stream: each buyer code is emitted once, the first time it qualifies (append mode)."""
    rows = adoption_rows(t, month_from, month_to, method, fulfilments=changes)
    return rows.select("unique_id").dropDuplicates(["unique_id"])


def first_use_stream(
    changes: DataFrame, t: Tables, month_from: str, month_to: str | None = None, method: str = PLATFORM
) -> DataFrame:
    """D2 on a stream: per buyer the earliest qualifying order time so far (update/complete mode)."""
    rows = adoption_rows(t, month_from, month_to, method, fulfilments=changes)
    return rows.groupBy("unique_id").agg(F.min("created_at").alias("order_date"))


def start(
    df: DataFrame, name: str, output_mode: str, sink: str, path: str | None = None,
    checkpoint_location: str | None = None,
) -> StreamingQuery:
    """Start ``df``; its checkpoint goes to ``checkpoint_location`` or, by default, under the
    session's shared checkpoint folder (``<spark.checkpoint.dir>/streams/<name>``)."""
    location = checkpoint_location or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    writer = df.writeStream.queryName(name).outputMode(output_mode).option("checkpointLocation", location)
    writer = writer.format(sink)
    return writer.start(path) if path else writer.start()
