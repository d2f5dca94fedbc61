"""SparkSession settings used by the library, tests and the bench.

On a cluster the session is created by the platform; ``configure`` only fills in settings that are
still unset, so cluster values (shuffle partitions, checkpoint dir, broadcast threshold) win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this library relies on. AQE re-plans joins from runtime sizes (so a
# derived side is broadcast only after its measured size is under the threshold), coalesces small
# shuffle partitions and splits skewed join partitions (one buyer, manifest or province may hold
# a third of all rows). Timestamps in the tables are UTC wall-clock ``timestamp_ntz`` values.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # rows that lie by order id are joined there on (order, line), not dealt out again by both keys
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply library defaults where the session does not already set a value."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, local_fallback: bool = False) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir`` or the context's).

    The library never invents one on a cluster: without a configured folder this raises, unless a
    local caller (tests, the bench, local tools) asks for ``local_fallback``, which registers a
    scratch folder for that local session.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not local_fallback:
            raise RuntimeError("no checkpoint folder: set spark.checkpoint.dir to a shared location")
        named = tempfile.mkdtemp(prefix="lastmile-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def reuse(df: DataFrame) -> DataFrame:
    """Keep an intermediate that is read more than once (a roll-up feeding a threshold and a join).

    With a checkpoint folder set on the session (the cluster's shared ``spark.checkpoint.dir``,
    or one registered for tests), the intermediate is checkpointed there: its lineage is cut, so a
    lost executor costs a re-read, not a recomputation of the whole fact. Without one it is
    persisted (memory and disk; lineage kept for recovery).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def get_session(master: str | None = None, partitions: int | None = None, app: str = "lastmile") -> SparkSession:
    """Local/test session builder. On a cluster use the existing session and ``configure`` it."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or int(cpus)))
        .config("spark.driver.memory", os.environ.get("LASTMILE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        # local runs only: remove checkpoint files once their DataFrames are garbage
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
