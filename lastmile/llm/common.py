"""Helpers shared by the training-data operators.

Words, everywhere in this package, are the maximal runs of characters other than space and
U+0009–U+000D (``[^\\x20\\x09-\\x0D]+``). In Python tasks ``bytes.split()`` cuts UTF-8 text at
exactly those characters; in Spark expressions ``words`` does.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.session import checkpoint_dir
from lastmile.sources.star import read_table

SPACES = " \t\n\x0b\f\r"
FEW = 50_000  # rows of a few longs, or of packed bits, that a join broadcasts
ROWS_A_FILE = 20_000  # of a few longs, or of packed bits, that a checkpoint puts into one file
SPACE_RUN = r"[\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
AT_ONCE = 500  # texts that a Python task holds and works on at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a scratch folder only for an unconfigured local session."""
    # a local cluster's executors do not share the driver's scratch folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and not (
        spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    ):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lastmile-ckpt-"))
    return checkpoint_dir(spark)


def of_size(df: DataFrame, rows: int, each: int = ROWS_A_FILE) -> DataFrame:
    """``df``, which has some ``rows`` rows, in no more partitions than take ``each`` rows."""
    return df.coalesce(max(1, -(-rows // each)))


def cut(df: DataFrame, rows: int | None = None, each: int = ROWS_A_FILE) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: later jobs read files there, whatever executor is lost.

    Where ``rows``, how many there are at most or nearly so, is known, no more files are written than take ``each`` rows. Otherwise
    every partition makes one, however few rows it has, and for every file an executor asks something of the file
    system, a local one by a process of its own (``chmod``, until it runs a second image of the executor).
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else of_size(df, rows, each)).checkpoint(eager=True)


def if_few(df: DataFrame) -> DataFrame:
    """``df``, a frame that ``cut`` returned, to be broadcast in a join if it has few rows: a checkpoint has no size that Spark knows."""
    return F.broadcast(df) if df.count() <= FEW else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: as ``cut``, compressed and read by column."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for rows with texts: ``work`` gets ``AT_ONCE`` rows at a time, however large Spark's batches are.

    Where the session names no batch size, Spark's are made as small, so that neither side of the pipe holds thousands of texts.
    """
    if df.sparkSession.conf.get(BATCH_ROWS, None) is None:
        df.sparkSession.conf.set(BATCH_ROWS, str(AT_ONCE))
    most = AT_ONCE

    def of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(whole.slice(k, most) for whole in batches for k in range(0, len(whole), most))

    return df.mapInArrow(of_few, schema)


def held_name(name: str) -> str:
    """The name that ``held`` gives a column."""
    return f"of{name}"


def held(docs: DataFrame) -> DataFrame:
    """``docs`` with every column renamed, so that no name begins with an underscore: those are free for temporaries."""
    return docs.toDF(*[held_name(c) for c in docs.columns])


def given_back(rows: DataFrame, names: list[str], *more: str | Column) -> DataFrame:
    """The columns ``names`` of a frame made from ``held`` under their own names again, and ``more``."""
    return rows.select(*[F.col(f"`{held_name(c)}`").alias(c) for c in names], *more)


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    body = trimmed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def bucket_of(key: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal ranges of the 64-bit hash space ``key`` (a hash) lies in.

    Ranges of a uniform hash need no sampling, so range partitioning by them is the same on every
    run and splits a hot source or shard as evenly as any other.
    """
    bits = buckets.bit_length() - 1
    if 1 << bits != buckets:
        raise ValueError("buckets must be a power of two")
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
