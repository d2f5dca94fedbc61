"""Rows of some ids out of a table with large rows, without a shuffle of the rows that are not meant.

The ids are marked in a bitmap of fixed size, which is broadcast: 2**27 bits, 16 MB at most, however many ids there
are. A row whose bit is not set is surely not meant and never leaves its task; the others are joined with the
ids, so the result is exact. With more ids than bits nearly every row is joined, as it would be without a bitmap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
IN_ONE = 1 << 15  # bits of one row of the bitmap, as Spark builds it


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def marked(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether the id may be one of ``ids`` (its first column); null ids are none."""
    place = _place(F.col(ids.columns[0]).cast("long"))
    bitmaps = ids.select(place.alias("place")).groupBy(F.floor(F.col("place") / IN_ONE).alias(f"{name}_of"))
    bitmaps = bitmaps.agg(F.bitmap_construct_agg(F.col("place") % IN_ONE).alias(f"{name}_bits"))
    own = _place(F.col(key).cast("long"))
    joined = rows.withColumn(f"{name}_at", own).withColumn(f"{name}_of", F.floor(F.col(f"{name}_at") / IN_ONE))
    joined = joined.join(F.broadcast(bitmaps), f"{name}_of", "left")
    byte = f"CAST(conv(hex(substring({name}_bits, CAST({name}_at % {IN_ONE} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    value = F.expr(f"coalesce((shiftright({byte}, CAST({name}_at % 8 AS INT)) & 1) = 1, false)")
    quoted = [f"`{c.replace('`', '``')}`" for c in rows.columns]  # a name may hold a dot
    return joined.select(*quoted, value.alias(name))


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (a table of one column)."""
    name = f"x{uuid.uuid4().hex}"
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias(f"{name}_id"))
    some = marked(rows, ids, key, name).where(name).drop(name)
    return some.join(wanted, F.col(key).cast("long") == F.col(f"{name}_id"), "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not among ``ids``, rows without a key among them."""
    name = f"x{uuid.uuid4().hex}"
    wanted = ids.select(F.col(ids.columns[0]).cast("long").alias(f"{name}_id"))
    all_rows = marked(rows, ids, key, name)
    maybe = all_rows.where(name).drop(name)
    rest = maybe.join(wanted, F.col(key).cast("long") == F.col(f"{name}_id"), "left_anti")
    return all_rows.where(~F.col(name)).drop(name).unionByName(rest)
