"""Readers for the star-schema parquet tables (TPC-H-like) the domain tables are derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Schema comes from the file footer; column pruning and predicate
    pushdown reach the scan because every consumer selects/filters declaratively."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Star:
    """Lazy accessor: ``Star(spark, dir).lineitem`` reads on first use and keeps the DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in STAR_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]
