"""Write a scaled (and optionally skewed) copy of a star directory for local scale experiments.

Usage: python tools/make_scaled.py SRC_DIR OUT_DIR COPIES [--skew]

Each copy is an independent market: order, customer, part and supplier keys are offset per copy and
names get a copy suffix (nation and region are shared). ``--skew`` then gives one buyer a third of
all orders and one supplier a third of all order lines. Output is split into several files per
table so scans run in parallel. Only for experiments; the library never writes data.
"""

from __future__ import annotations

import os
import sys
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def main(argv: list[str]) -> None:
    src, out, copies = argv[1], argv[2], int(argv[3])
    skew = "--skew" in argv
    from lastmile.session import get_session

    spark = get_session()
    r = lambda t: spark.read.parquet(f"{src}/{t}.parquet")
    span = {k: r(t).agg(F.max(k)).first()[0] + 1 for t, k in
            (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))}

    def copies_of(table, fn):
        return reduce(lambda a, b: a.unionByName(b), [fn(r(table), i) for i in range(copies)])

    def suffix(c, i):
        return F.concat(F.col(c), F.lit(f"~{i}"))

    tables = {
        "region": r("region"),
        "nation": r("nation"),
        "events": r("events"),
        "customer": copies_of("customer", lambda d, i: d.withColumn("c_custkey", F.col("c_custkey") + i * span["c_custkey"])
                              .withColumn("c_name", suffix("c_name", i))),
        "supplier": copies_of("supplier", lambda d, i: d.withColumn("s_suppkey", F.col("s_suppkey") + i * span["s_suppkey"])
                              .withColumn("s_name", suffix("s_name", i))),
        "part": copies_of("part", lambda d, i: d.withColumn("p_partkey", F.col("p_partkey") + i * span["p_partkey"])),
        "orders": copies_of("orders", lambda d, i: d.withColumn("o_orderkey", F.col("o_orderkey") + i * span["o_orderkey"])
                            .withColumn("o_custkey", F.col("o_custkey") + i * span["c_custkey"])),
        "lineitem": copies_of("lineitem", lambda d, i: d.withColumn("l_orderkey", F.col("l_orderkey") + i * span["o_orderkey"])
                              .withColumn("l_partkey", F.col("l_partkey") + i * span["p_partkey"])
                              .withColumn("l_suppkey", F.col("l_suppkey") + i * span["s_suppkey"])),
    }
    if skew:
        tables["orders"] = tables["orders"].withColumn(
            "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")))
        tables["lineitem"] = tables["lineitem"].withColumn(
            "l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey")))
    for name, df in tables.items():
        parts = 16 if name in ("lineitem", "orders") else 4
        df.repartition(parts).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        print(name, spark.read.parquet(f"{out}/{name}.parquet").count(), flush=True)


if __name__ == "__main__":
    main(sys.argv)
