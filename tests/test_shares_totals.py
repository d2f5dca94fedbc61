"""Exact mean of ratios (D14) and totals of a hot key."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from lastmile.operators.buyers import method_share
from lastmile.operators.joins import partition_total

BUYERS = "province string, total_order long, platform_delivery long, self_pickup long, store_courier long"


def rounded(mean, digits):
    return (2 * 10**digits * mean + 1) // 2 / 10**digits * 100


def test_mean_of_ratios_is_that_of_fractions(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["p", "q", None]), n, rnd.randrange(2 * n), rnd.randrange(n + 1), rnd.randrange(5)) for n in (rnd.randrange(1, 40) for _ in range(3000))]
    # exact ties at four digits: 27/32 = 0.84375
    rows += [("tie", 32, 27, 0, 1)] * 7 + [("thirds", 3, 1, 1, 2), ("thirds", 6, 1, 1, 5), ("thirds", 7, 0, 3, 7)]
    for exact_int in (False, True):
        want = defaultdict(list)
        for province, n, *tops in rows:
            want[province].append([Fraction(k // n if exact_int else Fraction(k, n)) for k in tops])
        for digits in (2, 4):
            got = {r["province"]: r for r in method_share(spark.createDataFrame(rows, BUYERS), "province", digits, exact_int).collect()}
            assert set(got) == set(want)
            for province, ratios in want.items():
                for k, name in enumerate(("platform_delivery", "self_pickup", "store_courier")):
                    mean = sum(r[k] for r in ratios) / len(ratios)
                    assert got[province][f"{name}_share_pct"] == float(rounded(mean, digits)), (province, name)


def test_a_hot_key_is_spread_and_totals_stay_exact(spark):
    rows = [(None if k % 3 == 1 else "hot" if k % 3 == 0 else f"m{k % 500}", k) for k in range(6000)]
    df = spark.createDataFrame(rows, "manifest string, amount long").repartition(8)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(keep, ("false", "-1", "8"), strict=True):
            spark.conf.set(key, value)
        for window, aggregate in [(partition_total(df, ["manifest"], "amount", "total", method=m) for m in ("window", "aggregate"))]:
            assert sorted(map(str, aggregate.collect())) == sorted(map(str, window.collect()))
        tasks = partition_total(df, ["manifest"], "amount", "total").groupBy("manifest", F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in keep.items():
            spark.conf.set(key, value)
    per_key = Counter(r["manifest"] for r in tasks)
    assert per_key["hot"] == 8 and per_key[None] == 8
    assert max(r["count"] for r in tasks if r["manifest"] == "hot") < 2000 / 4
    assert all(n == 1 for key, n in per_key.items() if key not in ("hot", None))


def test_heavy_keys_whose_values_are_all_null(spark):
    df = spark.createDataFrame([("a", None)] * 50 + [("b", 1)] * 50, "manifest string, amount long")
    got = Counter(map(tuple, partition_total(df, ["manifest"], "amount", "total").collect()))
    assert got == {("a", None, None): 50, ("b", 1, 50): 50}
