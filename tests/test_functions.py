"""Column expressions: payment family, channel, COD fee, flags, local time, month ranges."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from lastmile.functions import columns as C


def test_payment_bucket_like_semantics(spark):
    df = spark.createDataFrame(
        [("BANK_TRANSFER",), ("BANK_TRANSFER_A",), ("BANKXTRANSFER",), ("VIRTUAL_ACCOUNT_9",), ("CARD",), (None,)],
        "t string",
    )
    out = [r[0] for r in df.select(C.payment_bucket("t")).collect()]
    # '_' is a one-character wildcard: BANKXTRANSFER is a bank transfer too
    assert out == ["BANK_TRANSFER", "BANK_TRANSFER", "BANK_TRANSFER", "VIRTUAL_ACCOUNT", "CARD", None]


def test_acquisition_channel(spark):
    df = spark.createDataFrame([("ONLINE",), ("RETAIL",), (None,)], "g string")
    assert [r[0] for r in df.select(C.acquisition_channel("g")).collect()] == ["ONLINE", "OFFLINE", "OFFLINE"]


def test_cod_fee_case_insensitive(spark):
    df = spark.createDataFrame(
        [("COD", Decimal("1000.00")), ("cod", Decimal("5.50")), ("PREPAID", Decimal("7.00")), (None, Decimal("1.00"))],
        "p string, fee decimal(18,2)",
    )
    got = [r[0] for r in df.select(C.cod_fee("p", "fee")).collect()]
    assert got == [Decimal("1000.00"), Decimal("5.50"), Decimal("0.00"), Decimal("0.00")]


def test_cod_tax_split_is_unrounded(spark):
    df = spark.createDataFrame([(Decimal("1000.00"),), (Decimal("0.00"),)], "fee decimal(18,2)")
    base, vat = C.cod_tax_split("fee")
    assert [(float(a), float(b)) for a, b in df.select(base, vat).collect()] == [(10000 / 11, 1000 / 11), (0.0, 0.0)]


def test_is_false_excludes_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in df.select(C.is_false("b")).collect()] == [False, True, False]


def test_region_side_fixed_names_and_unknown(spark):
    df = spark.createDataFrame([("Bali Nusra",), ("SUMATERA",), ("jawa barat",), ("elsewhere",), (None,)], "r string")
    assert [r[0] for r in df.select(C.region_side("r")).collect()] == ["East", "West", "West", None, None]


def test_local_month_crosses_month_edge(spark):
    # 17:00 UTC on the last day of January is already February in UTC+7
    df = spark.createDataFrame([(dt.datetime(2021, 1, 31, 17, 0),), (dt.datetime(2021, 1, 31, 16, 59),)], "ts timestamp_ntz")
    got = df.select(C.local_month("ts").alias("m"), C.local_day("ts").alias("d")).collect()
    assert got[0]["m"] == dt.datetime(2021, 2, 1) and got[0]["d"] == dt.date(2021, 2, 1)
    assert got[1]["m"] == dt.datetime(2021, 1, 1) and got[1]["d"] == dt.date(2021, 1, 31)
    assert dict(df.select(C.local_month("ts")).dtypes)[df.select(C.local_month("ts")).columns[0]] == "timestamp_ntz"


def test_month_range_matches_text_prefix(spark):
    edges = [
        dt.datetime(2021, 1, 31, 23, 59, 59, 999999),
        dt.datetime(2021, 2, 1, 0, 0),
        dt.datetime(2021, 2, 28, 23, 59, 59, 999999),
        dt.datetime(2021, 3, 1, 0, 0),
    ]
    df = spark.createDataFrame([(e,) for e in edges], "ts timestamp_ntz")
    by_range = [r[0] for r in df.select(C.in_months("ts", "2021-02", "2021-03")).collect()]
    text = F.date_format("ts", "yyyy-MM")
    by_text = [r[0] for r in df.select((text >= "2021-02") & (text < "2021-03")).collect()]
    assert by_range == by_text == [False, True, True, False]


def test_ratio_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(3, 0), (3, 2)], "a long, b long")
    assert [r[0] for r in df.select(C.ratio("a", "b")).collect()] == [None, 1.5]


def test_compact_date_literal(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 2, 1),), (dt.datetime(2021, 2, 2),)], "ts timestamp_ntz")
    # created_at > '20210201' excludes the first instant of the day
    assert [r[0] for r in df.select(F.col("ts") > C.ts_literal("20210201")).collect()] == [False, True]
