"""Column -> Column business expressions. All are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Acquisition channel: the fee group named ONLINE, everything else (and no fee group) OFFLINE.
ONLINE = "ONLINE"
OFFLINE = "OFFLINE"
# Payment families: detail types matched by LIKE pattern (underscore is a one-character wildcard).
PAYMENT_FAMILIES = [("BANK_TRANSFER%", "BANK_TRANSFER"), ("VIRTUAL_ACCOUNT%", "VIRTUAL_ACCOUNT")]
# Region side of the logistics regions (lower-cased region name -> side).
REGION_SIDES = {
    "bali nusra": "East",
    "jabodetabek 1": "West",
    "jabodetabek 2": "West",
    "jawa barat": "West",
    "jawa tengah": "East",
    "jawa timur": "East",
    "kalimantan": "East",
    "sulawesi papua": "East",
    "sumatera": "West",
}
# Tax split of the COD fee: fee includes 10% VAT.
VAT_RATE = "0.1"
VAT_DIVISOR = "1.1"
# Delivery methods and statuses.
PLATFORM = "PLATFORM"  # the marketplace's own delivery fleet
SELF_PICKUP = "SELF_PICKUP"
STORE_COURIER = "STORE_COURIER"
COMPLETED = "COMPLETED"
LOCAL_TZ = "Asia/Jakarta"
# ---------------------------------------------------------------------------------------------

# Region names of the star fixture (the logistics regions are the five TPC-H regions there).
STAR_REGION_SIDES = {"africa": "East", "america": "West", "asia": "East", "europe": "West"}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def acquisition_channel(fee_group_name: str | Column) -> Column:
    """ONLINE when the buyer's fee group is ONLINE, else OFFLINE (NULL -> OFFLINE)."""
    c = _c(fee_group_name)
    return F.when(c == F.lit(ONLINE), c).otherwise(F.lit(OFFLINE))


def payment_bucket(detail_type: str | Column) -> Column:
    """Collapse payment detail types to their family by LIKE prefix; others pass through."""
    c = _c(detail_type)
    expr = None
    for pattern, family in PAYMENT_FAMILIES:
        cond = c.like(pattern)
        expr = F.when(cond, F.lit(family)) if expr is None else expr.when(cond, F.lit(family))
    return expr.otherwise(c)


def region_side(region_name: str | Column, sides: dict[str, str] | None = None) -> Column:
    """East/West side of a region, by lower-cased name; unknown names give NULL (no ELSE)."""
    c = F.lower(_c(region_name))
    expr = None
    for name, side in (sides or REGION_SIDES).items():
        cond = c == F.lit(name)
        expr = F.when(cond, F.lit(side)) if expr is None else expr.when(cond, F.lit(side))
    return expr


def is_cod(payment_type: str | Column) -> Column:
    """Case-insensitive COD test."""
    return F.lower(_c(payment_type)) == F.lit("cod")


def cod_fee(payment_type: str | Column, fee: str | Column) -> Column:
    """The delivery fee when the order is paid cash on delivery, otherwise 0."""
    return F.when(is_cod(payment_type), _c(fee)).otherwise(F.lit(0))


def cod_tax_split(fee: str | Column) -> tuple[Column, Column]:
    """M1: (tax base, VAT) of a VAT-inclusive fee: base = fee / 1.1, VAT = base * 0.1, as decimals
    of fifteen places or more, not rounded to cents."""
    base = _c(fee).cast("decimal(30,12)") / F.lit(VAT_DIVISOR).cast("decimal(2,1)")
    return base, base * F.lit(VAT_RATE).cast("decimal(2,1)")


def local_time(ts: str | Column, tz: str = LOCAL_TZ) -> Column:
    """UTC wall-clock ``timestamp_ntz`` -> local wall clock in ``tz`` (stays timestamp_ntz)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def local_month(ts: str | Column, tz: str = LOCAL_TZ) -> Column:
    """X1+X2: first instant of the local month, as timestamp_ntz."""
    return F.trunc(F.to_date(local_time(ts, tz)), "month").cast("timestamp_ntz")


def local_day(ts: str | Column, tz: str = LOCAL_TZ) -> Column:
    """X2+X3: local calendar day."""
    return F.to_date(local_time(ts, tz))


def month_start(month: str) -> dt.datetime:
    """'YYYY-MM' -> first instant of that month."""
    y, m = (int(p) for p in month.split("-")[:2])
    return dt.datetime(y, m, 1)


def in_months(ts: str | Column, month_from: str, month_to: str | None = None) -> Column:
    """``CAST(ts AS char(7)) >= from [AND < to]`` as a sargable timestamp range.

    A 'YYYY-MM' text prefix is >= '2021-02' exactly when ts >= 2021-02-01 00:00, and < '2021-03'
    exactly when ts < 2021-03-01 00:00, so the range selects the same rows and reaches the scan.
    """
    c = _c(ts)
    cond = c >= ts_literal(month_start(month_from))
    if month_to is not None:
        cond = cond & (c < ts_literal(month_start(month_to)))
    return cond


def ts_literal(value: str | dt.date | dt.datetime) -> Column:
    """X6: 'YYYYMMDD' / date / datetime -> timestamp_ntz literal (compact text is parsed, not compared)."""
    if isinstance(value, str):
        value = dt.datetime.strptime(value, "%Y%m%d")
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    # from text: a Python datetime literal would pass through the process and session time zones
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_literal(value: str | dt.date) -> Column:
    if isinstance(value, str):
        value = dt.datetime.strptime(value, "%Y%m%d").date()
    return F.lit(value)


def is_false(flag: str | Column) -> Column:
    """P10: ``flag IS FALSE`` — true only for false, never for NULL."""
    return _c(flag).eqNullSafe(F.lit(False))


def true_flag_text(cond: Column) -> Column:
    """The text flags 'True'/'False' (strings, not booleans)."""
    return F.when(cond, F.lit("True")).otherwise(F.lit("False"))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """``a / b::float`` as a double division; a zero denominator gives NULL."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def tenth_bucket(pct_rank: str | Column) -> Column:
    """floor(percent_rank * 10) — the integer decile bucket (9 <=> 0.9 in the reports)."""
    return F.floor(_c(pct_rank) * F.lit(10))
