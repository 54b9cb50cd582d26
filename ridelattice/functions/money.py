"""Fares and discounts: every step rounds half up to two decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
BASE_FARE = Decimal("50.00")
PER_KM = Decimal("8")
PER_MINUTE = Decimal("0.5")
PER_WAIT_MINUTE = Decimal("1")
FREE_KM = Decimal("1")
FREE_WAIT_MINUTES = Decimal("5")
SURGE_LOW, SURGE_HIGH = Decimal("1"), Decimal("3")
TAX_RATE = Decimal("0.05")
WINDING_FACTOR = 1.25
SHORT_TRIP_KM, SHORT_TRIP_AS_KM = 0.1, 0.5
CITY_SPEED_KMH = 35.0
MIN_MINUTES = 5.0

MONEY = "decimal(12,2)"


def money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def _above(c: Column, free: Decimal) -> Column:
    return F.greatest(c - F.lit(free), F.lit(Decimal("0")))


def with_fare(df: DataFrame, km: Column, minutes: Column, wait: Column, surge: Column, discount: Column) -> DataFrame:
    """Add the fare breakdown columns."""
    zero = F.lit(Decimal("0"))
    df = df.withColumns({
        "distance_fare": money(_above(F.greatest(km, zero), FREE_KM) * F.lit(PER_KM)),
        "time_fare": money(F.greatest(minutes, zero) * F.lit(PER_MINUTE)),
        "wait_fare": money(_above(F.greatest(wait, zero), FREE_WAIT_MINUTES) * F.lit(PER_WAIT_MINUTE)),
        "_surge": F.least(F.greatest(surge, F.lit(SURGE_LOW)), F.lit(SURGE_HIGH)),
        "_discount": F.greatest(discount, zero),
    })
    df = df.withColumn("subtotal", money(F.lit(BASE_FARE) + F.col("distance_fare") + F.col("time_fare") + F.col("wait_fare")))
    df = df.withColumn("surged", money(F.col("subtotal") * F.col("_surge")))
    df = df.withColumn("tax", money(F.col("surged") * F.lit(TAX_RATE)))
    total = money(money(F.col("surged") + F.col("tax")) - F.col("_discount"))
    return df.withColumn("total", F.greatest(total, zero).cast(MONEY)).drop("_surge", "_discount")


def estimated_trip(direct_km: Column) -> tuple[Column, Column]:
    """Road distance and minutes guessed from the straight line."""
    km = F.when(direct_km > SHORT_TRIP_KM, direct_km * WINDING_FACTOR).otherwise(SHORT_TRIP_AS_KM)
    return km, F.greatest(F.lit(MIN_MINUTES), km / CITY_SPEED_KMH * 60.0)
