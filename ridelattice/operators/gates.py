"""Hard eligibility rules, the weighted index, and their explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, weights and reason texts that define the results.
LIMITS = {"pickup_km": 2.0, "dest_km": 3.0, "detour_km": 5.0, "dep_diff_min": 30.0}
WEIGHTS = {
    "pickup_km": 0.25, "dest_km": 0.20, "route_sim": 0.25,
    "direction_sim": 0.10, "detour_km": 0.10, "dep_diff_min": 0.10,
}
REASONS = (
    ("ok_direction", "direction incompatibility"),
    ("ok_pickup", "pickup distance exceeds 2 km"),
    ("ok_dest", "destination distance exceeds 3 km"),
    ("ok_departure", "departure difference exceeds 30 minutes"),
    ("ok_detour", "detour exceeds 5 km"),
    ("ok_identity", "identity verification failed"),
    ("ok_vehicle", "vehicle verification failed"),
    ("ok_capacity", "insufficient vehicle capacity"),
    ("ok_safety", "safety flags present"),
)
INDEX_THRESHOLD = 50.0


def with_gates(features: DataFrame) -> DataFrame:
    """Nine boolean gate columns, ``eligible`` and the ordered ``reasons`` array."""
    c = F.col
    gated = features.withColumns({
        "ok_direction": c("direction_sim") > 0.5,
        "ok_pickup": c("pickup_km") <= LIMITS["pickup_km"],
        "ok_dest": c("dest_km") <= LIMITS["dest_km"],
        "ok_departure": c("dep_diff_min") <= LIMITS["dep_diff_min"],
        "ok_detour": c("detour_km") <= LIMITS["detour_km"],
        "ok_identity": c("v_identity_ok") & c("r_identity_ok"),
        "ok_vehicle": c("v_vehicle_ok"),
        "ok_capacity": c("v_capacity") >= c("r_seats"),
        "ok_safety": ~c("v_safety_flag"),
    })
    failed = F.array(*[F.when(~c(flag), F.lit(text)) for flag, text in REASONS])
    gated = gated.withColumn("reasons", F.array_compact(failed))
    return gated.withColumn("eligible", F.size("reasons") == 0)


def two_decimals(x: Column) -> Column:
    """Round a score to two decimals; ties are decided on eight, so floating noise cannot flip them."""
    return F.round(F.round(x, 8), 2)


def normalised(feature: str) -> Column:
    """1 at distance zero, 0 at the limit; similarities pass through."""
    if feature in LIMITS:
        return F.greatest(F.lit(0.0), 1.0 - F.col(feature) / LIMITS[feature])
    return F.col(feature)


def raw_index(weights: dict[str, float] | None = None) -> Column:
    """Weighted 0-100 index, unrounded."""
    total: Column | None = None
    for name, w in (weights or WEIGHTS).items():
        part = F.lit(100.0) * w * normalised(name)
        total = part if total is None else total + part
    return total


def with_score(features: DataFrame) -> DataFrame:
    return features.withColumn("score", two_decimals(raw_index()))


def with_legacy_compatibility(gated: DataFrame) -> DataFrame:
    """Older rule: an index below 50 also rejects, and a rejected pair scores 0."""
    ok = F.col("eligible") & (raw_index() >= INDEX_THRESHOLD)
    return gated.withColumn("compatible", ok).withColumn("legacy_score", F.when(ok, two_decimals(raw_index())).otherwise(0.0))


def explanations(gated: DataFrame) -> DataFrame:
    """Long table: one row per pair and feature with its value and contribution."""
    parts = F.array(*[
        F.struct(
            F.lit(name).alias("feature"), F.col(name).alias("value"),
            (F.lit(100.0) * w * normalised(name)).alias("contribution"),
        )
        for name, w in WEIGHTS.items()
    ])
    return gated.select("driver_id", "rider_id", "eligible", F.inline(parts))


def reason_histogram(gated: DataFrame) -> DataFrame:
    """Pairs per reason: the failed gates are counted as they are, without a row or a text per failure."""
    counts = gated.agg(*[F.count_if(~F.col(flag)).alias(flag) for flag, _ in REASONS])
    rows = F.array(*[F.struct(F.lit(text).alias("reason"), F.col(flag).alias("pairs")) for flag, text in REASONS])
    return counts.select(F.inline(rows)).filter("pairs > 0")


def pipeline_counts(gated: DataFrame) -> DataFrame:
    """Retrieved, eligible, eligible share, per market."""
    return gated.groupBy(F.col("r_city").alias("city")).agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.count_if("eligible").alias("eligible"),
        F.round(F.count_if("eligible") / F.count(F.lit(1)), 6).alias("coverage"),
    )
