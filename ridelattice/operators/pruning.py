"""Two-tier matching: cheap geometric pruners, then road-cost gates and scores.

A pruner is a function returning a boolean Column over pairs with ``pickup_km``,
``dest_km``, ``shared_km`` (straight lines), ``dep_diff_min``, ``geo_detour_km``
and ``driver_road_km``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.operators.gates import two_decimals

# Fixed values
MIN_DIRECTION = 0.70
TIER2_WEIGHTS = {"pickup": 0.30, "dest": 0.25, "detour": 0.25, "direction": 0.10, "time": 0.10}
CONGESTED_WEIGHTS = {"pickup": 0.35, "detour": 0.35, "direction": 0.15, "time": 0.15}
DEFAULT_CIRCUITY = {"n": 0, "mean": 1.35, "p95": 1.80, "max": 2.50, "min": 1.0}
METHODS = ("none", "fixed_radius", "circuity_scaled", "geometric_detour", "admissible_bound")


def lower_bound_detour() -> Column:
    """Straight-line pool length minus the driver's road length: never above the road detour."""
    pool = F.col("pickup_km") + F.col("shared_km") + F.col("dest_km")
    return F.greatest(F.lit(0.0), pool - F.col("driver_road_km"))


def pruner(method: str, t: dict[str, float], p95_circuity: Column | float = DEFAULT_CIRCUITY["p95"]) -> Column:
    """Keep-this-pair condition; the cheap time test comes first."""
    c = F.col
    in_time = c("dep_diff_min") <= t["time_diff_min"]
    near = in_time & (c("pickup_km") <= t["pickup_km"]) & (c("dest_km") <= t["dest_km"])
    if method == "none":
        return F.lit(True)
    if method == "fixed_radius":
        return near
    if method == "circuity_scaled":
        factor = p95_circuity if isinstance(p95_circuity, Column) else F.lit(p95_circuity)
        return in_time & (c("pickup_km") * factor <= t["pickup_km"]) & (c("dest_km") * factor <= t["dest_km"])
    if method == "geometric_detour":
        return near & (c("geo_detour_km") <= t["detour_km"])
    if method == "admissible_bound":
        return near & (lower_bound_detour() <= t["detour_km"])
    raise ValueError(f"unknown pruner {method!r}")


def _share(value: Column, limit: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - value / limit)


def tier2(pairs: DataFrame, t: dict[str, float]) -> DataFrame:
    """Road gates and score over pairs with ``road_pickup_km``, ``road_dest_km``, ``detour_km``, ``detour_s``.

    Nulls mean unreachable: such a pair is infeasible and scores zero.
    """
    c = F.col
    w = TIER2_WEIGHTS
    reachable = c("road_pickup_km").isNotNull() & c("road_dest_km").isNotNull() & c("detour_km").isNotNull()
    ok = (
        reachable & (c("road_pickup_km") <= t["pickup_km"]) & (c("road_dest_km") <= t["dest_km"]) & (c("detour_km") <= t["detour_km"])
        & (c("detour_s") <= t["detour_time_s"]) & (c("dep_diff_min") <= t["time_diff_min"]) & (c("direction_sim") >= MIN_DIRECTION)
    )
    score = 100.0 * (
        w["pickup"] * _share(c("road_pickup_km"), t["pickup_km"]) + w["dest"] * _share(c("road_dest_km"), t["dest_km"])
        + w["detour"] * _share(c("detour_s"), t["detour_time_s"]) + w["direction"] * F.greatest(F.lit(0.0), c("direction_sim"))
        + w["time"] * _share(c("dep_diff_min"), t["time_diff_min"]))
    pairs = pairs.withColumns({"reachable": reachable, "feasible": F.coalesce(ok, F.lit(False))})
    return pairs.withColumn("score", F.when(c("feasible"), two_decimals(score)).otherwise(0.0))


def congested_scores(pairs: DataFrame, t: dict[str, float], tag: str) -> DataFrame:
    """Feasibility and score of one cost table; columns ``{tag}_detour_km`` and ``{tag}_detour_s``."""
    c = F.col
    w = CONGESTED_WEIGHTS
    det_km, det_s = c(f"{tag}_detour_km"), c(f"{tag}_detour_s")
    ok = (
        c("road_pickup_km").isNotNull() & det_km.isNotNull() & (c("road_pickup_km") <= t["pickup_km"]) & (det_km <= t["detour_km"])
        & (det_s <= t["detour_time_s"]) & (c("dep_diff_min") <= t["time_diff_min"]) & (c("direction_sim") >= MIN_DIRECTION))
    score = 100.0 * (
        w["pickup"] * _share(F.round(c("road_pickup_km"), 4), t["pickup_km"]) + w["detour"] * _share(F.round(det_s, 1), t["detour_time_s"])
        + w["direction"] * F.round(c("direction_sim"), 4) + w["time"] * _share(F.round(c("dep_diff_min"), 2), t["time_diff_min"]))
    pairs = pairs.withColumn(f"{tag}_feasible", F.coalesce(ok, F.lit(False)))
    return pairs.withColumn(f"{tag}_score", F.when(c(f"{tag}_feasible"), two_decimals(score)).otherwise(0.0))


# Limits of the downtown study, stretched by a scale for wider networks
GATE_LIMITS = {
    "geo": {"pickup": 0.8, "dest": 1.0, "detour": 1.0},
    "net": {"pickup": 0.8, "dest": 1.0, "detour": 1.2, "detour_s": 240.0},
    "time_min": 20.0,
}
RELEVANCE = (  # detour km, detour s, pickup km, minutes, direction -> grade
    (3, 0.4, 90.0, 0.4, 8.0, 0.85),
    (2, 0.8, 150.0, 0.6, 12.0, 0.75),
    (1, 1.2, 240.0, 0.8, 15.0, 0.70),
)
UNREACHABLE_KM, UNREACHABLE_S = 999.0, 9999.0
SCORERS = ("a_geometric", "b_route_time", "c_network", "abl_geometry", "abl_net_distance", "abl_net_time", "abl_full")


def network_report(pairs: DataFrame, km_scale: float = 1.0, s_scale: float = 1.0) -> DataFrame:
    """Geometry and network gates, graded relevance 0..3, circuity factors."""
    c = F.col
    g, n, minutes = GATE_LIMITS["geo"], GATE_LIMITS["net"], GATE_LIMITS["time_min"]
    reach = c("road_pickup_km").isNotNull() & c("road_dest_km").isNotNull() & c("detour_km").isNotNull()
    geo_ok = (
        (c("pickup_km") <= g["pickup"] * km_scale) & (c("dest_km") <= g["dest"] * km_scale) & (c("geo_detour_km") <= g["detour"] * km_scale)
        & (c("dep_diff_min") <= minutes) & (c("direction_sim") > 0.5))
    net_ok = (
        reach & (c("road_pickup_km") <= n["pickup"] * km_scale) & (c("road_dest_km") <= n["dest"] * km_scale)
        & (c("detour_km") <= n["detour"] * km_scale) & (c("detour_s") <= n["detour_s"] * s_scale)
        & (c("dep_diff_min") <= minutes) & (c("direction_sim") > 0.5))
    grade = F.lit(0)
    for level, km, s, pick, mins, direction in reversed(RELEVANCE):
        hit = (
            reach & (c("detour_km") <= km * km_scale) & (c("detour_s") <= s * s_scale) & (c("road_pickup_km") <= pick * km_scale)
            & (c("dep_diff_min") <= mins) & (c("direction_sim") >= direction))
        grade = F.when(hit, level).otherwise(grade)
    return pairs.withColumns({
        "reachable": reach, "geometric_eligible": geo_ok, "network_eligible": F.coalesce(net_ok, F.lit(False)), "relevance": grade,
        "pickup_circuity": F.round(F.when((c("pickup_km") > 0.05) & c("road_pickup_km").isNotNull(), c("road_pickup_km") / c("pickup_km")).otherwise(1.0), 3),
        "route_circuity": F.round(F.when(c("driver_km") > 0.05, c("driver_road_km") / c("driver_km")).otherwise(1.0), 3),
    })


def with_scorers(report: DataFrame, km_scale: float = 1.0, s_scale: float = 1.0) -> DataFrame:
    """Seven competing scores as columns; fields are rounded and unreachable costs are sentinels."""
    c = F.col
    r = report.withColumns({
        "_p": F.round("pickup_km", 4), "_d": F.round("dest_km", 4), "_g": F.round("geo_detour_km", 4), "_dir": F.round("direction_sim", 4),
        "_t": F.round("dep_diff_min", 2), "_rp": F.coalesce(F.round("road_pickup_km", 4), F.lit(UNREACHABLE_KM)),
        "_rd": F.coalesce(F.round("road_dest_km", 4), F.lit(UNREACHABLE_KM)), "_ds": F.coalesce(F.round("detour_s", 1), F.lit(UNREACHABLE_S)),
        "_vk": F.round("driver_road_km", 4), "_vs": F.round("driver_road_s", 1),
    })
    k = km_scale
    time = _share(c("_t"), 30.0)
    speed = F.when(c("_vs") > 0, c("_vk") / (c("_vs") / 3600.0)).otherwise(30.0)
    close = c("reachable") & (c("_rp") <= 1.0 * k)
    network = F.when(c("network_eligible") & c("reachable"), two_decimals(100.0 * (
        0.25 * _share(c("_rp"), 1.0 * k) + 0.20 * _share(c("_rd"), 1.5 * k) + 0.25 * _share(c("_ds"), 240.0 * s_scale) + 0.15 * c("_dir") + 0.15 * time))).otherwise(0.0)
    scores = {
        "a_geometric": F.when(c("geometric_eligible"), two_decimals(100.0 * (
            0.35 * _share(c("_p"), 1.0 * k) + 0.25 * _share(c("_d"), 1.5 * k) + 0.25 * _share(c("_g"), 1.5 * k) + 0.15 * time))).otherwise(0.0),
        "b_route_time": F.when(c("geometric_eligible"), two_decimals(100.0 * (
            0.25 * _share(c("_p"), 2.0 * k) + 0.20 * _share(c("_d"), 3.0 * k) + 0.25 * F.round("route_sim", 4) + 0.10 * c("_dir")
            + 0.10 * _share(c("_g"), 5.0 * k) + 0.10 * time))).otherwise(0.0),
        "c_network": network,
        "abl_geometry": F.when(c("geometric_eligible"), two_decimals(100.0 * (0.50 * _share(c("_p"), 1.0 * k) + 0.50 * _share(c("_g"), 1.5 * k)))).otherwise(0.0),
        "abl_net_distance": F.when(close, two_decimals(100.0 * (0.50 * _share(c("_rp"), 1.0 * k) + 0.50 * _share(c("_g"), 1.5 * k)))).otherwise(0.0),
        "abl_net_time": F.when(close, two_decimals(100.0 * (
            0.40 * _share(c("_rp"), 1.0 * k) + 0.40 * _share(c("_g"), 1.5 * k) + 0.20 * F.least(F.lit(1.0), speed / 40.0)))).otherwise(0.0),
        "abl_full": network,
    }
    return r.withColumns(scores).drop("_p", "_d", "_g", "_dir", "_t", "_rp", "_rd", "_ds", "_vk", "_vs")


def scorers_long(scored: DataFrame, keep: list[str]) -> DataFrame:
    return scored.select(*keep, F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("score")) for n in SCORERS])))
