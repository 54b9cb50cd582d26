"""Dispatch log analytics: request life cycle, policy metrics, itinerary checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.operators.running import running_sum


def request_lifecycle(events: DataFrame, horizon_s: float) -> DataFrame:
    """One row per request with its times and final status at the horizon.

    Requests still waiting or only assigned at the horizon count as cancelled.
    """
    seen = events.filter(F.col("t_s") <= horizon_s)
    at = lambda t: F.min(F.when(F.col("type") == t, F.col("t_s")))
    r = seen.groupBy("request_id").agg(
        at("CREATED").alias("created_s"), at("ASSIGNED").alias("assigned_s"), at("PICKED_UP").alias("picked_s"),
        at("COMPLETED").alias("completed_s"), at("CANCELLED").alias("cancelled_s"))
    status = F.when(F.col("completed_s").isNotNull(), "COMPLETED").when(F.col("picked_s").isNotNull(), "PICKED_UP").otherwise("CANCELLED")
    return r.withColumns({
        "wait_s": F.col("picked_s") - F.col("created_s"), "ride_s": F.col("completed_s") - F.col("picked_s"),
        "total_s": F.col("completed_s") - F.col("created_s"), "status": status,
    })


def policy_metrics(requests: DataFrame, by: list[str]) -> DataFrame:
    """Fulfilment, cancellation, mean and exact p50/p95 of wait and journey (linear interpolation).

    Times are whole seconds, so a count per value is small; percentiles are taken
    over those counts and no group's rows meet in one task.
    """

    def spread(col: str) -> DataFrame:
        hist = requests.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
        p = lambda f: F.round(F.percentile(F.col(col), F.lit(f), F.col("_n")), 6)
        return hist.groupBy(*by).agg(
            F.round(F.sum(F.col(col) * F.col("_n")) / F.sum("_n"), 6).alias(f"mean_{col}"), p(0.5).alias(f"p50_{col}"), p(0.95).alias(f"p95_{col}"))

    share = lambda s: F.round(F.count_if(F.col("status") == s) * 100.0 / F.count(F.lit(1)), 2)
    base = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), share("COMPLETED").alias("fulfilled_pct"), share("CANCELLED").alias("cancelled_pct"))
    return base.join(spread("wait_s"), by, "left").join(spread("total_s"), by, "left")


def compare_policies(metrics: DataFrame, regime: str, policy: str, base: str, other: str, columns: list[str]) -> DataFrame:
    """Two policies side by side per regime, with change in percent."""
    wide = metrics.groupBy(regime).pivot(policy, [base, other]).agg(*[F.first(c).alias(c) for c in columns])
    change = lambda c: F.round(F.when(F.col(f"{base}_{c}") != 0, (F.col(f"{other}_{c}") - F.col(f"{base}_{c}")) / F.col(f"{base}_{c}") * 100.0), 2)
    return wide.withColumns({f"{c}_change_pct": change(c) for c in columns})


def itinerary_violations(stops: DataFrame, bucket_s: int = 300) -> DataFrame:
    """Vehicles whose load leaves 0..capacity, or whose drop-off comes before the pickup.

    ``stops``: vehicle_id, request_id, kind, t_s, stop_no, seats, capacity.
    """
    delta = F.when(F.col("kind") == "pickup", F.col("seats")).otherwise(-F.col("seats"))
    load = running_sum(stops, ["vehicle_id"], F.floor(F.col("t_s") / bucket_s), ["t_s", "stop_no"], {"load": delta.cast("bigint")})
    over = load.groupBy("vehicle_id").agg(
        F.count_if(F.col("load") > F.col("capacity")).alias("overloads"), F.count_if(F.col("load") < 0).alias("negative_loads"), F.max("load").alias("max_load"))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.struct("t_s", "stop_no")))
    pairs = stops.groupBy("vehicle_id", "request_id").agg(first("pickup").alias("p"), first("dropoff").alias("d"))
    wrong = pairs.groupBy("vehicle_id").agg(F.count_if(F.col("d").isNotNull() & (F.col("p").isNull() | (F.col("d") < F.col("p")))).alias("precedence_errors"))
    return over.join(wrong, "vehicle_id")
