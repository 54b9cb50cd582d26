"""Rankings: top-k per request, baselines, and ablated weightings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.operators.gates import WEIGHTS, normalised
from ridelattice.operators.recourse import hashed_uniform

# Fixed values
BASELINES = ("seeded_random", "nearest_neighbour", "distance_destination", "route_time")
ABLATIONS = {
    "full": (),
    "route_removed": ("route_sim", "direction_sim"),
    "temporal_removed": ("dep_diff_min",),
    "context_removed": (),
}


def top_k(scored: DataFrame, k: int, by: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Best k rows per key in a total order.

    ``row_number() <= k`` lets Spark keep k rows per key before the shuffle
    (window group limit), so a key with very many rows is cut on the map side.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must lie between 1 and 50")
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def rank_eligible(gated: DataFrame, k: int = 3) -> DataFrame:
    """Top-k eligible drivers per request by score, ties by driver id."""
    return top_k(gated.filter("eligible"), k, ["rider_id"], [F.desc("score"), F.col("driver_id")])


def baseline_rankings(eligible: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """All baselines in one pass: the method is a column, smaller sort key first."""
    methods = F.array(
        F.struct(F.lit(BASELINES[0]).alias("method"), hashed_uniform(F.lit(seed), "rider_id", "driver_id").alias("key")),
        F.struct(F.lit(BASELINES[1]).alias("method"), F.col("pickup_km").alias("key")),
        F.struct(F.lit(BASELINES[2]).alias("method"), (F.col("pickup_km") + F.col("dest_km")).alias("key")),
        F.struct(F.lit(BASELINES[3]).alias("method"), (-F.col("score")).alias("key")),
    )
    long = eligible.select("rider_id", "driver_id", F.inline(methods))
    return top_k(long, k, ["rider_id", "method"], [F.col("key"), F.col("driver_id")])


def ablation_weights(configuration: str) -> dict[str, float]:
    kept = {n: w for n, w in WEIGHTS.items() if n not in ABLATIONS[configuration]}
    total = sum(kept.values())
    return {n: w / total for n, w in kept.items()}


def ablated_rankings(eligible: DataFrame, k: int = 3) -> DataFrame:
    """Rank the same eligible pairs under each weighting (eligibility never changes)."""
    configs = []
    for name in ABLATIONS:
        score: Column = F.lit(0.0)
        for feature, w in ablation_weights(name).items():
            score = score + F.lit(w) * normalised(feature)
        configs.append(F.struct(F.lit(name).alias("configuration"), score.alias("ablated_score")))
    long = eligible.select("rider_id", "driver_id", F.inline(F.array(*configs)))
    return top_k(long, k, ["rider_id", "configuration"], [F.desc(F.round("ablated_score", 9)), F.col("driver_id")])


__all__ = ["BASELINES", "ABLATIONS", "top_k", "rank_eligible", "baseline_rankings", "ablated_rankings", "ablation_weights"]
