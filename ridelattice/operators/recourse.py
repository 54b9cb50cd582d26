"""Disruption: trips that meet incidents, realised outcomes, recourse, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.functions.congestion import INCIDENT_DELAY

# Fixed values of the boarding-time model
DWELL_MEAN_S = {"pickup": 60.0, "dropoff": 25.0}
DWELL_CV = 0.35
DWELL_MIN_S = 5.0
DWELL_MAX_FACTOR = 3.0

SLICE_S = 900  # incidents are joined on edge and slices of this length


def hashed_uniform(*parts: Column | str) -> Column:
    """Uniform in (0, 1) from the first 52 bits of the ids' MD5: the same for the same ids, in any engine and partitioning."""
    digits = F.substring(F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def dwell_seconds(kind: Column, u1: Column, u2: Column) -> Column:
    """Log-normal boarding time from two uniforms, held within 5 s and three times the mean."""
    mean = F.when(kind == "pickup", DWELL_MEAN_S["pickup"]).otherwise(DWELL_MEAN_S["dropoff"])
    sigma2 = math.log(1.0 + DWELL_CV**2)
    normal = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
    raw = F.exp(F.log(mean) - sigma2 / 2 + math.sqrt(sigma2) * normal)
    return F.greatest(F.lit(DWELL_MIN_S), F.least(DWELL_MAX_FACTOR * mean, raw))


def affected_trips(trip_edges: DataFrame, incidents: DataFrame, at: str = "dep_s") -> DataFrame:
    """Trips whose planned edges meet an incident active at departure.

    Incidents are repeated into the time slices they cover, so an edge's whole history never meets in one task.
    """
    size = SLICE_S
    i = incidents.select("u", "v", "t_start", "t_end", F.explode(F.sequence(F.floor(F.col("t_start") / size), F.floor(F.col("t_end") / size))).alias("_slice"))
    live = trip_edges.withColumn("_slice", F.floor(F.col(at) / size)).join(i, ["u", "v", "_slice"])
    return live.filter((F.col("t_start") <= F.col(at)) & (F.col(at) < F.col("t_end"))).select("trip_id").distinct()


def edges_under_incidents(trip_edges: DataFrame, incidents: DataFrame, max_s: float = 6 * 3600.0) -> DataFrame:
    """Planned edges beside each incident that can overlap the trip's span of ``max_s`` seconds.

    Joined on edge and time slice: a span covers two slices, an incident those of its duration, and a match counts in
    the first slice that both share.
    """
    first = lambda c: F.floor(F.col(c) / max_s)
    e = trip_edges.select("trip_id", "seq", "u", "v", "dep_s", first("dep_s").alias("_from"))
    e = e.withColumn("_slice", F.explode(F.array(F.col("_from"), F.col("_from") + 1)))
    i = incidents.select("u", "v", "t_start", "t_end", "reduction", "closed", first("t_start").alias("_ifrom"))
    i = i.withColumn("_slice", F.explode(F.sequence("_ifrom", first("t_end"))))
    near = e.join(i, ["u", "v", "_slice"]).filter(F.col("_slice") == F.greatest("_from", "_ifrom"))
    return near.filter((F.col("t_start") < F.col("dep_s") + max_s) & (F.col("t_end") > F.col("dep_s"))).drop("_slice", "_from", "_ifrom")


def realised_trips(trip_edges: DataFrame, edges: DataFrame, incidents: DataFrame, max_s: float = 6 * 3600.0) -> DataFrame:
    """Outcome of driving the plan without adapting.

    Entry times depend on all earlier delays, so each trip's edges are folded in
    order. Only incidents that can overlap the trip's time span are attached to an edge.
    """
    e = trip_edges.join(edges.select("u", "v", "km", "secs"), ["u", "v"])
    near = edges_under_incidents(e, incidents, max_s)
    near = near.groupBy("trip_id", "seq").agg(F.collect_list(F.struct("t_start", "t_end", "reduction", "closed")).alias("inc"))
    e = e.join(near, ["trip_id", "seq"], "left")
    trips = e.groupBy("trip_id", "dep_s").agg(F.array_sort(F.collect_list(F.struct("seq", "km", "secs", "inc"))).alias("path"))
    zero = F.struct(F.col("dep_s").cast("double").alias("t"), F.lit(0.0).alias("km"), F.lit(0.0).alias("s"), F.lit(False).alias("closed"))

    def step(acc: Column, x: Column) -> Column:
        live = F.filter(F.coalesce(x["inc"], F.array()), lambda i: (i["t_start"] <= acc["t"]) & (acc["t"] < i["t_end"]))
        closed = acc["closed"] | F.exists(live, lambda i: i["closed"])
        factor = F.aggregate(live, F.lit(1.0), lambda m, i: F.greatest(m, F.when(i["closed"], 1.0).otherwise(1.0 + INCIDENT_DELAY * i["reduction"])))
        took = F.when(closed, 0.0).otherwise(x["secs"] * factor)
        return F.struct((acc["t"] + took).alias("t"), (acc["km"] + F.when(closed, 0.0).otherwise(x["km"])).alias("km"), (acc["s"] + took).alias("s"), closed.alias("closed"))

    return trips.select("trip_id", F.aggregate("path", zero, step).alias("r")).select(
        "trip_id", F.col("r.km").alias("km"), F.col("r.s").alias("s"), F.col("r.closed").alias("closed"))


def recovery(trips: DataFrame) -> DataFrame:
    """Recovered share and regrets; null where undefined."""
    c = F.col
    gap = c("nominal_objective") - c("realised_objective")
    lost = (gap > 0) & ~c("realised_feasible")
    full = F.round(F.least(F.lit(100.0), c("recourse_objective") / c("nominal_objective") * 100.0), 1)
    part = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (c("recourse_objective") - c("realised_objective")) / gap * 100.0)), 1)
    regret = lambda v: F.round(F.greatest(F.lit(0.0), c("best_objective") - c(v)), 2)
    known = c("best_objective").isNotNull()
    return trips.withColumns({
        "recovery_pct": F.when(lost, full).when(gap > 1.0, part),
        "static_regret": F.when(known, regret("realised_objective")),
        "recourse_regret": F.when(known & c("recourse_feasible"), regret("recourse_objective")),
    })


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Feasible shares, mean objectives, recovery and regret per condition; nulls are skipped."""
    c = F.col
    pct = lambda b: F.round(F.avg(F.when(b, 100.0).otherwise(0.0)), 1)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trips"), pct(c("realised_feasible")).alias("static_feasible_pct"), pct(c("recourse_feasible")).alias("recourse_feasible_pct"),
        F.round(F.avg("nominal_objective"), 2).alias("nominal_objective"), F.round(F.avg("realised_objective"), 2).alias("static_objective"),
        F.round(F.avg("recourse_objective"), 2).alias("recourse_objective"), F.round(F.avg("recovery_pct"), 1).alias("recovery_pct"),
        F.count("recovery_pct").alias("recovery_defined"), F.round(F.avg("static_regret"), 2).alias("static_regret"),
        F.round(F.avg("recourse_regret"), 2).alias("recourse_regret"))
