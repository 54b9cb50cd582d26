"""Recourse: pooled trips driven as planned and replanned while incidents come and go, legs chained by arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.operators import pool
from ridelattice.operators.legs import leg_arrivals, reach
from ridelattice.operators.network import earliest_arrival
from ridelattice.operators.recourse import affected_trips, edges_under_incidents, realised_trips
from ridelattice.session import cut_lineage


def drive_orders(trips: DataFrame, edges: DataFrame, incidents: DataFrame, limits: dict[str, float], max_k: int = pool.MAX_POOL,
                 scenario: str = "no_congestion", costs: DataFrame | None = None) -> DataFrame:
    """Every stop order of every trip, each leg entered when the one before it ends, under the incidents of that moment.

    ``trips``: pool_id, v_o, v_d, riders, k, capacity, dep_s, plan (stops), direct_km, direct_s. Result: one row per trip and
    order that ends within the limits, ``(pool_id, stops, on_plan, detour_km, detour_s, mean_ride_s, objective, score)``;
    ``score`` is the detour part of the objective, by which orders are chosen. Orders share their beginnings: level by level,
    rows that have made the same stops and stand at the same place at the same moment and distance become one (the smaller
    order; the plan apart), and a row beyond a limit goes, as a detour never shrinks. An empty table gives an empty result.
    The legs of a level are searched together (:mod:`legs`); ``costs`` as of :func:`legs.reach`, else found here.
    """
    c = F.col
    fixed = ["v_o", "v_d", "riders", "k", "capacity", "dep_s", "plan", "direct_km", "direct_s"]
    stretch = 1.0 + pool.STRETCH * (c("trip.k") - 1)
    lim_km, lim_s = limits["detour_km"] * stretch, limits["detour_time_s"] * stretch
    rows = trips.select(
        "pool_id", F.struct(*fixed).alias("trip"), c("v_o").cast("bigint").alias("node"), F.expr("CAST(array() AS ARRAY<INT>)").alias("stops"), F.lit(0).alias("done"), F.lit(0).alias("load"),
        c("dep_s").cast("double").alias("t"), F.lit(0.0).alias("km"), F.lit(0.0).alias("ride"))
    rows = cut_lineage(rows)
    longest, first, last = rows.agg(F.max(c("trip.direct_s") + lim_s), F.min("t"), F.max("t")).first()
    ended = None
    # every place of a trip, and the time that may pass from there: no more than the whole trip may take
    own = F.flatten(F.transform("trip.riders", lambda r: F.array(r["r_o"], r["r_d"])))
    places = rows.select(F.explode(F.concat(F.array("trip.v_o"), own).cast("array<bigint>")).alias("node"), (c("trip.direct_s") + lim_s).alias("within_s")).filter("within_s >= 0")
    known = None if longest is None or first is None or scenario != "no_congestion" else reach(edges, places, incidents, first, last + longest, costs)
    for level in range(2 * max_k + 1):
        made = F.size("stops")
        free = F.filter(F.sequence(F.lit(1), 2 * c("trip.k")), lambda x: ~F.array_contains("stops", x) & ((x % 2 == 1) | F.array_contains("stops", x - 1)))
        step = rows.withColumn("stop", F.explode(F.when(made == 2 * c("trip.k"), F.array(F.lit(0))).otherwise(free)))
        rider = F.get("trip.riders", F.greatest(F.lit(0), F.floor((c("stop") - 1) / 2).cast("int")))
        is_pick = c("stop") % 2 == 1
        step = step.withColumns({
            "load": c("load") + F.when(c("stop") == 0, 0).when(is_pick, rider["seats"]).otherwise(-rider["seats"]),
            "to": F.when(c("stop") == 0, c("trip.v_d")).when(is_pick, rider["r_o"]).otherwise(rider["r_d"]).cast("bigint"),
        }).filter(c("load") <= c("trip.capacity"))
        if known is None:
            arrive = earliest_arrival(edges, step.select("node", c("t").alias("depart_s")), scenario, incidents, max_s=longest)
        else:
            arrive = leg_arrivals(step.select(c("node").alias("src"), c("t").alias("depart_s"), c("to").alias("dst")), *known)
        leg = arrive.select(c("src").alias("node"), c("depart_s").alias("t"), c("dst").alias("to"), "arrive_s", c("km").alias("leg_km"))
        step = step.join(leg, ["node", "t", "to"]).withColumn("km", c("km") + c("leg_km"))
        step = step.filter((c("arrive_s") - c("trip.dep_s") - c("trip.direct_s") <= lim_s) & (c("km") - c("trip.direct_km") <= lim_km))
        # a ride lasts from the end of the leg to the pickup until the end of the leg to the drop-off
        step = cut_lineage(step.withColumn("ride", c("ride") + F.when(c("stop") == 0, 0.0).when(is_pick, -c("arrive_s")).otherwise(c("arrive_s"))))
        if step.isEmpty():
            break
        end = step.filter("stop = 0").select("pool_id", "trip", "stops", c("arrive_s").alias("t"), "km", "ride")
        ended = end if ended is None else ended.unionByName(end)
        on = step.filter("stop > 0").withColumns({
            "stops": F.concat("stops", F.array("stop")), "done": c("done").bitwiseOR(F.expr("shiftleft(1, stop - 1)"))})
        on = on.withColumn("on_plan", c("stops") == F.slice("trip.plan", F.lit(1), F.size("stops")))
        merged = on.groupBy("pool_id", "done", c("to").alias("node"), c("arrive_s").alias("t"), "km", "on_plan").agg(
            F.min("trip").alias("trip"), F.min("load").alias("load"), F.min(F.struct("stops", "ride")).alias("b"))
        rows = merged.select("pool_id", "trip", "node", "b.stops", "done", "load", "t", "km", "b.ride")
    if ended is None:
        ended = rows.select("pool_id", "trip", "stops", "t", "km", "ride").limit(0)
    out = ended.select("pool_id", "stops", (c("stops") == c("trip.plan")).alias("on_plan"), "trip.k", "trip.capacity", F.struct(
        F.greatest(F.lit(0.0), c("km") - c("trip.direct_km")).alias("detour_km"), F.greatest(F.lit(0.0), c("t") - c("trip.dep_s") - c("trip.direct_s")).alias("detour_s"),
        (c("ride") / c("trip.k")).alias("mean_ride_s"), F.lit(0).alias("max_load")).alias("w"))
    own = 1.0 + pool.STRETCH * (c("k") - 1)
    score = pool.OBJECTIVE["detour"] * (1.0 - c("w.detour_s") / (limits["detour_time_s"] * own)) + pool.OBJECTIVE["direct"] * (1.0 - c("w.detour_km") / (limits["detour_km"] * own))
    return cut_lineage(out.select("pool_id", "stops", "on_plan", "w.detour_km", "w.detour_s", "w.mean_ride_s", pool._objective(c("w"), limits).alias("objective"), F.round(score, 8).alias("score")))


def driven_plans(trips: DataFrame, planned: DataFrame, edges: DataFrame, incidents: DataFrame, limits: dict[str, float]) -> DataFrame:
    """What the plans cost when driven without adapting: ``(pool_id, realised_objective, realised_feasible)``.

    ``planned``: pool_id, leg (from 0), seq, u, v. The way up to each stop is a trip of its own, so riders' times
    come from the same fold as the trip's. A closed edge ends a trip as infeasible; infeasible trips are worth 0.
    """
    c = F.col
    legs = 2 * c("k") + 1
    upto = planned.join(trips.select("pool_id", "dep_s", "k"), "pool_id").withColumn("upto", F.explode(F.sequence(c("leg"), (legs - 1).cast("int"))))
    way = upto.select(F.concat_ws("#", "pool_id", c("upto").cast("string")).alias("trip_id"), (c("leg") * 1_000_000 + c("seq")).alias("seq"), "u", "v", "dep_s")
    drive = realised_trips(way, edges, incidents)
    drive = drive.select(F.substring_index("trip_id", "#", 1).alias("pool_id"), F.substring_index("trip_id", "#", -1).cast("int").alias("leg"), "km", "s", "closed")
    # a way of legs without edges (all stops at the start) takes no time
    at = trips.withColumn("leg", F.explode(F.sequence(F.lit(0), (legs - 1).cast("int")))).join(drive, ["pool_id", "leg"], "left")
    s = F.coalesce("s", F.lit(0.0))
    stop = F.get("plan", c("leg"))
    ride = F.sum(F.when(stop.isNull(), 0.0).when(stop % 2 == 1, -s).otherwise(s)) / F.max("k")
    g = at.groupBy("pool_id").agg(
        F.max("k").alias("k"), F.max("capacity").alias("capacity"), ride.alias("mean_ride_s"), F.bool_or(F.coalesce("closed", F.lit(False))).alias("closed"),
        F.greatest(F.lit(0.0), F.max(F.coalesce("km", F.lit(0.0))) - F.max("direct_km")).alias("detour_km"), F.greatest(F.lit(0.0), F.max(s) - F.max("direct_s")).alias("detour_s"))
    w = F.struct("detour_km", "detour_s", "mean_ride_s", F.lit(0).alias("max_load"))
    worth = F.when(~c("closed"), pool._objective(w, limits))
    return g.select("pool_id", F.coalesce(worth, F.lit(0.0)).alias("realised_objective"), worth.isNotNull().alias("realised_feasible"))


def replan(trips: DataFrame, planned: DataFrame, edges: DataFrame, incidents: DataFrame, limits: dict[str, float], max_k: int = pool.MAX_POOL,
           costs: DataFrame | None = None) -> DataFrame:
    """Nominal, realised and recourse outcome of planned trips, with the stops that recourse chooses.

    ``trips`` as in :func:`drive_orders` with the plan's ``objective``; ``planned`` as in :func:`driven_plans`. A trip is
    replanned if an edge of its plan meets an incident at departure: the feasible order of the highest score is driven, the
    smaller of equals, the plan if there is none. A trip that meets incidents later drives its plan on the fastest legs of each
    moment. One that meets none keeps its nominal outcome. ``best_objective``, known for up to two riders, is that of the best
    order with all incidents foreseen. ``severity`` is that of the heaviest incident on the plan.
    """
    c = F.col
    edge = planned.join(trips.select("pool_id", "dep_s"), "pool_id").select(c("pool_id").alias("trip_id"), (c("leg") * 1_000_000 + c("seq")).alias("seq"), "u", "v", "dep_s")
    grade = F.when(c("closed"), 3).when(c("reduction") > 0.5, 2).otherwise(1)
    met = cut_lineage(edges_under_incidents(edge, incidents).groupBy(c("trip_id").alias("pool_id")).agg(F.max(grade).alias("_grade")))
    now = affected_trips(edge, incidents).select(c("trip_id").alias("pool_id"), F.lit(True).alias("triggered"))
    touched = cut_lineage(trips.join(met.select("pool_id"), "pool_id", "left_semi"))
    orders = drive_orders(touched, edges, incidents, limits, max_k, costs=costs)
    least = F.struct(c("score").alias("s"), F.transform("stops", lambda x: -x).alias("o"))
    chosen = orders.groupBy("pool_id").agg(
        F.max_by(F.struct("stops", "objective"), least).alias("_best"), F.max("objective").alias("_top"), F.max(F.when(c("on_plan"), c("objective"))).alias("_plan"))
    drive = driven_plans(touched, planned.join(met.select("pool_id"), "pool_id", "left_semi"), edges, incidents, limits)
    out = trips.join(met, "pool_id", "left").join(now, "pool_id", "left").join(chosen, "pool_id", "left").join(drive, "pool_id", "left")
    calm, move = c("_grade").isNull(), F.coalesce("triggered", F.lit(False))
    worth = F.when(calm, c("objective")).when(move, c("_best.objective")).otherwise(c("_plan"))
    names = F.when(calm, "none")
    for n, name in ((1, "minor"), (2, "moderate"), (3, "severe")):
        names = names.when(c("_grade") == n, name)
    return out.select(
        "pool_id", "driver_id", "k", names.alias("severity"), move.alias("triggered"), "plan", F.when(move, F.coalesce("_best.stops", "plan")).otherwise(c("plan")).alias("chosen"),
        c("objective").alias("nominal_objective"), F.when(calm, c("objective")).otherwise(c("realised_objective")).alias("realised_objective"),
        (calm | c("realised_feasible")).alias("realised_feasible"), F.coalesce(worth, F.lit(0.0)).alias("recourse_objective"), worth.isNotNull().alias("recourse_feasible"),
        F.when(c("k") <= 2, F.when(calm, c("objective")).otherwise(c("_top"))).alias("best_objective"))
