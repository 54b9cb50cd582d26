"""Legs and insertions found in batches, against the same found one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelattice.operators import legs, network, pool, replan
from ridelattice.plans.fleet import POOL_LIMITS
from tests.test_replan import INCIDENTS, LIMITS, arrivals, case, frames

EDGES = "u bigint, v bigint, km double, secs double, u_name string, v_name string"


def streets(rng):
    out = [(a, b, float(rng.randint(1, 3)), float(rng.randint(40, 90))) for a in range(20) for b in rng.sample(range(20), 3) if a != b]
    found = [(u, v, t, t + rng.randint(50, 900), rng.choice([0.2, 0.6, None]), rng.random() < 0.3) for u, v, _, _ in rng.sample(out, 20) for t in [rng.randint(21_000, 22_000)]]
    return out, [(*i[:4], i[4] or 0.0, i[5]) for i in found], found


def test_legs_equal_the_search_one_by_one(spark, monkeypatch):
    """Departures on both sides of a block's end, a place out of the network, an incident without reduction; shares of two legs."""
    monkeypatch.setattr(legs, "MOST_LEGS", 2)
    edges, plain, given = streets(random.Random(4))
    e = spark.createDataFrame([(*x, "a", "b") for x in edges + edges[:5]], EDGES)
    places = spark.createDataFrame([(n, 400.0) for n in (0, 3, 7, 99)] + [(3, 100.0)], "node bigint, within_s double")
    wanted = [(n, t, d) for n in (0, 3, 7, 99) for t in (21_100.0, 21_500.0, 21_650.0) for d in (n, 5, 11, 12, 99)]
    known = legs.reach(e, places, spark.createDataFrame(given, INCIDENTS), 21_100.0, 22_100.0)
    got = {tuple(r[:3]): tuple(r[3:]) for r in legs.leg_arrivals(spark.createDataFrame(wanted + wanted, "src bigint, depart_s double, dst bigint"), *known).collect()}
    want = {}
    for n, t, d in wanted:
        at = arrivals(edges, plain, n, t).get(d)
        if at and at[0] - t <= 400.0:
            want[n, t, d] = at
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_recourse_does_not_search_leg_by_leg(spark, monkeypatch):
    monkeypatch.setattr(replan, "earliest_arrival", None)
    trips, _, edges, incidents = frames(spark, *case(1))
    assert replan.drive_orders(trips, edges, incidents, LIMITS).count() > 0


def test_insertions_of_a_trip_equal_trials_one_by_one(spark, monkeypatch):
    """Riders in shares of three; a place without roads; a rider of too many seats."""
    monkeypatch.setattr(pool, "MOST_TRIED", 3)
    rng = np.random.default_rng(5)
    costs = [(a, b, float(rng.integers(1, 9)), float(rng.integers(50, 300))) for a in range(9) for b in range(9) if a != b and b != 8]
    od = spark.createDataFrame(costs, "src bigint, dst bigint, km double, s double")
    new = [(100 + i, int(rng.integers(9)), int(rng.integers(9)), 1 + i % 4) for i in range(20)]
    trips = [(1, 4, 0, 7, [(50, 1, 6, 1)], [1, 2]), (2, 3, 2, 3, [(51, 4, 5, 1), (52, 1, 3, 1)], [1, 3, 2, 4])]
    nodes = spark.createDataFrame([(i, 31.0, 75.0 + i / 100) for i in range(9)], "node bigint, lat double, lon double")
    t = spark.createDataFrame(trips, "driver_id bigint, capacity int, v_o bigint, v_d bigint, riders array<struct<rider_id:bigint,r_o:bigint,r_d:bigint,seats:int>>, stops array<int>")
    t = t.withColumns({"town": F.lit(0), "dep_s": F.lit(0)})
    r = spark.createDataFrame([(i, 0, o, d, w, 0) for i, o, d, w in new], "rider_id bigint, town int, o_node bigint, d_node bigint, seats int, dep_s bigint")
    tried = []
    monkeypatch.setattr(pool, "greedy_assignment", lambda edges: tried.extend(edges.collect()) or edges)
    got = {(x.driver_id, x.rider_id): (x.objective, list(x.stops), len(x.riders)) for x in pool.active_insertions(t, r, nodes, od, POOL_LIMITS, 50.0).collect()}
    one = t.crossJoin(r.select("rider_id", F.struct("rider_id", F.col("o_node").alias("r_o"), F.col("d_node").alias("r_d"), "seats").alias("new")))
    one = one.withColumn("riders", F.concat("riders", F.array("new"))).withColumns({"k": F.size("riders"), "pool_id": F.concat_ws("-", "driver_id", "rider_id")})
    plain = pool.best_insertions(pool.with_leg_costs(one.drop("new"), od), POOL_LIMITS).collect()
    assert got == {(x.driver_id, x.rider_id): (x.objective, list(x.stops), x.k) for x in plain} and len(tried) == len(got) > 5
