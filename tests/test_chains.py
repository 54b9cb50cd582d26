"""Detours with legs chained by arrival time, found in batches, against the same chained search by search."""

import random

import pytest
from pyspark.sql import functions as F

from ridelattice.operators import chains, network
from ridelattice.plans import network as plans

EDGES = "u bigint, v bigint, km double, secs double, u_name string, v_name string"


@pytest.mark.parametrize("scenario", ["moderate_congestion", "no_congestion"])
def test_detours_equal_the_search_leg_by_leg(spark, monkeypatch, scenario):
    """Parallel roads, one-way roads, a place out of the network, equal and repeated offers, departures in and out of the peak; small shares."""
    monkeypatch.setattr(chains, "MOST_OFFERS", 3)
    monkeypatch.setattr(chains, "MOST_LABELS", 60)
    rng = random.Random(11)
    names = ["folsom_4th", "folsom_1st", "howard_2nd", "howard_3rd", "market_1st", "mission_4th", "dock_fremont"]
    edges = [(u, v, float(rng.randint(1, 9)), float(rng.randint(200, 2000)), rng.choice(names), rng.choice(names)) for t in (0, 20) for u in range(t, t + 9) for v in rng.sample(range(t, t + 9), 2) if u != v]
    edges += [(*edges[0][:2], 1.0, 150.0, "dock_4th", "dock_4th"), (8, 30, 2.0, 300.0, "a", "b")]
    e = spark.createDataFrame(edges, EDGES)
    offers = []
    for i in range(150):
        at = [rng.choice([*range(9)] if i % 3 else [*range(20, 29)]) if rng.random() < 0.95 else rng.choice([8, 25, 30, 99]) for _ in range(4)]
        offers.append((i, at[0], at[1], rng.choice([0, 60, 3000, 40_000, None]), at[2], at[3]))
    offers += [(200, 99, 99, 0, 99, 99), (201, 3, 3, 60, 3, 3), *offers[:3]]
    o = spark.createDataFrame(offers, "driver_id bigint, v_o_node bigint, v_d_node bigint, v_dep_s bigint, r_o_node bigint, r_d_node bigint")
    nodes = spark.createDataFrame([(n,) for n in (*range(9), *range(20, 29), 30, 99)], "node bigint")
    got = chains.chained_detours(o, chains.roads(e, network.od_costs(e, nodes)), scenario)
    got = sorted((tuple(r[c] for c in o.columns), r.dyn_km, r.dyn_s, r.dyn_ff_s) for r in got.collect())

    def legs(asked):
        starts = spark.createDataFrame([(n, float(t)) for n, t in sorted(asked)], "node bigint, depart_s double")
        return {(r.src, r.depart_s, r.dst): (r.arrive_s, r.km, r.ff_s) for r in network.earliest_arrival(e, starts, scenario).collect()}

    first = legs({(x[1], x[3]) for x in offers if x[3] is not None})
    at = lambda found, n, t, d: found.get((n, t, d), (None, None, None))
    pick = [at(first, x[1], x[3], x[4]) for x in offers]
    found = legs({(x[4], p[0]) for x, p in zip(offers, pick) if p[0] is not None})
    ride = [at(found, x[4], p[0], x[5]) for x, p in zip(offers, pick)]
    found = legs({(x[5], p[0]) for x, p in zip(offers, ride) if p[0] is not None})
    want = []
    for x, p, r in zip(offers, pick, ride):
        d, z = at(first, x[1], x[3], x[2]), at(found, x[5], r[0], x[2])
        full = d[0] is not None and z[0] is not None
        want.append((x, p[1] + r[1] + z[1] - d[1], z[0] - d[0], p[2] + r[2] + z[2] - d[2]) if full else (x, None, None, None))
    key = lambda r: (r[0][0], str(r))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[0] for x in got] == [x[0] for x in want] and sum(x[1] is not None for x in want) > 20 < sum(x[1] is None for x in want)
    for a, b in zip(got, want):
        assert a[1:] == ((None,) * 3 if b[1] is None else pytest.approx(b[1:], abs=1e-6))


def test_dynamic_detours_search_no_whole_departures(spark, monkeypatch):
    """Only the legs asked for are kept, not the arrivals of every departure at every place."""
    monkeypatch.setattr(network, "earliest_arrival", None)
    rows = plans.r12(spark, "/root/testdata/sf0.001").agg(F.count(F.lit(1)), F.count("dyn_detour_s")).first()
    assert tuple(rows) == (490, 490)
