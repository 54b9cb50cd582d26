"""Recourse at arrival time against enumeration in plain Python."""

import random

import pytest

from ridelattice.operators import pool, recourse, replan

LIMITS = {"detour_km": 9.0, "detour_time_s": 900.0}
TRIPS = ("pool_id string, driver_id bigint, v_o bigint, v_d bigint, riders array<struct<rider_id: bigint, r_o: bigint, r_d: bigint, seats: int>>, "
         "k int, capacity int, dep_s bigint, plan array<int>, direct_km double, direct_s double, objective double")
INCIDENTS = "u bigint, v bigint, t_start bigint, t_end bigint, reduction double, closed boolean"


def edge_at(incidents, u, v, t):
    live = [i for i in incidents if i[:2] == (u, v) and i[2] <= t < i[3]]
    return any(i[5] for i in live), max([1.0] + [1.0 + 8.0 * i[4] for i in live if not i[5]])


def arrivals(edges, incidents, start, t):
    """Labels recomputed from all predecessors until nothing changes, as costs may fall with time."""
    labels = {start: (t, 0.0)}
    for _ in range(60):
        new = {start: (t, 0.0)}
        for u, v, km, s in edges:
            if u in labels and v != start:
                closed, factor = edge_at(incidents, u, v, labels[u][0])
                if not closed:
                    got = (labels[u][0] + s * factor, labels[u][1] + km)
                    new[v] = min(new.get(v, got), got)
        if new == labels:
            return labels
        labels = new
    raise AssertionError("not settled")


def worth(trip, km, s, ride):
    k, capacity = trip["k"], trip["capacity"]
    own = 1.0 + 0.5 * (k - 1)
    lk, ls = LIMITS["detour_km"] * own, LIMITS["detour_time_s"] * own
    dk, ds = max(0.0, km - trip["direct_km"]), max(0.0, s - trip["direct_s"])
    if dk > lk or ds > ls:
        return None
    score = 30 * (1 - ds / ls) + 15 * (1 - dk / lk)
    return round(40 * k / capacity + score + 15 * max(0.0, 1 - ride / (ls * 1.5)), 2), round(score, 8)


def driven(trip, order, edges, incidents):
    at, t, km, ride, load = trip["v_o"], float(trip["dep_s"]), 0.0, 0.0, 0
    for stop in [*order, 0]:
        rider = trip["riders"][(stop - 1) // 2] if stop else None
        to = trip["v_d"] if not stop else rider[1] if stop % 2 else rider[2]
        if stop:
            load += rider[3] if stop % 2 else -rider[3]
            if load > trip["capacity"]:
                return None
        there = arrivals(edges, incidents, at, t).get(to)
        if there is None:
            return None
        km += there[1]
        at, t = to, there[0]
        if stop:
            ride += -t if stop % 2 else t
    return worth(trip, km, t - trip["dep_s"], ride / trip["k"])


def case(seed):
    """A grid of two-way streets with rounded costs, incidents that come and go, trips of one to three riders."""
    rng = random.Random(seed)
    edges = []
    for a in range(16):
        for b in ([a + 1] if a % 4 < 3 else []) + ([a + 4] if a < 12 else []):
            for u, v in ((a, b), (b, a)):
                edges.append((u, v, float(rng.randint(1, 3)), float(rng.randint(40, 90))))
    incidents = [(u, v, t, t + rng.randint(100, 900), rng.choice([0.2, 0.6]), rng.random() < 0.4)
                 for u, v, _, _ in rng.sample(edges, 14) for t in [rng.randint(0, 400)]]
    trips, planned = [], []
    for n in range(6):
        k = 1 + n % 3
        o, d, *ends = (rng.randrange(16) for _ in range(2 + 2 * k))
        riders = [(10 * n + i, ends[2 * i], ends[2 * i + 1], 1 + i % 2) for i in range(k)]
        free = arrivals(edges, [], o, 0.0)[d]
        trip = {"pool_id": f"{n}-p", "driver_id": n, "v_o": o, "v_d": d, "riders": riders, "k": k, "capacity": 3, "dep_s": rng.randint(0, 600), "direct_km": free[1], "direct_s": free[0]}
        orders = [(driven(trip, s, edges, []), s) for s in pool.stop_orders(k)]
        good = [(w[0], [-x for x in s]) for w, s in orders if w]
        if not good:
            continue
        trip["objective"], plan = max(good)
        trip["plan"] = [-x for x in plan]
        trips.append(trip)
        points = [o, *[riders[(s - 1) // 2][1 if s % 2 else 2] for s in trip["plan"]], d]
        for leg, (a, b) in enumerate(zip(points, points[1:])):
            planned += [(trip["pool_id"], leg, i + 1, u, v) for i, (u, v) in enumerate(shortest(edges, a, b))]
    return edges, incidents, trips, planned


def shortest(edges, a, b):
    best = {a: (0.0, 0.0, [])}
    for _ in range(20):
        for u, v, km, s in edges:
            if u in best:
                got = (best[u][0] + s, best[u][1] + km, best[u][2] + [(u, v)])
                if v not in best or got[:2] < best[v][:2]:
                    best[v] = got
    return best[b][2]


def realised(trip, planned, edges, incidents):
    cost = {(u, v): (km, s) for u, v, km, s in edges}
    t, km, ride = float(trip["dep_s"]), 0.0, 0.0
    for leg in range(2 * trip["k"] + 1):
        for _, _, _, u, v in sorted(p for p in planned if p[0] == trip["pool_id"] and p[1] == leg):
            closed, factor = edge_at(incidents, u, v, t)
            if closed:
                return None
            t, km = t + cost[u, v][1] * factor, km + cost[u, v][0]
        if leg < 2 * trip["k"]:
            ride += -t if trip["plan"][leg] % 2 else t
    return worth(trip, km, t - trip["dep_s"], ride / trip["k"])


def frames(spark, edges, incidents, trips, planned):
    names = ("pool_id driver_id v_o v_d riders k capacity dep_s plan direct_km direct_s objective").split()
    return (spark.createDataFrame([tuple(t[n] for n in names) for t in trips], TRIPS),
            spark.createDataFrame(planned, "pool_id string, leg int, seq int, u bigint, v bigint"),
            spark.createDataFrame([(*e, "a", "b") for e in edges], "u bigint, v bigint, km double, secs double, u_name string, v_name string"),
            spark.createDataFrame(incidents, INCIDENTS))


@pytest.mark.parametrize("seed", [1])
def test_outcomes_equal_enumeration(spark, seed):
    edges, incidents, trips, planned = case(seed)
    got = {r.pool_id: r for r in replan.replan(*frames(spark, edges, incidents, trips, planned), LIMITS).collect()}
    assert got.keys() == {t["pool_id"] for t in trips}
    moved = 0
    for trip in trips:
        r = got[trip["pool_id"]]
        mine = [(u, v) for p, _, _, u, v in planned if p == trip["pool_id"]]
        met = [i for i in incidents if i[:2] in mine and i[3] > trip["dep_s"]]
        triggered = any(i[2] <= trip["dep_s"] < i[3] for i in met)
        assert r.triggered == triggered
        assert r.severity == ("none" if not met else "severe" if any(i[5] for i in met) else "moderate" if any(i[4] > 0.5 for i in met) else "minor")
        if not met:
            assert r.realised_objective == r.recourse_objective == r.nominal_objective and r.chosen == trip["plan"]
            continue
        was = realised(trip, planned, edges, incidents)
        assert r.realised_feasible == (was is not None)
        assert r.realised_objective == pytest.approx(was[0] if was else 0.0, abs=0.011)
        orders = {tuple(s): driven(trip, s, edges, incidents) for s in pool.stop_orders(trip["k"])}
        good = {s: w for s, w in orders.items() if w}
        chosen = tuple(trip["plan"])
        if triggered and good:
            chosen = min(good, key=lambda s: (-good[s][1], s))
        assert tuple(r.chosen) == chosen
        moved += chosen != tuple(trip["plan"])
        assert r.recourse_feasible == (chosen in good)
        assert r.recourse_objective == pytest.approx(good[chosen][0] if chosen in good else 0.0, abs=0.011)
        if trip["k"] <= 2 and good:
            assert r.best_objective == pytest.approx(max(w[0] for w in good.values()), abs=0.011)
    assert any(t for t in got.values() if t.triggered)


def test_no_trips_and_no_incidents(spark):
    edges, incidents, trips, planned = case(1)
    t, p, e, i = frames(spark, edges, incidents, trips, planned)
    assert replan.replan(t.limit(0), p, e, i, LIMITS).count() == 0
    calm = replan.replan(t, p, e, i.limit(0), LIMITS).collect()
    assert all(r.severity == "none" and r.recourse_objective == r.nominal_objective for r in calm) and len(calm) == len(trips)


def test_long_incident_counts_once_per_edge(spark):
    """An incident of many slices beside a span of two: one row per edge and incident."""
    edge = spark.createDataFrame([("a", 0, 1, 2, 50_000)], "trip_id string, seq int, u bigint, v bigint, dep_s bigint")
    rows = [(1, 2, 0, 200_000, 0.3, False), (1, 2, 71_599, 90_000, 0.6, False), (1, 2, 71_600, 90_000, 0.6, False), (1, 2, 0, 50_000, 0.1, True)]
    got = recourse.edges_under_incidents(edge, spark.createDataFrame(rows, INCIDENTS)).collect()
    assert sorted(r.t_start for r in got) == [0, 71_599]
