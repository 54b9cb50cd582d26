import random

import pytest
from pyspark.sql import functions as F

from ridelattice.operators import gates, routes
from ridelattice.operators.pairs import road_features
from tests.test_geometry import hav, insertion, similarity

POINTS = "array<struct<lat:double,lon:double>>"
SCHEMA = (f"rider_id bigint, driver_id bigint, v_route {POINTS}, r_route {POINTS}, v_o_lat double, v_o_lon double, v_d_lat double, v_d_lon double, "
          "r_o_lat double, r_o_lon double, r_d_lat double, r_d_lon double, v_dep_s bigint, r_dep_s bigint, out string")


def frame(spark, pairs):
    rows = []
    for i, (v, r) in enumerate(pairs):
        ends = [(*route[0], *route[-1]) if route else (30.0, 70.0, 30.1, 70.1) for route in (v, r)]
        rows.append((i, 100 + i, v, r, *ends[0], *ends[1], 0, 60, "kept"))
    return spark.createDataFrame(rows, SCHEMA)


def walk(rng, n, at=(31.2, 75.5), step=0.01):
    out = [at]
    for _ in range(n - 1):
        out.append((out[-1][0] + rng.uniform(-step, 2 * step), out[-1][1] + rng.uniform(-step, 2 * step)))
    return out


def test_features_of_many_point_routes(spark):
    rng = random.Random(4)
    pairs = []
    for n, m in ((2, 2), (3, 2), (5, 4), (9, 17), (40, 33), (2, 60)):
        v = walk(rng, n)
        pairs.append((v, walk(rng, m)))
        pairs.append((v, [(a + rng.uniform(-0.004, 0.004), b + rng.uniform(-0.004, 0.004)) for a, b in v]))
        pairs.append((v, v[::-1]))
    got = {r.rider_id: r for r in routes.bent_pair_features(frame(spark, pairs)).collect()}
    assert len(got) == len(pairs)
    for i, (v, r) in enumerate(pairs):
        assert got[i].route_sim == pytest.approx(similarity(v, r), abs=1e-9), i
        assert got[i].driver_route_km == pytest.approx(sum(hav(a, b) for a, b in zip(v, v[1:])))
        assert got[i].detour_km == pytest.approx(insertion(v, r[0], r[-1]), abs=1e-9)
        assert got[i].out == "kept" and got[i].dep_diff_min == 1.0


def test_far_repeated_missing_and_empty_routes(spark):
    line = [(31.0, 75.0), (31.05, 75.05), (31.1, 75.1)]
    far = [(32.0, 76.0), (32.1, 76.1)]
    doubled = [p for p in line for _ in (0, 1)]
    point = [(31.0, 75.0), (31.0, 75.0)]
    pairs = [(line, far), (doubled, line), (None, line), ([], line), (line, point), (line[:1], line)]
    got = {r.rider_id: r for r in routes.bent_pair_features(frame(spark, pairs)).collect()}
    assert got[0].route_sim == 0.0 and got[1].route_sim == 1.0
    straight = similarity([(30.0, 70.0), (30.1, 70.1)], line)
    assert got[2].route_sim == got[3].route_sim == pytest.approx(straight)
    assert got[2].driver_route_km == pytest.approx(hav((30.0, 70.0), (30.1, 70.1)))
    assert got[4].route_sim is None and got[5].route_sim is None
    none = routes.bent_pair_features(frame(spark, pairs).limit(0))
    assert none.count() == 0 and "route_sim" in none.columns
    twice = frame(spark, pairs[1:2]).unionByName(frame(spark, pairs[1:2]))
    assert [r.route_sim for r in routes.with_route_overlap(twice).collect()] == [1.0]


def test_a_bend_decides_a_gate(spark):
    """A driver who goes out of the way past the rider: the straight line fails the detour limit, the route does not."""
    rider = [(31.10, 75.30), (31.15, 75.30)]
    via = [(31.0, 75.0), *rider, (31.2, 75.0)]
    flags = {"v_identity_ok": F.lit(True), "r_identity_ok": F.lit(True), "v_vehicle_ok": F.lit(True), "v_safety_flag": F.lit(False), "v_capacity": F.lit(4), "r_seats": F.lit(1)}
    f = frame(spark, [(via, rider), ([via[0], via[-1]], rider)]).withColumns(flags)
    ok = {r.rider_id: r.ok_detour for r in gates.with_gates(routes.bent_pair_features(f)).collect()}
    assert ok == {0: True, 1: False}


def test_road_features_fall_back_to_the_bent_detour(spark):
    """Without a road route the detour is the insertion on the polyline; with one it is that of the roads."""
    v, r = [(31.0, 75.0), (31.1, 75.1), (31.2, 75.0)], [(31.05, 75.06), (31.1, 75.08)]
    f = routes.bent_pair_features(frame(spark, [(v, r), (v, r)]), similarity=False)
    riders = spark.createDataFrame([(1, 3, 4)], "rider_id bigint, o_node bigint, d_node bigint")
    drivers = spark.createDataFrame([(101, 1, 2)], "driver_id bigint, o_node bigint, d_node bigint")
    od = spark.createDataFrame([(1, 2, 30.0, 1800.0), (1, 3, 10.0, 600.0), (3, 4, 9.0, 500.0), (4, 2, 14.0, 900.0)], "src bigint, dst bigint, km double, s double")
    got = {x.rider_id: x for x in road_features(f, riders, drivers, od).collect()}
    assert got[0].detour_km == pytest.approx(insertion(v, r[0], r[-1])) and got[0].detour_seconds == 0.0
    assert got[1].detour_km == 3.0 and got[1].detour_seconds == 200.0 and got[1].pickup_km == 10.0
