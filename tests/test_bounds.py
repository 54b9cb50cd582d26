"""Cases beyond what the shared tables hold: the date line and the poles, long incidents, many zones, large pools, many batches."""

import math
import random

from pyspark.sql import functions as F

from ridelattice.operators import assign, network, pairs, pool
from ridelattice.streaming import jobs, run


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def places():
    rng = random.Random(8)
    near = [(0.0, 179.999), (0.0, -179.999), (10.0, 180.0), (10.0, -180.0), (89.995, 10.0), (89.995, -170.0), (-89.99, 0.0), (-89.99, 120.0), (89.999, 95.0), (60.0, 179.99), (60.001, -179.99)]
    return near + [(rng.choice([0, 45, 88.9, 89.9, -89.95, 70]) + rng.uniform(-0.05, 0.05), rng.choice([180, -180, 0, 90]) + rng.uniform(-0.05, 0.05)) for _ in range(80)]


def wrapped(p):
    return [(max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for a, b in p]


def test_radius_pairs_across_the_date_line_and_the_poles(spark):
    at = wrapped(places())
    r = spark.createDataFrame([(i, "x", a, b, a, b, 0, 1) for i, (a, b) in enumerate(at)], "rider_id bigint, city string, o_lat double, o_lon double, d_lat double, d_lon double, dep_s bigint, seats int")
    v = spark.createDataFrame([(i, "x", a, b, a, b, 0, 4) for i, (a, b) in enumerate(at)], "driver_id bigint, city string, o_lat double, o_lon double, d_lat double, d_lon double, dep_s bigint, capacity int")
    got = [(x["rider_id"], x["driver_id"]) for x in pairs.radius_pairs(r, v, 2.0, 3.0, 30.0).collect()]
    want = {(i, j) for i, p in enumerate(at) for j, q in enumerate(at) if km(*p, *q) <= 2.0}
    assert len(got) == len(set(got)) and set(got) == want and (0, 1) in want and (4, 5) in want


def test_snap_across_the_date_line_and_the_poles(spark):
    at = wrapped(places())
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(at)], "id bigint, lat double, lon double")
    n = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(at) if i % 2], "node bigint, lat double, lon double")
    got = {(r["id"], r["node"]) for r in network.near_nodes(p.select("id", F.col("lat").alias("y"), F.col("lon").alias("x")), n, "id", "y", "x", 5.0).collect()}
    assert got == {(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if j % 2 and km(*a, *b) <= 5.0}


def test_many_zones(spark):
    rng = random.Random(3)
    zones = [(z, 31.0 + rng.uniform(0, 2), 75.0 + rng.uniform(0, 2), rng.uniform(1, 9)) for z in range(600)]
    drivers = [(d, 31.0 + rng.uniform(0, 1), 75.0 + rng.uniform(0, 1)) for d in range(900)] + [(900, -40.0, -100.0)]
    z = spark.createDataFrame(zones, "zone_id bigint, lat double, lon double, base_rate double")
    d = spark.createDataFrame(drivers, "driver_id bigint, d_lat double, d_lon double")
    placed = assign.nearest_zone(d, z, "d_lat", "d_lon", "driver_id").cache()
    home = {r["driver_id"]: r["zone_id"] for r in placed.collect()}
    assert home == {i: min((km(a, b, y, x), k) for k, y, x, _ in zones)[1] for i, a, b in drivers}
    balance = assign.zone_balance(placed, z).select("zone_id", "surplus", "deficit").cache()
    need = {r["zone_id"]: r for r in balance.collect()}
    got = {(r["driver_id"], r["target_zone"]) for r in assign.relocations(placed, balance, "driver_id", "d_lat", "d_lon", z).collect()}
    spare, want = set(), set()
    for k in need:
        spare |= set(sorted(i for i, h in home.items() if h == k)[: need[k]["surplus"]])
    where = {i: (a, b) for i, a, b in drivers}
    for k, y, x, _ in sorted(zones):  # one zone after the other
        near = sorted((km(*where[i], y, x), home[i], i) for i in spare if km(*where[i], y, x) <= 6.0)
        for _, _, i in near[: need[k]["deficit"]]:
            want.add((i, k))
            spare.remove(i)
    assert got == want and len({k for _, k in want}) > 10


def test_legs_of_five_riders(spark):
    riders = [(i, 10 + i, 20 + i, 1) for i in range(5)]
    p = spark.createDataFrame([("p", 1, 6, 5, riders, list(range(1, 11)), 0)], "pool_id string, v_o int, v_d int, k int, riders array<struct<rider_id:bigint,r_o:int,r_d:int,seats:int>>, stops array<int>, order_no int").withColumn("capacity", F.lit(5))
    nodes = [1, 6, *range(10, 15), *range(20, 25)]
    od = spark.createDataFrame([(a, b, float(abs(a - b)), float(abs(a - b))) for a in nodes for b in nodes if a != b], "src int, dst int, km double, s double")
    r = pool.evaluate_stops(pool.with_leg_costs(p, od), {"detour_km": 1e6, "detour_time_s": 1e6}).first()
    tour = [1, 10, 20, 11, 21, 12, 22, 13, 23, 14, 24, 6]
    assert r["km"] == sum(abs(a - b) for a, b in zip(tour, tour[1:])) and r["max_load"] == 1 and r["feasible"]


def test_incidents_of_any_length_alert(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_790_000_000) + F.col(s))
    incidents = [(1, 7, 8, 100, 3 * 3600), (2, 7, 8, 4000, 4060), (3, 9, 9, 50, 50)]
    entries = [(t, 7, 8, 37 * t) for t in range(400)]
    e = spark.createDataFrame(entries, "trip_id bigint, u int, v int, s bigint").select("trip_id", "u", "v", at("s").alias("entry_ts"))
    i = spark.createDataFrame(incidents, "incident_id bigint, u int, v int, a bigint, b bigint").select("incident_id", "u", "v", F.lit(True).alias("closed"), at("a").alias("start_ts"), at("b").alias("end_ts"))
    want = {(t, k) for t, _, _, s in entries for k, _, _, a, b in incidents if a <= s < b and k != 3}
    for n in (1, 6):
        src = lambda df, by: run.stream(spark, run.write_source(df, n, by, in_order=True), df, 1)
        out = run.append_all(jobs.incident_alerts(src(e, "entry_ts"), src(i, "start_ts")), spark)
        assert {(r["trip_id"], r["incident_id"]) for r in out.collect()} == want


def test_payments_do_not_depend_on_batches(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 60), rng.choice("AR"), rng.randint(0, 10**7)) for _ in range(500)]
    p = spark.createDataFrame(rows, "order_id bigint, type string, s bigint").select("order_id", "type", F.timestamp_seconds("s").alias("ts"))
    for n in (1, 5):
        out = jobs.payments_once(run.stream(spark, run.write_source(p, n, "ts", in_order=True), p, 1))
        got = [(r["order_id"], r["type"]) for r in spark.read.option("basePath", out).parquet(f"{out}/b=*").collect()]
        assert len(got) == len(set(got)) and set(got) == {r[:2] for r in rows}


def test_requests_wait_for_a_driver(spark):
    """One driver comes online between two ticks; who is still patient then gets the seat."""
    at = (31.1, 75.4, 31.3, 75.6)
    riders = [(1, "x", 1, True, *at, 0, 600), (2, "x", 1, True, *at, 1, 60), (3, "x", 1, True, *at, 300, 600), (4, "x", 1, True, *at, 301, 600)]
    r = spark.createDataFrame(riders, "rider_id bigint, city string, seats int, identity_ok boolean, o_lat double, o_lon double, d_lat double, d_lon double, dep_s bigint, patience_s bigint")
    v = spark.createDataFrame(
        [(7, "x", 3, True, True, False, *at, 200, 200)],
        "driver_id bigint, city string, capacity int, identity_ok boolean, vehicle_ok boolean, safety_flag boolean, o_lat double, o_lon double, d_lat double, d_lon double, dep_s bigint, online_s bigint")
    path = run.write_source(r.filter("rider_id < 3"), 1, "dep_s", in_order=True)
    r.filter("rider_id >= 3").coalesce(1).write.mode("append").parquet(path)
    out = jobs.dispatch_ticks(run.stream(spark, path, r, 1), v)
    got = sorted((x["b"], x["rider_id"]) for x in spark.read.option("basePath", out).parquet(f"{out}/b=*").collect())
    assert got == [(1, 1), (1, 3), (1, 4)]


def test_a_trip_takes_a_second_later_rider(spark):
    nodes = spark.createDataFrame([(i, 31.0, 75.0 + i / 100) for i in range(8)], "node int, lat double, lon double")
    od = spark.createDataFrame([(a, b, abs(a - b) * 1.0, abs(a - b) * 60.0) for a in range(8) for b in range(8) if a != b], "src int, dst int, km double, s double")
    trips = spark.createDataFrame(
        [(1, 0, 4, 0, 7, [(50, 1, 6, 1)], [1, 2], 0)],
        "driver_id bigint, town int, capacity int, v_o int, v_d int, riders array<struct<rider_id:bigint,r_o:int,r_d:int,seats:int>>, stops array<int>, dep_s bigint")
    asked = [(60, 0, 2, 5, 1, 0), (61, 0, 3, 4, 1, 500)]
    r = spark.createDataFrame(asked, "rider_id bigint, town int, o_node int, d_node int, seats int, dep_s bigint")
    out = jobs.insertion_ticks(run.stream(spark, run.write_source(r, 2, "dep_s", in_order=True), r, 1), trips, nodes, od, {"detour_km": 15.0, "detour_time_s": 900.0}, 8.0)
    got = {(x["b"], x["rider_id"]): x["stops"] for x in spark.read.option("basePath", out).parquet(f"{out}/b=*").collect()}
    assert sorted(got) == [(0, 60), (1, 61)]
    assert sorted(map(int, got[1, 61].split(">"))) == [1, 2, 3, 4, 5, 6]


def test_a_request_waits_for_a_trip(spark):
    """Two requests want the only trip, which takes one a tick; who is still patient gets in at the next tick, the other does not."""
    nodes = spark.createDataFrame([(i, 31.0, 75.0 + i / 100) for i in range(8)], "node int, lat double, lon double")
    od = spark.createDataFrame([(a, b, abs(a - b) * 1.0, abs(a - b) * 60.0) for a in range(8) for b in range(8) if a != b], "src int, dst int, km double, s double")
    trips = spark.createDataFrame(
        [(1, 0, 4, 0, 7, [(50, 1, 6, 1)], [1, 2], 0)],
        "driver_id bigint, town int, capacity int, v_o int, v_d int, riders array<struct<rider_id:bigint,r_o:int,r_d:int,seats:int>>, stops array<int>, dep_s bigint")
    far = 5_000  # too late for the trip: only moves the clock
    asked = [(60, 0, 2, 5, 1, 0, 900), (61, 0, 3, 4, 1, 0, 900), (62, 0, 3, 4, 1, 0, 100), (63, 0, 3, 4, 1, 500, 0), (64, 0, 3, 4, 1, far, 900), (64, 0, 3, 4, 1, far, 900)]
    r = spark.createDataFrame(asked, "rider_id bigint, town int, o_node int, d_node int, seats int, dep_s bigint, patience_s bigint")
    path = None
    for part in ("dep_s = 0", "dep_s = 500", f"dep_s = {far}"):
        rows = r.filter(part).coalesce(1)
        path = path or run.write_source(rows, 1)
        if part != "dep_s = 0":
            rows.write.mode("append").parquet(path)
    out = jobs.insertion_ticks(run.stream(spark, path, r, 1), trips, nodes, od, {"detour_km": 15.0, "detour_time_s": 900.0}, 8.0)
    got = sorted((x["b"], x["rider_id"]) for x in spark.read.option("basePath", out).parquet(f"{out}/b=*").collect())
    riders = [rider for _, rider in got]
    assert len(riders) == len(set(riders)) and [b for b, _ in got] == [0, 1]
    first, second = riders
    assert first in (60, 61, 62) and second in {60, 61, 63} - {first}, "62 had no patience left at the second tick"
