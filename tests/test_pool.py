import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ridelattice.operators import network, pool
from ridelattice.plans.fleet import POOL_LIMITS
from ridelattice.sources.fixtures import fixture

SF = "/root/testdata/sf0.001"


def test_order_counts():
    assert [len(pool.stop_orders(k)) for k in (1, 2, 3)] == [1, 6, 90]


@pytest.fixture(scope="module")
def town(spark):
    """Nodes 0..24 with the fixture's street plan, built by hand: the smallest scale has only ten."""
    nodes, edges = [], []
    for k in range(25):
        r, c = divmod(k, 5)
        nodes.append((k, 31.1 + r * 0.1, 75.4 + c * 0.1))
        for step, ok, km, kmh in ((1, c < 4, 9.7, 50.0), (-1, c > 0, 9.7, 50.0), (5, c in (0, 2, 4), 11.3, 30.0), (-5, c in (1, 3), 11.3, 30.0)):
            v = k + step
            if ok and 0 <= v < 25 and ((k in (23, 24)) == (v in (23, 24))):
                edges.append((k, v, km, km / kmh * 3600))
    n = spark.createDataFrame(nodes, "node bigint, lat double, lon double")
    e = spark.createDataFrame(edges, "u bigint, v bigint, km double, secs double")
    od = network.od_costs(e, n.select("node"))
    rows = []
    for d in range(12):
        for j in range(3):
            rows.append((d, 3 + d % 2, (d * 7) % 23, (d * 5 + 11) % 23, d * 10 + j, (d * 3 + j * 4) % 23, (d * 3 + j * 4 + 6) % 23, 1 + (d + j) % 2))
    c = spark.createDataFrame(rows, "driver_id bigint, capacity int, v_o bigint, v_d bigint, rider_id bigint, r_o bigint, r_d bigint, seats int")
    return n, od, c, rows, {(r.src, r.dst): (r.km, r.s) for r in od.collect()}


def brute(rows, od, d):
    mine = [r for r in rows if r[0] == d]
    cap, vo, vd = mine[0][1], mine[0][2], mine[0][3]
    best = 0.0
    for k in (1, 2, 3):
        if k > cap:
            continue
        for subset in itertools.combinations(mine, k):
            stops = [(i, kind) for i in range(k) for kind in ("p", "d")]
            for perm in itertools.permutations(stops):
                if any(perm.index((i, "p")) > perm.index((i, "d")) for i in range(k)):
                    continue
                at, km, s, load, top, picked, ride = vo, 0.0, 0.0, 0, 0, {}, 0.0
                ok = True
                for i, kind in perm:
                    node = subset[i][5] if kind == "p" else subset[i][6]
                    if (at, node) not in od:
                        ok = False
                        break
                    km, s, at = km + od[(at, node)][0], s + od[(at, node)][1], node
                    load += subset[i][7] if kind == "p" else -subset[i][7]
                    top = max(top, load)
                    if kind == "p":
                        picked[i] = s
                    else:
                        ride += s - picked[i]
                if not ok or (at, vd) not in od or (vo, vd) not in od or top > cap:
                    continue
                km, s = km + od[(at, vd)][0], s + od[(at, vd)][1]
                dk, ds = max(0, km - od[(vo, vd)][0]), max(0, s - od[(vo, vd)][1])
                lk, ls = POOL_LIMITS["detour_km"] * (1 + 0.5 * (k - 1)), POOL_LIMITS["detour_time_s"] * (1 + 0.5 * (k - 1))
                if dk <= lk and ds <= ls:
                    best = max(best, round(40 * k / cap + 30 * max(0, 1 - ds / ls) + 15 * max(0, 1 - ride / k / (ls * 1.5)) + 15 * max(0, 1 - dk / lk), 2))
    return best


def test_best_triples_equal_brute_force(spark, town):
    n, od, c, rows, table = town
    e = pool.evaluate_orders(pool.with_leg_costs(pool.pools(c, 3), od), POOL_LIMITS, 3)
    got = {r.driver_id: r.objective for r in pool.best_pools(e, ["driver_id"]).collect()}
    for d in range(12):
        assert got.get(d, 0.0) == pytest.approx(brute(rows, table, d), abs=0.011)


def test_bound_loses_nothing_and_insertion_stays_below(spark, town):
    n, od, c, rows, table = town
    p = pool.pools(c, 3)
    direct = c.select("driver_id", "v_o", "v_d").distinct().join(
        od.select(F.col("src").alias("v_o"), F.col("dst").alias("v_d"), F.col("km").alias("direct_km")), ["v_o", "v_d"]).select("driver_id", "direct_km")
    keep = {r.pool_id: r.admissible for r in pool.admissible(p, n, direct, POOL_LIMITS["detour_km"]).collect()}
    e = pool.evaluate_orders(pool.with_leg_costs(p, od), POOL_LIMITS, 3)
    feasible = {r.pool_id for r in e.filter("feasible").select("pool_id").distinct().collect()}
    assert feasible and all(keep.get(x) for x in feasible)
    best = {r.driver_id: r.objective for r in pool.best_pools(e, ["driver_id"]).collect()}
    for r in pool.insertion_pools(c, od, n, POOL_LIMITS).collect():
        assert 0 < r.objective <= best[r.driver_id] + 0.011
        assert len(r.riders) <= r.capacity


def test_lattice_gives_the_admissible_sets(spark, town):
    n, od, c, rows, table = town
    direct = c.select("driver_id", "v_o", "v_d").distinct().join(
        od.select(F.col("src").alias("v_o"), F.col("dst").alias("v_d"), F.col("km").alias("direct_km")), ["v_o", "v_d"]).select("driver_id", "direct_km")
    for limit in (POOL_LIMITS["detour_km"], 10.0):
        all_ = pool.admissible(pool.pools(c, 3), n, direct, limit)
        want = {r.pool_id for r in all_.filter("admissible").collect()}
        got = [r.pool_id for r in pool.grown_pools(c, n, direct, limit, bound_k=3).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        loose = {r.pool_id for r in pool.grown_pools(c, n, direct, limit).collect()}
        assert loose >= want and loose <= {r.pool_id for r in all_.collect()}


def test_best_orders_inside_the_row_equal_those_of_exploded_rows(spark, town):
    n, od, c, rows, table = town
    costed = pool.with_leg_costs(pool.pools(c, 3), od)
    want = {r.pool_id: (r.order_no, r.objective) for r in pool.best_pools(pool.evaluate_orders(costed, POOL_LIMITS, 3), ["pool_id"]).collect()}
    assert want and {r.pool_id: (r.order_no, r.objective) for r in pool.best_orders(costed, POOL_LIMITS, 3).collect()} == want


def test_packing_equals_taking_one_by_one(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        riders = sorted(rng.sample(range(60), rng.randint(1, 3)))
        rows.append((i % 2, rng.randint(0, 25), f"p{i}", [(r, 0, 0, 1) for r in riders], float(rng.randint(1, 9))))
    df = spark.createDataFrame(rows, "market int, driver_id bigint, pool_id string, riders array<struct<rider_id: bigint, r_o: bigint, r_d: bigint, seats: int>>, objective double")
    used, want = set(), set()
    for m, d, p, riders, o in sorted(rows, key=lambda r: (-r[4], r[2])):
        needs = {(m, "d", d), *[(m, "r", r[0]) for r in riders]}
        if not needs & used:
            used |= needs
            want.add(p)
    got = [r.pool_id for r in pool.packed_pools(df, ["market"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pool.packed_pools(df.limit(0), ["market"]).collect() == []


def inserted(mine, od, where):
    """Riders in the order in which greedy insertion, written out, takes them, and the objective."""
    cap, vo, vd = mine[0][1:4]
    stops, taken, best = [], [], 0.0
    for r in sorted(mine, key=lambda r: (geo_km(where[vo], where[r[5]]), r[4])):
        if len(taken) == cap:
            break
        found, riders = None, {x[4]: x for x in [*taken, r]}
        for i in range(len(stops) + 1):
            for j in range(i, len(stops) + 1):
                way = [*stops[:i], (r[4], 5), *stops[i:j], (r[4], 6), *stops[j:]]
                at, km, s, load, top, ride = vo, 0.0, 0.0, 0, 0, 0.0
                for rider, end in way:
                    leg = od.get((at, riders[rider][end]), (float("inf"),) * 2)
                    km, s, at = km + leg[0], s + leg[1], riders[rider][end]
                    load += riders[rider][7] if end == 5 else -riders[rider][7]
                    top, ride = max(top, load), ride + (s if end == 6 else -s)
                last, direct = od.get((at, vd)), od.get((vo, vd))
                if km == float("inf") or last is None or direct is None or top > cap:
                    continue
                k = len(riders)
                dk, ds, stretch = max(0, km + last[0] - direct[0]), max(0, s + last[1] - direct[1]), 1 + 0.5 * (k - 1)
                lk, ls = POOL_LIMITS["detour_km"] * stretch, POOL_LIMITS["detour_time_s"] * stretch
                score = round(40 * k / cap + 30 * (1 - ds / ls) + 15 * max(0, 1 - ride / k / (ls * 1.5)) + 15 * (1 - dk / lk), 2)
                if dk <= lk and ds <= ls and (found is None or score > found[0] + 0.005):
                    found = (score, way)
        if found and found[0] > 0:
            best, stops = found
            taken.append(r)
    return [r[4] for r in taken], best


def geo_km(a, b):
    (a, b), (c, d) = a, b
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_insertion_takes_riders_by_distance_from_more_than_there_are_seats(spark, town):
    n, od, c, rows, table = town
    rng = random.Random(4)
    many = [(d, 1 + d % 4, (d * 7) % 23, (d * 5 + 11) % 23, d * 100 + j, (o := rng.randrange(23)), (o + rng.randrange(1, 23)) % 23, 1 + j % 2) for d in range(10) for j in range(7)]
    where = {r.node: (r.lat, r.lon) for r in n.collect()}
    df = spark.createDataFrame(many, "driver_id bigint, capacity int, v_o bigint, v_d bigint, rider_id bigint, r_o bigint, r_d bigint, seats int")
    got = {r.driver_id: ([x.rider_id for x in r.riders], r.objective) for r in pool.insertion_pools(df, od, n, POOL_LIMITS).collect()}
    for d in range(10):
        riders, objective = inserted([r for r in many if r[0] == d], table, where)
        if riders:
            assert got[d][0] == riders and got[d][1] == pytest.approx(objective, abs=0.011)
        else:
            assert d not in got
    assert max(len(r) for r, _ in got.values()) > 1


def test_cohorts_never_exceed_seats(spark):
    c = fixture(spark, SF, "cohorts").groupBy("driver_id", "capacity").agg(F.sum("seats").alias("s"))
    assert c.filter("s > capacity").count() == 0


def test_packing_keeps_its_rounds_compressed(spark, monkeypatch):
    """Pools taken one by one; a repeated row is taken with its like, and sets are kept in compressed files."""
    monkeypatch.setattr(pool, "cut_lineage", None)
    rng = random.Random(6)
    rows = [(c, d, f"{d}-{'+'.join(map(str, r))}", [(x,) for x in r], float(rng.randint(1, 6))) for c in (1, 2) for d in range(12) for r in {tuple(sorted(rng.sample(range(15), rng.randint(1, 3)))) for _ in range(6)}]
    want = set()
    for c in (1, 2):
        used = set()
        for x in sorted((x for x in rows if x[0] == c), key=lambda x: (-x[4], x[2])):
            needs = {("d", x[1])} | {("r", r[0]) for r in x[3]}
            if not needs & used:
                used |= needs
                want.add((c, x[2]))
    df = spark.createDataFrame(rows + rows[:20], "capacity int, driver_id bigint, pool_id string, riders array<struct<rider_id: bigint>>, objective double")
    got = [(r.capacity, r.pool_id) for r in pool.packed_pools(df, ["capacity"]).collect()]
    assert set(got) == want and len(got) == len(want) + sum((x[0], x[2]) in want for x in rows[:20])
