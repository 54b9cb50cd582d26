import heapq
import random

import pytest
from pyspark.sql import functions as F

from ridelattice.operators import network
from ridelattice.plans import network as plans


def random_graph(seed, n=14, m=40):
    rng = random.Random(seed)
    edges = {}
    for _ in range(m):
        u, v = rng.randrange(n), rng.randrange(n)
        if u != v:
            edges[(u, v)] = (round(rng.uniform(1, 9), 3), rng.uniform(20, 400))
    return n, [(u, v, km, s) for (u, v), (km, s) in edges.items()]


def dijkstra(n, edges, src):
    adj = {}
    for u, v, km, s in edges:
        adj.setdefault(u, []).append((v, km, s))
    best, heap = {}, [(0.0, 0.0, src)]
    while heap:
        s, km, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = (km, s)
        for v, k, t in adj.get(u, []):
            if v not in best:
                heapq.heappush(heap, (s + t, km + k, v))
    return best


def test_costs_and_paths_on_random_graphs(spark):
    for seed in (1, 2):
        n, edges = random_graph(seed)
        e = spark.createDataFrame(edges, "u bigint, v bigint, km double, secs double")
        nodes = spark.range(n).select(F.col("id").alias("node"))
        od = network.od_costs(e, nodes)
        got = {(r.src, r.dst): (r.km, r.s) for r in od.collect()}
        want = {(s, d): c for s in range(n) for d, c in dijkstra(n, edges, s).items()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=0.01)
        cost = {(u, v): s for u, v, _, s in edges}
        for r in network.od_paths(od).collect():
            assert r.path[0] == r.src and r.path[-1] == r.dst
            assert sum(cost[(a, b)] for a, b in zip(r.path, r.path[1:])) == pytest.approx(got[(r.src, r.dst)][1], abs=0.01)


def test_max_cost_keeps_what_is_within(spark):
    n, edges = random_graph(3)
    e = spark.createDataFrame(edges, "u bigint, v bigint, km double, secs double")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    full = {(r.src, r.dst) for r in network.od_costs(e, nodes).filter("s <= 300").collect()}
    assert {(r.src, r.dst) for r in network.od_costs(e, nodes, max_cost=300.0).collect()} == full


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (8, 7), (9, 8), (7, 4)], "u bigint, v bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node bigint")
    got = {r.node: r.component for r in network.components(nodes, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 7: 4, 8: 4, 9: 4, 5: 5, 6: 5, 10: 10}


def label_setting(edges, incidents, src, depart):
    """Expand each node once at its earliest label."""
    adj = {}
    for u, v, km, s in edges:
        adj.setdefault(u, []).append((v, s))
    done, heap = {}, [(float(depart), src)]
    while heap:
        t, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = t
        for v, s in adj.get(u, []):
            live = [i for i in incidents if i[0] == u and i[1] == v and i[2] <= t < i[3]]
            if any(i[5] for i in live) or v in done:
                continue
            heapq.heappush(heap, (t + s * max([1.0] + [1 + 8 * i[4] for i in live]), v))
    return done


def test_arrival_with_incidents_that_end(spark):
    for seed in (4, 5):
        n, edges = random_graph(seed, 10, 26)
        rng = random.Random(seed)
        incidents = []
        for u, v, _, _ in rng.sample(edges, 8):
            a = rng.randrange(0, 400)
            incidents.append((u, v, a, a + rng.randrange(60, 500), round(rng.random(), 2), rng.random() < 0.4))
        e = spark.createDataFrame([(u, v, km, s, "x", "y") for u, v, km, s in edges], "u bigint, v bigint, km double, secs double, u_name string, v_name string")
        i = spark.createDataFrame(incidents, "u bigint, v bigint, t_start bigint, t_end bigint, reduction double, closed boolean")
        starts = spark.createDataFrame([(s, float(t)) for s in range(n) for t in (0, 150)], "node bigint, depart_s double")
        got = {(r.src, r.depart_s, r.dst): r.arrive_s for r in network.earliest_arrival(e, starts, incidents=i).collect()}
        want = {(s, float(t), d): a for s in range(n) for t in (0, 150) for d, a in label_setting(edges, incidents, s, t).items()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_build_edges_defaults(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.01)], "node bigint, lat double, lon double")
    links = spark.createDataFrame([(1, 2, None, None, False), (2, 1, 2.0, 60.0, True), (1, 2, -1.0, 30.0, True)], "u bigint, v bigint, km double, kmh double, oneway boolean")
    rows = sorted((r.u, r.v, round(r.km, 3), r.kmh, round(r.secs, 2)) for r in network.build_edges(links, nodes).collect())
    assert rows == [(1, 2, 1.112, 40.0, 100.08), (2, 1, 1.112, 40.0, 100.08), (2, 1, 2.0, 60.0, 120.0)]


def test_ranked_element(spark):
    rng = random.Random(1)
    v = [round(rng.random(), 4) for _ in range(137)] + [0.5] * 40
    df = spark.createDataFrame([("a", x) for x in v], "k string, v double")
    got = network.ranked_element(df, ["k"], "v", 0.95, 0.01, "p").first()
    assert got.p == sorted(v)[int(len(v) * 0.95)] and got.n == len(v)


def test_dynamic_detours_cover_every_road_pair(spark):
    sf = "/root/testdata/sf0.001"
    pairs = {(r["driver_id"], r["rider_id"]) for r in plans.road_batch(spark, sf).select("driver_id", "rider_id").collect()}
    rows = plans.r12(spark, sf).collect()
    assert len(rows) == len(pairs) > 0 and {(r["driver_id"], r["rider_id"]) for r in rows} == pairs
