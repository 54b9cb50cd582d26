import random

from ridelattice.operators import assign

SCHEMA = "driver_id bigint, rider_id bigint, score double, seats int, capacity int"


def sequential(edges):
    taken, used, out = set(), {}, set()
    for d, r, s, seats, cap in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if r not in taken and used.get(d, 0) + seats <= cap:
            taken.add(r)
            used[d] = used.get(d, 0) + seats
            out.add((d, r))
    return out


def random_edges(seed, riders, drivers, ties=False):
    rng = random.Random(seed)
    seats = {r: rng.randint(1, 3) for r in range(riders)}
    cap = {d: rng.randint(1, 5) for d in range(drivers)}
    score = lambda: float(rng.randint(1, 4)) if ties else round(rng.random() * 100, 2)
    return [(d, r, score(), seats[r], cap[d]) for d in range(drivers) for r in range(riders) if rng.random() < 0.4]


def test_greedy_equals_sequential(spark):
    for seed, ties in ((1, False), (2, True), (3, True)):
        edges = random_edges(seed, 30, 8, ties)
        got = {(r.driver_id, r.rider_id) for r in assign.greedy_assignment(spark.createDataFrame(edges, SCHEMA)).collect()}
        assert got == sequential(edges)


def test_hot_driver_beyond_one_front(spark):
    """One driver holds most edges: more than a round looks at."""
    rng = random.Random(4)
    edges = [(0, r, round(rng.random() * 100, 2), rng.randint(1, 3), 4) for r in range(300)] + [(1, r, 1.0, 1, 2) for r in range(5)]
    seats = {r: s for _, r, _, s, _ in edges[:300]}
    edges = [(d, r, s, seats[r], c) for d, r, s, _, c in edges]
    got = {(r.driver_id, r.rider_id) for r in assign.greedy_assignment(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert got == sequential(edges)


def test_improvement_keeps_capacity_and_objective(spark):
    edges = random_edges(7, 25, 6)
    df = spark.createDataFrame(edges, SCHEMA)
    start = assign.greedy_assignment(df)
    better = assign.improve_assignment(df, start).collect()
    cap = {d: c for d, _, _, _, c in edges}
    used = {}
    for r in better:
        used[r.driver_id] = used.get(r.driver_id, 0) + r.seats
    assert all(used[d] <= cap[d] for d in used)
    assert len({r.rider_id for r in better}) == len(better)
    assert sum(r.score for r in better) >= sum(r.score for r in start.collect()) - 1e-9


def test_empty_input(spark):
    assert assign.greedy_assignment(spark.createDataFrame([], SCHEMA)).count() == 0
