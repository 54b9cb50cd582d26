"""Jobs that shuffle journeys, drivers or riders and not their pairs, against the plain ways."""

import random

from pyspark.sql import functions as F

from ridelattice.operators import evaluate, journeys, network, pairs, pool
from ridelattice.streaming import run
from tests.test_pool import town  # noqa: F401

rows_of = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_a_source_of_many_files_is_read_a_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x: int) -> int:
        seen.add(1)
        return x

    df = spark.createDataFrame([(i * 7 % 200,) for i in range(200)], "n bigint").select(F.udf(count, "bigint")("n").alias("n"))
    path = run.write_source(df, 12, "n", in_order=True)
    assert seen.value <= 5 * 200  # once per file before
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("n").alias("c")).orderBy("lo").collect()
    assert len(files) > 8 and sum(f.c for f in files) == 200 and all(a.hi < b.lo for a, b in zip(files, files[1:]))


def test_road_legs_before_the_pairs_meet(spark):
    """The rows of the radius join with a leg joined after the other; a node in two rows, another without any road."""
    rng = random.Random(6)
    at = [(i, 31.0 + rng.random() * 0.2, 75.0 + rng.random() * 0.2) for i in range(20)]
    nodes = spark.createDataFrame([*at, at[3], (99, 31.1, 75.1)], "node bigint, lat double, lon double")
    od = spark.createDataFrame([(a, b, float(a + b), float(a * b)) for a in range(20) for b in range(20) if rng.random() < 0.8], "src bigint, dst bigint, km double, s double")

    def journeys_of(key, n):
        pick = lambda: rng.choice([*range(20), 99])
        df = spark.createDataFrame([(i, i % 2, pick(), pick(), rng.randrange(4000)) for i in range(n)], f"{key} bigint, town int, o_node bigint, d_node bigint, dep_s bigint")
        place = lambda e: nodes.select(F.col("node").alias(f"{e}_node"), F.col("lat").alias(f"{e}_lat"), F.col("lon").alias(f"{e}_lon"))
        return df.join(place("o"), "o_node").join(place("d"), "d_node")

    r, v = journeys_of("rider_id", 120), journeys_of("driver_id", 40)
    want = pairs.radius_pairs(r, v, 9.0, 9.0, 20.0, by=("town",))
    want = network.with_road_detour(want, od, "v_o_node", "v_d_node", "r_o_node", "r_d_node")
    cols = ["rider_id", "driver_id", "pickup_km", "dest_km", "direct_km", "pick_s", "ride_km", "last_s", "detour_km", "detour_s"]
    for hot in (20_000, 1):
        got = network.with_leg_detour(journeys.road_pairs(r, v, od, 9.0, 9.0, 20.0, hot_rows=hot))
        assert rows_of(got.select(cols)) == rows_of(want.select(cols)) and got.count() > 50


def scored(spark, n=400):
    rng = random.Random(9)
    rows = [(i % 7, i, rng.random() < 0.5, rng.choice([0.0, *range(9)]) * 1.0, rng.choice([0.0, *range(9)]) * 1.0, rng.random() < 0.6, rng.randrange(4), rng.random() < 0.9, rng.random() * 20) for i in range(n)]
    names = "rider_id bigint, driver_id bigint, feasible boolean, score double, other double, keep_x boolean, relevance int, reachable boolean, detour_km double"
    return spark.createDataFrame(rows, names).withColumns({"keep_all": F.lit(True), "detour_s": F.col("detour_km") * 9, "road_pickup_km": F.col("detour_km") / 4}).localCheckpoint()


def test_large_queries_give_what_small_ones_give(spark):
    """Thresholds of no rows send every query the way of the large ones."""
    df = scored(spark)
    for job in (
        lambda **k: evaluate.pruning_report(df, ["all", "x"], **k), lambda **k: evaluate.graded_metrics(df, ["score", "other"], **k),
        lambda **k: evaluate.inversions(df, "rider_id", "score", "other", **k), lambda **k: evaluate.spearman(df, "rider_id", "score", "other", **k),
    ):
        assert rows_of(job()) == rows_of(job(most=0))


def test_legs_of_drivers_with_many_places(spark, town, monkeypatch):  # noqa: F811
    n, od, c, rows, _ = town
    sets = pool.pools(c, 3)
    limits = {"detour_km": 40.0, "detour_time_s": 4500.0}
    best = lambda: rows_of(pool.best_orders(pool.with_leg_costs(sets, od, pool.driver_places(c)), limits).select("pool_id", "order_no", "objective", "km"))
    want = best()
    monkeypatch.setattr(pool, "MOST_PLACES", 6)
    assert best() == want and want


def test_valid_orders_by_hand(spark):
    """Two riders of two seats in three seats never ride together; one each may."""
    sets = [("a", 3, [(1, 0, 0, 2), (2, 0, 0, 2)]), ("b", 2, [(1, 0, 0, 1), (2, 0, 0, 1)]), ("c", 1, [(1, 0, 0, 2)])]
    p = spark.createDataFrame(sets, "pool_id string, capacity int, riders array<struct<rider_id: bigint, r_o: bigint, r_d: bigint, seats: int>>")
    assert {r.pool_id: r.valid_orders for r in pool.valid_orders(p).collect()} == {"a": 2, "b": 6, "c": 0}
