"""Hot keys: split results equal the plain ones."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridelattice.operators import evaluate, pairs, running
from ridelattice.sources.fixtures import fixture

SF = "/root/testdata/sf0.001"


def test_salted_cells_keep_every_pair(spark):
    r, d = fixture(spark, SF, "riders"), fixture(spark, SF, "drivers")
    # a third of the requests start at one spot
    r = r.withColumns({c: F.when(F.col("rider_id") % 3 == 0, v).otherwise(F.col(c)) for c, v in (("o_lat", 31.2), ("o_lon", 75.5))})
    plain = pairs.radius_pairs(r, d, hot_rows=10**9).select("rider_id", "driver_id")
    split = pairs.radius_pairs(r, d, hot_rows=20).select("rider_id", "driver_id")
    want = r.alias("r").join(d.alias("v"), "city").filter(
        (F.abs(F.col("r.dep_s") - F.col("v.dep_s")) <= 1800)).select("rider_id", "driver_id", *[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "rv" for c in ("o_lat", "o_lon", "d_lat", "d_lon")])
    from ridelattice.functions.geo import haversine_km
    h = lambda e: haversine_km(*[F.col(x) for x in (f"v_{e}_lat", f"v_{e}_lon", f"r_{e}_lat", f"r_{e}_lon")])
    want = want.filter((h("o") <= 2.0) & (h("d") <= 3.0)).select("rider_id", "driver_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(want) == rows(plain) == rows(split)
    assert len(rows(plain)) > 0


def test_cells_crowded_with_drivers_become_blocks(spark):
    """A third of both sides, then of the drivers alone, stands at one spot."""
    at = lambda df, key: df.withColumns({c: F.when(F.col(key) % 3 == 0, v).otherwise(F.col(c)) for c, v in (("o_lat", 31.2), ("o_lon", 75.5))})
    r, d = fixture(spark, SF, "riders"), at(fixture(spark, SF, "drivers"), "driver_id")
    rows = lambda df: sorted(map(tuple, df.select("rider_id", "driver_id").collect()))
    for riders in (at(r, "rider_id"), r):
        plain = rows(pairs.radius_pairs(riders, d, hot_rows=10**9))
        assert plain == rows(pairs.radius_pairs(riders, d, hot_rows=5)) and plain


def test_blocks_are_small_and_every_pair_meets_once(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(2000).select(F.col("id").alias("b"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = right.unionByName(spark.range(100).select((F.col("id") + 5000).alias("b"), F.lit(None).cast("bigint").alias("k")))
    x, y = pairs.split_into_blocks(left, right, ["k"], F.col("a"), F.col("b"), 100)
    largest = lambda df: df.groupBy("k", "_salt").count().filter("k IS NOT NULL").agg(F.max("count")).first()[0]
    assert largest(x) < 200 and largest(y) < 200
    got = x.join(y, ["k", "_salt"]).agg(F.count(F.lit(1)), F.countDistinct("a", "b")).first()
    want = left.join(right, "k").count()
    assert tuple(got) == (want, want)


def test_running_values_across_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.randrange(1000), rng.randrange(10)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id int, t int, v int")
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    got = {r.id: r.s for r in running.running_sum(df, ["k"], F.floor(F.col("t") / 50), ["t", "id"], {"s": F.col("v")}).collect()}
    assert got == want
    span = Window.partitionBy("k").orderBy("t").rangeBetween(-120, 0)
    want = {r.id: r.n for r in df.withColumn("n", F.count(F.lit(1)).over(span)).collect()}
    got = {r.id: r.n for r in running.trailing_count(df, ["k"], F.col("t"), 120, 200).collect()}
    assert got == want


def test_inversions_and_spearman_without_pairs(spark):
    rng = random.Random(3)
    rows = [(qid, i, round(rng.choice([0.0, rng.random() * 100]), 2), round(rng.random() * 100, 2)) for qid in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "rider_id int, driver_id int, a double, b double")
    got = {r.rider_id: (r.inverted, r.comparable) for r in evaluate.inversions(df, "rider_id", "a", "b").collect()}
    rho = {r.rider_id: r.rho for r in evaluate.spearman(df, "rider_id", "a", "b").collect()}
    for qid in (1, 2):
        mine = [r for r in rows if r[0] == qid]
        inv = cmp = 0
        for i, x in enumerate(mine):
            for y in mine[i + 1:]:
                if x[2] != y[2] and x[3] != y[3]:
                    cmp += 1
                    inv += (x[2] > y[2]) != (x[3] > y[3])
        assert got[qid] == (inv, cmp)
        rank = lambda j: {r[1]: n for n, r in enumerate(sorted(mine, key=lambda r: (-r[j], r[1])))}
        ra, rb = rank(2), rank(3)
        n = len(mine)
        assert abs(rho[qid] - (1 - 6 * sum((ra[i] - rb[i]) ** 2 for i in ra) / (n * (n * n - 1)))) < 1e-9
