from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ridelattice.functions.money import with_fare
from ridelattice.operators import learn, recourse
from ridelattice.plans.data import model, vectors
from ridelattice.sources import readers, validate
from ridelattice.streaming import jobs, run

SF = "/root/testdata/sf0.001"


def test_fare_example(spark):
    one = spark.range(1)
    d = lambda v: F.lit(Decimal(v))
    f = with_fare(one, d("24.5"), d("25"), d("0"), d("1"), d("0")).first()
    assert f.total == Decimal("263.03")
    capped = with_fare(one, d("1"), d("0"), d("0"), d("9"), d("1000")).first()
    assert capped.surged == Decimal("150.00") and capped.total == Decimal("0.00")


def test_bad_journeys(spark):
    good = (31.1, 75.4, 31.3, 75.6, 0, [(31.1, 75.4), (31.3, 75.6)], 1, 4, [])
    rows = [
        (0, *good), (1, 95.0, *good[1:]), (2, *good[:4], None, *good[5:]), (3, *good[:5], [(31.1, 75.4)], *good[6:]),
        (4, *good[:6], 0, *good[7:]), (5, *good[:8], [" "]), (6, 31.1, 75.4, 31.1, 75.4, 0, [(31.1, 75.4), (31.1, 75.4)], 1, 4, []),
        (7, 71.0, 75.4, 71.1, 75.5, 0, [(71.0, 75.4), (71.1, 75.5)], 1, 4, []), (8, *good[:7], -1, [])]
    schema = "id int, o_lat double, o_lon double, d_lat double, d_lon double, departure int, route array<struct<lat:double,lon:double>>, seats int, capacity int, safety_flags array<string>"
    ok, bad = validate.split(spark.createDataFrame(rows, schema))
    assert [r.id for r in ok.collect()] == [0]
    reasons = {r.id: r.reasons for r in bad.collect()}
    assert "coordinate out of range" in reasons[1] and reasons[2] == ["departure missing"]
    assert "route shorter than two points" in reasons[3] and reasons[4] == ["seats below one"]
    assert reasons[5] == ["blank safety flag"] and "start equals destination" in reasons[6]
    assert reasons[7] == ["outside the local domain"] and reasons[8] == ["negative capacity"]


def test_artefacts_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "m string, v int")
    readers.write_artefacts({"metrics": df}, str(tmp_path))
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_artefacts({"metrics": df}, str(tmp_path))


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    assert readers.fingerprint(a).first() == readers.fingerprint(a.orderBy(F.desc("i")).repartition(3)).first()
    assert readers.fingerprint(a).first() != readers.fingerprint(a.limit(1)).first()


def test_graph_reader_fills_defaults(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": {"a": {"latitude": 1.0, "longitude": 2.0}, "b": {"latitude": 1.1, "longitude": 2.0}},\n "edges": [{"u": "a", "v": "b", "distance_km": 2.0}, {"u": "b", "v": "a", "distance_km": 1.0, "duration_seconds": 7.0, "speed_kmh": 30.0}]}')
    nodes, edges = readers.read_road_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2
    assert {(r.u, r.kmh, r.secs) for r in edges.collect()} == {("a", 40.0, 180.0), ("b", 30.0, 7.0)}


def test_dwell_stays_in_bounds(spark):
    u = lambda n: recourse.hashed_uniform(F.lit(n), F.col("id"))
    row = spark.range(5000).select(recourse.dwell_seconds(F.lit("pickup"), u(1), u(2)).alias("d")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("d").alias("m")).first()
    assert 5.0 <= row.lo and row.hi <= 180.0 and row.m == pytest.approx(60.0, rel=0.05)


def test_fit_has_flat_gradient_and_artefact_checks(spark):
    a = model(spark, SF)
    t = vectors(spark, SF).filter("train").withColumn("e", learn.probability(a) - F.col("relevant").cast("double"))
    assert abs(t.agg(F.avg("e")).first()[0]) < 1e-4
    assert learn.load(learn.save(a)) == a
    for broken in ({"features": ["x"]}, {"scales": [0.0] * 7}, {"artefact_version": "other"}, {"weights": [1.0]}, {"fallback": 2}):
        with pytest.raises(ValueError):
            learn.check_artefact({**a, **broken})
    same = vectors(spark, SF).withColumn("relevant", F.lit(True))
    assert learn.fit(same, "relevant")["fallback"] == 1


def test_wallet_rejects_overdraft(spark):
    rows = [(1, 1, "2026-01-01 00:00:01", "CREDIT", "10.00"), (2, 1, "2026-01-01 00:00:02", "DEBIT", "12.00"), (3, 1, "2026-01-01 00:00:03", "DEBIT", "4.00"), (4, 2, "2026-01-01 00:00:04", "DEBIT", "1.00")]
    df = spark.createDataFrame(rows, "tx_id bigint, user_id bigint, ts string, type string, amount string").selectExpr("tx_id", "user_id", "cast(ts as timestamp) ts", "type", "cast(amount as decimal(12,2)) amount")
    src = run.stream(spark, run.write_source(df, 2, "tx_id", in_order=True), df, 1)
    got = {r.tx_id: (r.accepted, r.balance_cents) for r in run.append_all(jobs.guarded_wallet(src), spark).collect()}
    assert got == {1: (True, 1000), 2: (False, 1000), 3: (True, 600), 4: (False, 0)}


def test_late_rows_are_dropped(spark):
    rows = lambda *ts: spark.createDataFrame([(i, 1, t) for i, t in enumerate(ts)], "rider_id bigint, seats int, t string").selectExpr("rider_id", "seats", "cast(t as timestamp) ts")
    first = rows("2026-01-01 00:00:10", "2026-01-01 01:00:00")
    path = run.write_source(first, 1)
    # a late row is judged by the watermark known before the previous batch, hence the batch in between
    rows("2026-01-01 01:00:10").coalesce(1).write.mode("append").parquet(path)
    rows("2026-01-01 00:00:20").coalesce(1).write.mode("append").parquet(path)
    out = jobs.tick_windows(run.stream(spark, path, first, 1)).select(F.col("w.start").alias("tick"), "requests")
    got = {str(r.tick): r.requests for r in run.latest_updates(out, spark, ["tick"]).collect()}
    assert got == {"2026-01-01 00:00:00": 1, "2026-01-01 01:00:00": 2}


def test_congestion_report_by_hand(spark):
    """Two riders: the first changes its choice, the second has none; one pair is unreachable; equal scores go to the smaller id."""
    from ridelattice.operators import evaluate

    rows = [
        ("busy", 1, 10, 50.0, True, 40.0, 100.0, 160.0, 30.0, 50.0, 300.0),
        ("busy", 1, 11, 50.0, True, 60.0, 100.0, 120.0, 30.0, 40.0, 500.0),
        ("busy", 2, 12, 0.0, False, 0.0, None, None, None, None, None),
    ]
    names = ("scenario string, rider_id bigint, driver_id bigint, static_score double, dynamic_feasible boolean, dynamic_score double, static_detour_s double, "
             "dynamic_detour_s double, static_pick_s double, pick_s double, direct_s double")
    got = evaluate.congestion_report(spark.createDataFrame(rows, names)).first().asDict()
    assert got == {
        "scenario": "busy", "pairs": 3, "feasible_pairs": 2, "mean_travel_s": 400.0, "mean_delay_s": 15.0, "mean_eta_error_s": 40.0,
        "top1_change_rate": 0.5, "p1": 0.5, "p3": 0.333, "ndcg3": 0.5, "mean_selected_detour_s": 120.0}
    assert evaluate.congestion_report(spark.createDataFrame([], names)).count() == 0
