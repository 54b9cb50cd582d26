"""Queries over candidate pairs: expressions, joins, gates, scores, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelattice.functions import geo
from ridelattice.operators import gates, pairs, rank, routes
from ridelattice.plans import sqltext as q
from ridelattice.plans.registry import query
from ridelattice.sources.fixtures import fixture, with_clause


def standard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.radius_pairs(fixture(spark, sf, "riders"), fixture(spark, sf, "drivers"))


def standard_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs within the limits with features, gates and score."""
    return gates.with_score(gates.with_gates(pairs.pair_features(standard_pairs(spark, sf))))


def eligible_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return standard_scored(spark, sf).filter("eligible")


def top3(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank_eligible(standard_scored(spark, sf), 3).select("rider_id", "driver_id", "score", F.col("rank").cast("bigint").alias("rank"))


def pool_gated(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs.pool_pairs(fixture(spark, sf, "pools"), fixture(spark, sf, "riders"), fixture(spark, sf, "drivers"))
    return gates.with_gates(pairs.pair_features(p, similarity=False))


_POINTS = ("o_lat", "o_lon", "d_lat", "d_lon")


@query("g1_haversine", with_clause("riders") + f" SELECT rider_id, round({q.hav(*_POINTS)}, 6) AS km FROM riders")
def g1(spark, sf):
    return fixture(spark, sf, "riders").select("rider_id", F.round(geo.haversine_km(*map(F.col, _POINTS)), 6).alias("km"))


# three-point driver routes: a vertex beside the straight line
_BEND = ("(o_lat + d_lat)/2e0 + (driver_id % 7 - 3)*0.01e0", "(o_lon + d_lon)/2e0 + (driver_id % 5 - 2)*0.01e0")


def bent_routes(spark: SparkSession, sf: str) -> DataFrame:
    d = fixture(spark, sf, "drivers")
    point = lambda a, b: F.struct(F.expr(a).alias("lat"), F.expr(b).alias("lon"))
    return d.withColumn("route", F.array(point("o_lat", "o_lon"), point(*_BEND), point("d_lat", "d_lon")))


@query("g2_polyline_length", with_clause("drivers") + f""" SELECT driver_id,
  round({q.hav('o_lat', 'o_lon', *_BEND)} + {q.hav(*_BEND, 'd_lat', 'd_lon')}, 6) AS km FROM drivers""")
def g2(spark, sf):
    return bent_routes(spark, sf).select("driver_id", F.round(geo.polyline_km(F.col("route")), 6).alias("km"))


@query("g3_direction_similarity", with_clause("riders", "drivers", "pools") + f""" SELECT r.rider_id, v.driver_id,
  round((1e0 + cos({q.bearing('v.o_lat', 'v.o_lon', 'v.d_lat', 'v.d_lon')} - {q.bearing('r.o_lat', 'r.o_lon', 'r.d_lat', 'r.d_lon')}))/2e0, 6) AS direction_sim
  FROM pools p JOIN riders r USING (rider_id) JOIN drivers v USING (driver_id)""")
def g3(spark, sf):
    p = pairs.pool_pairs(fixture(spark, sf, "pools"), fixture(spark, sf, "riders"), fixture(spark, sf, "drivers"))
    c = F.col
    sim = geo.direction_similarity(
        (c("v_o_lat"), c("v_o_lon")), (c("v_d_lat"), c("v_d_lon")), (c("r_o_lat"), c("r_o_lon")), (c("r_d_lat"), c("r_d_lon")))
    return p.select("rider_id", "driver_id", F.round(sim, 6).alias("direction_sim"))


_A, _B, _C = ("o_lat", "o_lon"), ("m_lat", "m_lon"), ("d_lat", "d_lon")
_P, _Q = ("p_lat", "p_lon"), ("q_lat", "q_lon")


def _ins(a, p, b):
    return f"greatest(0e0, {q.hav(*a, *p)} + {q.hav(*p, *b)} - {q.hav(*a, *b)})"


def _both(a, b):
    return f"greatest(0e0, {q.hav(*a, *_P)} + {q.hav(*_P, *_Q)} + {q.hav(*_Q, *b)} - {q.hav(*a, *b)})"


@query("g4_insertion_detour", with_clause("riders", "drivers", "pools") + f""" SELECT rider_id, driver_id,
  round(least({_both(_A, _B)}, {_both(_B, _C)}, {_ins(_A, _P, _B)} + {_ins(_B, _Q, _C)}), 6) AS detour_km FROM (
   SELECT r.rider_id, v.driver_id, v.o_lat, v.o_lon, v.d_lat, v.d_lon, (v.o_lat + v.d_lat)/2e0 + (v.driver_id % 7 - 3)*0.01e0 AS m_lat,
     (v.o_lon + v.d_lon)/2e0 + (v.driver_id % 5 - 2)*0.01e0 AS m_lon, r.o_lat AS p_lat, r.o_lon AS p_lon, r.d_lat AS q_lat, r.d_lon AS q_lon
   FROM pools p JOIN riders r USING (rider_id) JOIN drivers v USING (driver_id)) t""")
def g4(spark, sf):
    r = pairs.as_requests(fixture(spark, sf, "riders"))
    v = bent_routes(spark, sf).select("driver_id", "route")
    p = fixture(spark, sf, "pools").select("rider_id", "driver_id").join(r, "rider_id").join(v, "driver_id")
    d = geo.insertion_detour(F.col("route"), F.col("r_o_lat"), F.col("r_o_lon"), F.col("r_d_lat"), F.col("r_d_lon"))
    return p.select("rider_id", "driver_id", F.round(d, 6).alias("detour_km"))


@query("g5_route_similarity", with_clause("riders", "drivers") + ", " + q.journeys_join(2, 3, 30) + ", " + q.similarity()
       + " SELECT driver_id, rider_id, round(route_sim, 6) AS route_sim FROM sim")
def g5(spark, sf):
    return pairs.pair_features(standard_pairs(spark, sf)).select("driver_id", "rider_id", F.round("route_sim", 6).alias("route_sim"))


@query("g7_nominal_route", with_clause("riders") + f""" SELECT rider_id, round({q.hav(*_POINTS)}, 4) AS km,
  round({q.hav(*_POINTS)}/40e0*3600e0, 2) AS seconds FROM riders""")
def g7(spark, sf):
    km, s = geo.nominal_route(geo.haversine_km(*map(F.col, _POINTS)))
    return fixture(spark, sf, "riders").select("rider_id", km.alias("km"), s.alias("seconds"))


@query("g8_geometric_detour", with_clause("riders", "drivers") + ", " + q.journeys_join(2, 3, 30) + ", " + q.FEATURES
       + " SELECT driver_id, rider_id, round(detour_km, 6) AS detour_km FROM feat0")
def g8(spark, sf):
    p = standard_pairs(spark, sf)
    c = F.col
    d = geo.geometric_detour((c("v_o_lat"), c("v_o_lon")), (c("v_d_lat"), c("v_d_lon")), (c("r_o_lat"), c("r_o_lon")), (c("r_d_lat"), c("r_d_lon")))
    return p.select("driver_id", "rider_id", F.round(d, 6).alias("detour_km"))


@query("g14_route_hash", with_clause("riders") + """ SELECT rider_id,
  substr(md5(""" + " || '_' || ".join(f"CAST(CAST(round({p}*100e0)/100e0 AS DECIMAL(9,2)) AS VARCHAR)" for p in _POINTS) + """), 1, 12) AS route_hash FROM riders""")
def g14(spark, sf):
    return fixture(spark, sf, "riders").select("rider_id", geo.route_hash(*map(F.col, _POINTS)).alias("route_hash"))


@query("j1_pool_pairs", with_clause("riders", "drivers", "pools") + """ SELECT rider_id, driver_id, r.seats, v.capacity
  FROM pools JOIN riders r USING (rider_id) JOIN drivers v USING (driver_id)""")
def j1(spark, sf):
    p = pairs.pool_pairs(fixture(spark, sf, "pools"), fixture(spark, sf, "riders"), fixture(spark, sf, "drivers"))
    return p.select("rider_id", "driver_id", F.col("r_seats").alias("seats"), F.col("v_capacity").alias("capacity"))


@query("j2_radius_pairs", with_clause("riders", "drivers") + ", " + q.journeys_join(2, 3, 30)
       + " SELECT driver_id, rider_id, round(pickup_km, 6) AS pickup_km, round(dest_km, 6) AS dest_km FROM pairs")
def j2(spark, sf):
    return standard_pairs(spark, sf).select("driver_id", "rider_id", F.round("pickup_km", 6).alias("pickup_km"), F.round("dest_km", 6).alias("dest_km"))


_FEATURE_COLUMNS = ("pickup_km", "dest_km", "route_sim", "direction_sim", "driver_route_km", "detour_km", "dep_diff_min")


@query("j3_pair_features", q.scored() + " SELECT driver_id, rider_id, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURE_COLUMNS) + ", 0e0 AS detour_seconds FROM scored")
def j3(spark, sf):
    f = pairs.pair_features(standard_pairs(spark, sf))
    return f.select("driver_id", "rider_id", *[F.round(c, 6).alias(c) for c in _FEATURE_COLUMNS], "detour_seconds")


_GATE_SQL = with_clause("riders", "drivers") + ", " + q.journeys_join(3, 4.5, 40) + ", " + q.FEATURES + ", " + q.GATED.format(src="feat0")


def wide_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs beyond the limits too, so that every distance gate has failures."""
    p = pairs.radius_pairs(fixture(spark, sf, "riders"), fixture(spark, sf, "drivers"), 3.0, 4.5, 40.0)
    return gates.with_gates(pairs.pair_features(p, similarity=False))


@query("j5_hard_gates", _GATE_SQL + """ SELECT driver_id, rider_id, ok_direction, ok_pickup, ok_dest, ok_departure, ok_detour, ok_identity,
  ok_vehicle, ok_capacity, ok_safety, eligible, concat_ws('; ',
  CASE WHEN NOT ok_direction THEN 'direction incompatibility' END, CASE WHEN NOT ok_pickup THEN 'pickup distance exceeds 2 km' END,
  CASE WHEN NOT ok_dest THEN 'destination distance exceeds 3 km' END, CASE WHEN NOT ok_departure THEN 'departure difference exceeds 30 minutes' END,
  CASE WHEN NOT ok_detour THEN 'detour exceeds 5 km' END, CASE WHEN NOT ok_identity THEN 'identity verification failed' END,
  CASE WHEN NOT ok_vehicle THEN 'vehicle verification failed' END, CASE WHEN NOT ok_capacity THEN 'insufficient vehicle capacity' END,
  CASE WHEN NOT ok_safety THEN 'safety flags present' END) AS reasons FROM gated""")
def j5(spark, sf):
    g = wide_gated(spark, sf)
    return g.select("driver_id", "rider_id", *[flag for flag, _ in gates.REASONS], "eligible", F.array_join("reasons", "; ").alias("reasons"))


@query("j6_weighted_index", q.scored() + " SELECT driver_id, rider_id, score FROM scored")
def j6(spark, sf):
    return standard_scored(spark, sf).select("driver_id", "rider_id", "score")


@query("j7_legacy_compatibility", q.scored() + """ SELECT driver_id, rider_id, eligible AND raw >= 50e0 AS compatible,
  CASE WHEN eligible AND raw >= 50e0 THEN score ELSE 0e0 END AS legacy_score FROM scored""")
def j7(spark, sf):
    return gates.with_legacy_compatibility(standard_scored(spark, sf)).select("driver_id", "rider_id", "compatible", "legacy_score")


@query("j8_explanations", q.scored() + " SELECT driver_id, rider_id, feature, round(value, 6) AS value, round(contribution, 4) AS contribution FROM (" + " UNION ALL ".join(
    f"SELECT driver_id, rider_id, '{n}' AS feature, {n} AS value, "
    + (f"100e0*{w}e0*greatest(0e0, 1e0 - {n}/{gates.LIMITS[n]}e0)" if n in gates.LIMITS else f"100e0*{w}e0*{n}") + " AS contribution FROM scored WHERE eligible"
    for n, w in gates.WEIGHTS.items()) + ") t")
def j8(spark, sf):
    e = gates.explanations(eligible_pairs(spark, sf))
    return e.select("driver_id", "rider_id", "feature", F.round("value", 6).alias("value"), F.round("contribution", 4).alias("contribution"))


@query("j9_rejection_histogram", _GATE_SQL + " SELECT reason, count(*) AS pairs FROM (" + " UNION ALL ".join(
    f"SELECT '{text}' AS reason FROM gated WHERE NOT {flag}" for flag, text in gates.REASONS) + ") t GROUP BY reason")
def j9(spark, sf):
    return gates.reason_histogram(wide_gated(spark, sf))


@query("j9_pipeline_counts", _GATE_SQL + """ SELECT city, count(*) AS retrieved, count(*) FILTER (eligible) AS eligible,
  round(count(*) FILTER (eligible)/CAST(count(*) AS DOUBLE), 6) AS coverage FROM gated GROUP BY city""")
def j9_counts(spark, sf):
    return gates.pipeline_counts(wide_gated(spark, sf))


@query("j9_pool_pipeline_counts", with_clause("riders", "drivers", "pools") + f""", pairs AS (SELECT v.driver_id, r.rider_id, r.city, v.capacity, r.seats,
    v.identity_ok AND r.identity_ok AS ident, v.vehicle_ok, v.safety_flag, v.o_lat AS vo_lat, v.o_lon AS vo_lon, v.d_lat AS vd_lat, v.d_lon AS vd_lon,
    r.o_lat AS ro_lat, r.o_lon AS ro_lon, r.d_lat AS rd_lat, r.d_lon AS rd_lon, abs(v.dep_s - r.dep_s)/60e0 AS dep_diff_min,
    {q.hav('v.o_lat', 'v.o_lon', 'r.o_lat', 'r.o_lon')} AS pickup_km, {q.hav('v.d_lat', 'v.d_lon', 'r.d_lat', 'r.d_lon')} AS dest_km
    FROM pools JOIN riders r USING (rider_id) JOIN drivers v USING (driver_id)), """ + q.FEATURES + ", " + q.GATED.format(src="feat0")
       + """ SELECT city, count(*) AS retrieved, count(*) FILTER (eligible) AS eligible,
  round(count(*) FILTER (eligible)/CAST(count(*) AS DOUBLE), 6) AS coverage FROM gated GROUP BY city""")
def j9_pools(spark, sf):
    return gates.pipeline_counts(pool_gated(spark, sf))


@query("j10_top3_matches", q.scored() + """ SELECT rider_id, driver_id, score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY rider_id ORDER BY score DESC, driver_id) AS rank FROM scored WHERE eligible) t WHERE rank <= 3""")
def j10(spark, sf):
    return top3(spark, sf)


_BASE_SQL = """ SELECT rider_id, driver_id, method, rank FROM (SELECT *, row_number() OVER (PARTITION BY rider_id, method ORDER BY key, driver_id) AS rank FROM (
  SELECT rider_id, driver_id, 'nearest_neighbour' AS method, pickup_km AS key FROM scored WHERE eligible
  UNION ALL SELECT rider_id, driver_id, 'distance_destination', pickup_km + dest_km FROM scored WHERE eligible
  UNION ALL SELECT rider_id, driver_id, 'route_time', -score FROM scored WHERE eligible) a) b WHERE rank <= 3"""


@query("j11_baseline_rankings", q.scored() + _BASE_SQL)
def j11(spark, sf):
    ranked = rank.baseline_rankings(eligible_pairs(spark, sf), 3)
    return ranked.filter("method <> 'seeded_random'").select("rider_id", "driver_id", "method", F.col("rank").cast("bigint").alias("rank"))


@query("j11_random_ranking", q.scored() + f""" SELECT rider_id, driver_id, 'seeded_random' AS method, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY rider_id ORDER BY {q.uniform('7', 'rider_id', 'driver_id')}, driver_id) AS rank FROM scored WHERE eligible) t WHERE rank <= 3""")
def j11_random(spark, sf):
    ranked = rank.baseline_rankings(eligible_pairs(spark, sf), 3)
    return ranked.filter("method = 'seeded_random'").select("rider_id", "driver_id", "method", "rank")


def _ablation_sql() -> str:
    parts = []
    for name in rank.ABLATIONS:
        terms = [
            f"{w!r}e0*" + (f"greatest(0e0, 1e0 - {n}/{gates.LIMITS[n]}e0)" if n in gates.LIMITS else n)
            for n, w in rank.ablation_weights(name).items()
        ]
        parts.append(f"SELECT rider_id, driver_id, '{name}' AS configuration, round({' + '.join(terms)}, 9) AS s FROM scored WHERE eligible")
    return " UNION ALL ".join(parts)


@query("j12_ablated_rankings", q.scored() + f""" SELECT rider_id, driver_id, configuration, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY rider_id, configuration ORDER BY s DESC, driver_id) AS rank FROM ({_ablation_sql()}) a) b WHERE rank <= 3""")
def j12(spark, sf):
    ranked = rank.ablated_rankings(eligible_pairs(spark, sf), 3)
    return ranked.select("rider_id", "driver_id", "configuration", F.col("rank").cast("bigint").alias("rank"))


# bent journeys: drivers have five points, requests four; inner points lie beside the straight line
_POINTS_OF = {"driver_id": 5, "rider_id": 4}


def _vertex(key: str, i: int) -> tuple[str, str]:
    last = _POINTS_OF[key] - 1
    if i in (0, last):
        return ("o_lat", "o_lon") if i == 0 else ("d_lat", "d_lon")
    beside = lambda a: f"(({key}*{a} + {i * 3}) % 9 - 4)*0.003e0"
    return f"o_lat + (d_lat - o_lat)*{i}e0/{last}e0 + {beside(7)}", f"o_lon + (d_lon - o_lon)*{i}e0/{last}e0 + {beside(5)}"


def bent_pairs(spark: SparkSession, sf: str, *limits: float) -> DataFrame:
    """Pairs within the limits, with the routes of both sides."""
    def with_route(name: str, key: str) -> DataFrame:
        points = [F.struct(*[F.expr(e).alias(n) for n, e in zip(("lat", "lon"), _vertex(key, i))]) for i in range(_POINTS_OF[key])]
        return fixture(spark, sf, name).withColumn("route", F.array(*points))

    return pairs.radius_pairs(with_route("riders", "rider_id"), with_route("drivers", "driver_id"), *limits)


def bent_scored(spark: SparkSession, sf: str) -> DataFrame:
    return gates.with_score(gates.with_gates(routes.bent_pair_features(bent_pairs(spark, sf))))


def _vertices_sql(table: str, key: str, out: str) -> str:
    return f"{out} AS (" + " UNION ALL ".join(
        f"SELECT {key}, {i} AS i, {lat} AS lat, {lon} AS lon FROM {table}" for i in range(_POINTS_OF[key]) for lat, lon in [_vertex(key, i)]) + ")"


def _bent_features_sql(pickup: float, dest: float, minutes: float) -> str:
    """Length from vertex rows; the detour tries every ordered pair of legs."""
    return (
        with_clause("riders", "drivers") + ", " + q.journeys_join(pickup, dest, minutes) + ", " + q.FEATURES + ", "
        + _vertices_sql("drivers", "driver_id", "vv") + ", " + _vertices_sql("riders", "rider_id", "rv") + f""",
  vleg AS (SELECT a.driver_id, a.i, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, {q.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS edge
    FROM vv a JOIN vv b ON b.driver_id = a.driver_id AND b.i = a.i + 1),
  vlen AS (SELECT driver_id, sum(edge) AS km FROM vleg GROUP BY driver_id),
  ins AS MATERIALIZED (SELECT p.driver_id, p.rider_id, l.i, greatest(0e0, {q.hav('alat', 'alon', 'ro_lat', 'ro_lon')} + {q.hav('ro_lat', 'ro_lon', 'blat', 'blon')} - edge) AS pick,
    greatest(0e0, {q.hav('alat', 'alon', 'rd_lat', 'rd_lon')} + {q.hav('rd_lat', 'rd_lon', 'blat', 'blon')} - edge) AS leave,
    greatest(0e0, {q.hav('alat', 'alon', 'ro_lat', 'ro_lon')} + {q.hav('ro_lat', 'ro_lon', 'rd_lat', 'rd_lon')} + {q.hav('rd_lat', 'rd_lon', 'blat', 'blon')} - edge) AS same
    FROM pairs p JOIN vleg l USING (driver_id)),
  det AS (SELECT a.driver_id, a.rider_id, min(CASE WHEN a.i = b.i THEN a.same ELSE a.pick + b.leave END) AS km
    FROM ins a JOIN ins b ON a.driver_id = b.driver_id AND a.rider_id = b.rider_id AND b.i >= a.i GROUP BY a.driver_id, a.rider_id),
  bent0 AS (SELECT f.* REPLACE (det.km AS detour_km, vlen.km AS driver_route_km) FROM feat0 f JOIN det USING (driver_id, rider_id) JOIN vlen USING (driver_id))""")


_BENT_SIM_SQL = """
  vbox AS (SELECT driver_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM vv GROUP BY driver_id),
  rbox AS (SELECT rider_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM rv GROUP BY rider_id),
  mid AS (SELECT driver_id, rider_id, (least(a.s, b.s) + greatest(a.n, b.n))/2e0 AS lat0, (least(a.w, b.w) + greatest(a.e, b.e))/2e0 AS lon0
    FROM pairs JOIN vbox a USING (driver_id) JOIN rbox b USING (rider_id)),
  flat AS (SELECT driver_id, rider_id, side, i, 6371.0088e0*radians(lon - lon0)*cos(radians(lat0)) AS x, 6371.0088e0*radians(lat - lat0) AS y FROM (
    SELECT m.*, 'v' AS side, i, lat, lon FROM mid m JOIN vv USING (driver_id) UNION ALL SELECT m.*, 'r', i, lat, lon FROM mid m JOIN rv USING (rider_id)) t),
  leg0 AS (SELECT a.*, b.x AS wx, b.y AS wy, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS len FROM flat a
    JOIN flat b ON a.driver_id = b.driver_id AND a.rider_id = b.rider_id AND a.side = b.side AND b.i = a.i + 1),
  leg1 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY driver_id, rider_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS passed,
    sum(len) OVER (PARTITION BY driver_id, rider_id, side) AS total, max(i) OVER (PARTITION BY driver_id, rider_id, side) AS top FROM leg0),
  leg AS MATERIALIZED (SELECT *, CAST(least(2048, greatest(2, ceil(total/0.1e0) + 1)) AS BIGINT) AS n FROM leg1),
  dots AS (SELECT *, x + (wx - x)*(total*j/(n - 1e0) - passed)/len AS px, y + (wy - y)*(total*j/(n - 1e0) - passed)/len AS py FROM (
    SELECT *, unnest(range(CASE WHEN i = 0 THEN 0 ELSE CAST(floor(passed*(n - 1e0)/total + 1e-9) AS BIGINT) + 1 END,
      CASE WHEN i = top THEN n ELSE CAST(floor((passed + len)*(n - 1e0)/total + 1e-9) AS BIGINT) + 1 END)) AS j FROM leg) t),
  near AS (SELECT driver_id, rider_id, side, j, min(pow(px - x - u*(wx - x), 2) + pow(py - y - u*(wy - y), 2)) AS dd FROM (
    SELECT d.driver_id, d.rider_id, d.side, d.j, px, py, g.x, g.y, g.wx, g.wy,
      greatest(0e0, least(1e0, ((px - g.x)*(g.wx - g.x) + (py - g.y)*(g.wy - g.y))/(g.len*g.len))) AS u
    FROM dots d JOIN leg g ON g.driver_id = d.driver_id AND g.rider_id = d.rider_id AND g.side <> d.side) t GROUP BY driver_id, rider_id, side, j),
  sim AS (SELECT driver_id, rider_id, avg(share) AS route_sim FROM (SELECT driver_id, rider_id, side, avg(CASE WHEN sqrt(dd) <= 0.5e0 + 1e-10 THEN 1e0 ELSE 0e0 END) AS share
    FROM near GROUP BY driver_id, rider_id, side) t GROUP BY driver_id, rider_id)"""

_BENT_SCORED = (
    _bent_features_sql(2, 3, 30) + "," + _BENT_SIM_SQL + ", feat AS (SELECT bent0.*, route_sim FROM bent0 JOIN sim USING (driver_id, rider_id)), "
    + q.GATED.format(src="feat") + f", scored AS (SELECT *, CAST(round(CAST({q.RAW} AS DECIMAL(20,8)), 2) AS DOUBLE) AS score FROM gated)")


@query("j3_bent_features", _BENT_SCORED + " SELECT driver_id, rider_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATURE_COLUMNS) + " FROM scored")
def j3_bent(spark, sf):
    f = routes.bent_pair_features(bent_pairs(spark, sf))
    return f.select("driver_id", "rider_id", *[F.round(c, 6).alias(c) for c in _FEATURE_COLUMNS])


@query("j5_bent_gates", _bent_features_sql(3, 4.5, 40) + ", " + q.GATED.format(src="bent0") + " SELECT driver_id, rider_id, ok_detour, eligible FROM gated")
def j5_bent(spark, sf):
    f = routes.bent_pair_features(bent_pairs(spark, sf, 3.0, 4.5, 40.0), similarity=False)
    return gates.with_gates(f).select("driver_id", "rider_id", "ok_detour", "eligible")


@query("j10_bent_top3", _BENT_SCORED + """ SELECT rider_id, driver_id, score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY rider_id ORDER BY score DESC, driver_id) AS rank FROM scored WHERE eligible) t WHERE rank <= 3""")
def j10_bent(spark, sf):
    best = rank.rank_eligible(bent_scored(spark, sf), 3)
    return best.select("rider_id", "driver_id", "score", F.col("rank").cast("bigint").alias("rank"))
