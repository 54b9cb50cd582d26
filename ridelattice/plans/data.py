"""Sources, validation, generators and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.functions import geo
from ridelattice.operators import evaluate, learn
from ridelattice.plans import sqltext as q
from ridelattice.plans.evaluation import _REL, labelled
from ridelattice.plans.matching import _BEND, bent_routes
from ridelattice.plans.network import once
from ridelattice.plans.registry import query
from ridelattice.sources import readers, synthetic, validate
from ridelattice.sources.fixtures import fixture, table, with_clause

CLOCK = "2026-10-08 08:00:00"


@query("s1_read_journeys", with_clause("riders", "drivers") + """ SELECT CAST(rider_id AS VARCHAR) AS journey_id, 'rider' AS role, o_lat, o_lon, d_lat, d_lon, 0 AS capacity, seats, identity_ok, false AS safety_flag, dep_s FROM riders
  UNION ALL SELECT CAST(driver_id AS VARCHAR), 'driver', o_lat, o_lon, d_lat, d_lon, capacity, 1, identity_ok, safety_flag, dep_s FROM drivers""")
def s1(spark, sf):
    path = readers.scratch(spark, "journeys")
    f = F.lit(False)
    readers.journey_json(fixture(spark, sf, "riders"), "rider", "rider_id", F.lit(0), f, f, F.col("seats"), CLOCK).write.text(f"{path}/riders")
    readers.journey_json(fixture(spark, sf, "drivers"), "driver", "driver_id", F.col("capacity"), F.col("vehicle_ok"), F.col("safety_flag"), F.lit(1), CLOCK).write.text(f"{path}/drivers")
    j = readers.flat_journeys(readers.read_journeys(spark, f"{path}/*"))
    dep = F.unix_timestamp("departure") - F.unix_timestamp(F.to_timestamp(F.lit(CLOCK)))
    return j.select("journey_id", "role", "o_lat", "o_lon", "d_lat", "d_lon", "capacity", "seats", "identity_ok", "safety_flag", dep.alias("dep_s"))


@query("s2_read_road_graph", with_clause("nodes", "edges") + """ SELECT 'node' AS kind, CAST(node AS VARCHAR) AS a, '' AS b, lat AS x, lon AS y, 0e0 AS secs FROM nodes
  UNION ALL SELECT 'edge', CAST(u AS VARCHAR), CAST(v AS VARCHAR), km, coalesce(CASE WHEN kmh = 50e0 THEN kmh END, 40e0), round(km/CASE WHEN kmh = 50e0 THEN 50e0 ELSE 40e0 END*3600e0, 4) FROM edges""")
def s2(spark, sf):
    n, e = fixture(spark, sf, "nodes"), fixture(spark, sf, "edges")
    # one document per town: 25 nodes and at most 100 edges each
    nd = n.groupBy("town").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node").cast("string"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))))).alias("nodes"))
    # slow links leave out their speed, and no link gives a duration: the reader fills both
    link = F.struct(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.col("km").alias("distance_km"), F.when(F.col("kmh") == 50, F.col("kmh")).alias("speed_kmh"))
    ed = e.groupBy(F.floor(F.col("u") / 25).alias("town")).agg(F.collect_list(link).alias("edges"))
    path = readers.scratch(spark, "graph")
    nd.join(ed, "town", "left").select(F.to_json(F.struct("nodes", "edges")).alias("value")).write.text(path)
    nodes, edges = readers.read_road_graph(spark, path, multi_line=False)
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit("").alias("b"), F.col("lat").alias("x"), F.col("lon").alias("y"), F.lit(0.0).alias("secs")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("km").alias("x"), F.col("kmh").alias("y"), F.round("secs", 4).alias("secs")))


@query("s3_read_trip_list", with_clause("riders", "drivers") + """ SELECT 'rider' AS role, CAST(rider_id AS VARCHAR) AS id, o_lat, o_lon, d_lat, d_lon FROM riders UNION ALL SELECT 'driver', CAST(driver_id AS VARCHAR), o_lat, o_lon, d_lat, d_lon FROM drivers""")
def s3(spark, sf):
    def trips(name, key, out):
        t = fixture(spark, sf, name)
        point = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
        one = F.struct(F.col(key).cast("string").alias("id"), point("o_lat", "o_lon").alias("start"), point("d_lat", "d_lon").alias("destination"))
        # documents of at most 50 trips
        return t.groupBy(F.floor(F.col(key) / 50).alias("doc")).agg(F.collect_list(one).alias(out))

    path = readers.scratch(spark, "trips")
    docs = trips("riders", "rider_id", "riders").join(trips("drivers", "driver_id", "drivers"), "doc", "full")
    docs.select(F.to_json(F.struct("drivers", "riders")).alias("value")).write.text(path)
    return readers.read_trip_list(spark, path, multi_line=False).select("role", "id", "o_lat", "o_lon", "d_lat", "d_lon")


@query("s4_read_scenarios", with_clause("bookings") + """ SELECT CAST(booking_id AS VARCHAR) AS id, CASE WHEN booking_id % 3 = 0 THEN 0e0 ELSE CAST(distance_km AS DOUBLE) END AS distance_km, CAST(duration_min AS DOUBLE) AS duration_min, '' AS description, 0 AS drivers FROM bookings""")
def s4(spark, sf):
    b = fixture(spark, sf, "bookings")
    doc = F.struct(F.col("booking_id").cast("string").alias("id"), F.col("duration_min"), F.when(F.col("booking_id") % 3 != 0, F.col("distance_km").cast("double")).alias("distance_km"))
    path = readers.scratch(spark, "scenarios")
    b.select(doc.alias("d")).select("d.*").write.json(path)
    s = readers.read_scenarios(spark, path, multi_line=False)
    return s.select("id", "distance_km", "duration_min", "description", F.size("available_drivers").alias("drivers"))


@query("s5_run_artefacts", with_clause("bookings") + " SELECT status, count(*) AS bookings FROM bookings GROUP BY status")
def s5(spark, sf):
    counts = fixture(spark, sf, "bookings").groupBy("status").agg(F.count(F.lit(1)).alias("bookings"))
    path = readers.scratch(spark, "run")
    readers.write_artefacts({"metrics": counts}, path)
    return spark.read.option("header", True).schema("status string, bookings bigint").csv(f"{path}/metrics")


def _print_sql(name: str, columns: str) -> str:
    """Columns of a table in order of their names; those with a dot in front are fractions."""
    text = lambda c: f"coalesce(printf('%.6f', {c[1:]}), '\\N')" if c[0] == "." else f"coalesce(CAST({c} AS VARCHAR), '\\N')"
    row = "concat_ws('|', " + ", ".join(text(c) for c in columns.split()) + ")"
    return (f"SELECT '{name}' AS dataset, 'standard limits' AS config, '42' AS seeds, n AS rows, sha256(n || ':' || h) AS sha256 FROM (SELECT count(*) AS n, "
            f"coalesce(sum(CAST(CAST('0x' || substr(sha256({row}), 1, 15) AS BIGINT) AS HUGEINT)), 0) AS h FROM {name}) t")


@query("s6_run_manifest", with_clause("riders", "drivers", "nodes", "edges") + " " + " UNION ALL ".join(_print_sql(*t) for t in (
    ("riders", "city .d_lat .d_lon dep_s identity_ok .o_lat .o_lon rider_id seats"),
    ("drivers", "capacity city .d_lat .d_lon dep_s driver_id identity_ok .o_lat .o_lon safety_flag vehicle_ok"),
    ("nodes", "c k .lat .lon name node r town"), ("edges", ".km .kmh .secs u u_name v v_name"))))
def s6(spark, sf):
    return readers.manifest({n: fixture(spark, sf, n) for n in ("riders", "drivers", "nodes", "edges")}, "standard limits", "42")


@query("s7_json_columns", "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k, props AS raw FROM events")
def s7(spark, sf):
    e = readers.with_json(table(spark, sf, "events"), "props", "k bigint", "decoded")
    return e.select("event_id", F.col("decoded.k").alias("k"), F.col("props").alias("raw"))


@query("s8_corridor_dataset", with_clause("riders") + f""", req AS (SELECT rider_id AS request_id, CASE rider_id % 3 WHEN 0 THEN 'thin' WHEN 1 THEN 'balanced' ELSE 'dense' END AS scenario, CASE rider_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 12 ELSE 24 END AS n FROM riders),
  c AS (SELECT request_id, scenario, slot, (request_id + slot) % 12 AS mode FROM (SELECT *, unnest(range(n)) AS slot FROM req) t),
  d AS (SELECT *, CASE WHEN mode = 7 THEN 4e0 ELSE (-1.2e0 + (1.2e0 - (-1.2e0))*{q.uniform('11', "'y0'", 'request_id', 'slot')}) END AS y0, CASE WHEN mode = 7 THEN 4e0 ELSE (-1.5e0 + (1.5e0 - (-1.5e0))*{q.uniform('11', "'y1'", 'request_id', 'slot')}) END AS y1,
    CASE WHEN mode = 8 THEN 75e0 ELSE (-25e0 + (25e0 - (-25e0))*{q.uniform('11', "'t'", 'request_id', 'slot')}) END AS minutes, (0.35e0 + (2.5e0 - (0.35e0))*{q.uniform('11', "'dt'", 'request_id')}) AS dt, (5e0 + (35e0 - (5e0))*{q.uniform('11', "'tt'", 'request_id')}) AS tt, {q.uniform('11', "'label'", 'request_id', 'slot')} AS u FROM c),
  p AS (SELECT *, (0.05e0 + 0.90e0*exp(-0.5e0*((abs(y0) + abs(y1))/dt + abs(minutes)/tt)))*CASE WHEN mode = 6 THEN 0.15e0 ELSE 1e0 END AS probability FROM d)
  SELECT request_id, scenario, slot, mode, round(degrees((CASE WHEN mode = 6 THEN y1 ELSE y0 END)/6371.0088e0), 7) AS o_lat, round(degrees((CASE WHEN mode = 6 THEN 8e0 ELSE 0e0 END)/6371.0088e0), 7) AS o_lon,
    round(degrees((CASE WHEN mode = 6 THEN y0 ELSE y1 END)/6371.0088e0), 7) AS d_lat, round(degrees((CASE WHEN mode = 6 THEN 0e0 ELSE 8e0 END)/6371.0088e0), 7) AS d_lon, round(minutes, 5) AS minutes, round(probability, 6) AS probability,
    request_id % 10 <> 0 AND u < probability AS relevant FROM p""")
def s8(spark, sf):
    r = fixture(spark, sf, "riders")
    third = F.col("rider_id") % 3
    req = r.select(F.col("rider_id").alias("request_id"), F.col("rider_id").alias("idx"),
                   F.when(third == 0, "thin").when(third == 1, "balanced").otherwise("dense").alias("scenario"))
    places = [F.round(c, 7).alias(c) for c in ("o_lat", "o_lon", "d_lat", "d_lon")]
    return synthetic.corridor_candidates(req).select(
        "request_id", "scenario", "slot", "mode", *places, F.round("minutes", 5).alias("minutes"), F.round("probability", 6).alias("probability"), "relevant")


@query("s9_network_commuters", with_clause("nodes", "net_riders", "net_drivers") + f""", d AS (SELECT driver_id AS id, town, CAST(floor({q.uniform('101', "'driver'", "'row'", 'driver_id')}*5) AS BIGINT) AS r, CAST(floor({q.uniform('101', "'driver'", "'s'", 'driver_id')}*4) AS BIGINT) AS s,
    {q.uniform('101', "'driver'", "'e'", 'driver_id')} AS e, CAST(floor({q.uniform('101', "'driver'", "'dep'", 'driver_id')}*20) AS BIGINT) AS offset_min FROM net_drivers),
  r AS (SELECT rider_id AS id, town, CAST(floor({q.uniform('101', "'rider'", "'o'", 'rider_id')}*25) AS BIGINT) AS o, CAST(floor({q.uniform('101', "'rider'", "'d'", 'rider_id')}*24) AS BIGINT) AS d, CAST(floor({q.uniform('101', "'rider'", "'dep'", 'rider_id')}*25) AS BIGINT) AS offset_min FROM net_riders),
  j AS (SELECT id, town, town*25 + r*5 + s AS o_node, town*25 + r*5 + s + 1 + CAST(floor(e*(4 - s)) AS BIGINT) AS d_node, offset_min, 'driver' AS role FROM d
    UNION ALL SELECT id, town, town*25 + o, town*25 + (o + 1 + d) % 25, offset_min, 'rider' FROM r)
  SELECT j.id, j.town, j.o_node, j.d_node, j.offset_min, a.lat AS o_lat, a.lon AS o_lon, b.lat AS d_lat, b.lon AS d_lon, j.role FROM j JOIN nodes a ON a.node = j.o_node JOIN nodes b ON b.node = j.d_node""")
def s9(spark, sf):
    n = fixture(spark, sf, "nodes")
    d = synthetic.network_commuters(fixture(spark, sf, "net_drivers").select(F.col("driver_id").alias("id"), "town"), n, "driver")
    r = synthetic.network_commuters(fixture(spark, sf, "net_riders").select(F.col("rider_id").alias("id"), "town"), n, "rider")
    return d.withColumn("role", F.lit("driver")).unionByName(r.withColumn("role", F.lit("rider")))


@query("s10_poisson_requests", with_clause("net_riders") + f""" SELECT town, rider_id, round(sum(-ln({q.uniform('42', "'gap'", 'town', 'rider_id')})*60e0) OVER (PARTITION BY town ORDER BY rider_id), 3) AS created_s,
  round(greatest(60e0, least(1200e0, -ln({q.uniform('42', "'patience'", 'town', 'rider_id')})*8e0*60e0)), 3) AS patience_s FROM net_riders""")
def s10(spark, sf):
    slots = fixture(spark, sf, "net_riders").select("town", "rider_id")
    out = synthetic.poisson_requests(slots, "town", "rider_id")
    return out.select("town", "rider_id", F.round("created_s", 3).alias("created_s"), F.round("patience_s", 3).alias("patience_s"))


_RAW = """SELECT rider_id, CASE WHEN rider_id % 50 = 1 THEN 95e0 ELSE o_lat END AS o_lat, o_lon, CASE WHEN rider_id % 50 = 3 THEN o_lat WHEN rider_id % 50 = 5 THEN o_lat + 3e0 ELSE d_lat END AS d_lat,
  CASE WHEN rider_id % 50 = 3 THEN o_lon ELSE d_lon END AS d_lon, CASE WHEN rider_id % 50 <> 4 THEN dep_s END AS departure, CASE WHEN rider_id % 50 = 2 THEN 0 ELSE seats END AS seats,
  CASE WHEN rider_id % 50 = 6 THEN -1 ELSE 4 END AS capacity, rider_id % 50 = 7 AS blank_flag, rider_id % 50 = 8 AS moved_end FROM riders"""


def raw_journeys(spark, sf) -> DataFrame:
    """Requests with defects planted by id, as a feed would deliver them."""
    r = fixture(spark, sf, "riders")
    m = F.col("rider_id") % 50
    r = r.withColumns({"_dlat": F.when(m == 3, F.col("o_lat")).when(m == 5, F.col("o_lat") + 3.0).otherwise(F.col("d_lat")), "_dlon": F.when(m == 3, F.col("o_lon")).otherwise(F.col("d_lon"))})
    r = r.select(
        "rider_id", F.when(m == 1, 95.0).otherwise(F.col("o_lat")).alias("o_lat"), "o_lon", F.col("_dlat").alias("d_lat"), F.col("_dlon").alias("d_lon"),
        F.when(m != 4, F.col("dep_s")).alias("departure"), F.when(m == 2, 0).otherwise(F.col("seats")).alias("seats"), F.when(m == 6, -1).otherwise(4).alias("capacity"),
        F.when(m == 7, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("safety_flags"))
    end = F.when(F.col("rider_id") % 50 == 8, F.col("d_lat") + 0.01).otherwise(F.col("d_lat"))
    return r.withColumn("route", F.array(F.struct(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")), F.struct(end.alias("lat"), F.col("d_lon").alias("lon"))))


@query("v1_validate_journeys", with_clause("riders") + f""", raw AS ({_RAW}), ext AS (SELECT *, CASE WHEN moved_end THEN d_lat + 0.01e0 ELSE d_lat END AS e_lat FROM raw)
  SELECT rider_id, concat_ws('; ', CASE WHEN abs(o_lat) > 90 OR abs(d_lat) > 90 OR abs(e_lat) > 90 THEN 'coordinate out of range' END, CASE WHEN departure IS NULL THEN 'departure missing' END,
  CASE WHEN greatest(abs(o_lat), abs(e_lat)) > 70 OR abs(e_lat - o_lat) > 2 OR abs(d_lon - o_lon) > 2 OR {q.hav('least(o_lat, e_lat)', 'least(o_lon, d_lon)', 'greatest(o_lat, e_lat)', 'greatest(o_lon, d_lon)')} > 200 THEN 'outside the local domain' END,
  CASE WHEN moved_end THEN 'route endpoints differ from start or destination' END, CASE WHEN {q.hav('o_lat', 'o_lon', 'd_lat', 'd_lon')} <= 1e-6 THEN 'start equals destination' END,
  CASE WHEN seats < 1 THEN 'seats below one' END, CASE WHEN capacity < 0 THEN 'negative capacity' END, CASE WHEN blank_flag THEN 'blank safety flag' END) AS reasons FROM ext""")
def v1(spark, sf):
    return validate.with_reasons(raw_journeys(spark, sf)).select("rider_id", F.array_join("reasons", "; ").alias("reasons"))


@query("v2_id_rules", """WITH d AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
  SELECT 'duplicate driver' AS violation, id, n FROM d WHERE n > 1 UNION ALL SELECT 'duplicate rider', id, n FROM r WHERE n > 1 UNION ALL SELECT 'driver and rider', id, d.n + r.n FROM d JOIN r USING (id)""")
def v2(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return validate.id_violations(d, r)


@query("v3_quality_report", with_clause("riders") + f""", raw AS ({_RAW}) SELECT count(*) AS rows, count(*) FILTER (departure IS NULL) AS missing_departure, count(*) FILTER (o_lat IS NULL OR d_lat IS NULL) AS missing_coordinate,
  count(*) FILTER (abs(o_lat) > 90 OR abs(d_lat) > 90) AS impossible_coordinate, count(*) FILTER (1000 + rider_id % 900 < departure) AS arrival_before_departure, count(*) FILTER (seats < 1) AS bad_seats,
  count(*) - count(DISTINCT rider_id % 14000) AS duplicate_ids, round(min(o_lat), 6) AS min_lat, round(max(o_lat), 6) AS max_lat FROM raw""")
def v3(spark, sf):
    j = raw_journeys(spark, sf).withColumns({"arrival": 1000 + F.col("rider_id") % 900, "_key": F.col("rider_id") % 14000})
    return validate.quality_report(j, "_key")


@query("g6_vehicle_position", with_clause("drivers") + f""", r AS (SELECT driver_id, o_lat, o_lon, {_BEND[0]} AS m_lat, {_BEND[1]} AS m_lon, d_lat, d_lon, ((driver_id*37) % 101)/100e0 AS t FROM drivers),
  l AS (SELECT *, {q.hav('o_lat', 'o_lon', 'm_lat', 'm_lon')} AS l1, {q.hav('m_lat', 'm_lon', 'd_lat', 'd_lon')} AS l2 FROM r), p AS (SELECT *, t*(l1 + l2) <= l1 AS first, CASE WHEN t*(l1 + l2) <= l1 THEN t*(l1 + l2)/l1 ELSE (t*(l1 + l2) - l1)/l2 END AS f FROM l)
  SELECT driver_id, round(CASE WHEN first THEN o_lat + (m_lat - o_lat)*f ELSE m_lat + (d_lat - m_lat)*f END, 6) AS lat, round(CASE WHEN first THEN o_lon + (m_lon - o_lon)*f ELSE m_lon + (d_lon - m_lon)*f END, 6) AS lon,
  round((degrees(CASE WHEN first THEN {q.bearing('o_lat', 'o_lon', 'm_lat', 'm_lon')} ELSE {q.bearing('m_lat', 'm_lon', 'd_lat', 'd_lon')} END) + 360e0) % 360e0, 5) AS bearing FROM p""")
def g6(spark, sf):
    d = bent_routes(spark, sf).withColumn("t", ((F.col("driver_id") * 37) % 101) / 100.0)
    return geo.with_position(d, "route", F.col("t"), "p").select(
        "driver_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), F.round("p.bearing", 5).alias("bearing"))


@query("g13_perturbed_routes", with_clause("drivers") + f""", p AS (SELECT driver_id, o_lat, o_lon, 0.1e0*sqrt({q.uniform('1', '0', "'endpoints'", 'driver_id', '0', '1')}) AS r, 2e0*pi()*{q.uniform('1', '0', "'endpoints'", 'driver_id', '0', '2')} AS a FROM drivers),
  m AS (SELECT *, o_lat + degrees(r*sin(a)/6371.0088e0) AS n_lat, o_lon + degrees(r*cos(a)/(6371.0088e0*cos(radians(o_lat)))) AS n_lon FROM p)
  SELECT driver_id, round({q.hav('o_lat', 'o_lon', 'n_lat', 'n_lon')}, 6) AS moved_km, round(-5e0 + 10e0*{q.uniform('1', '0', "'departure'", 'driver_id')}, 4) AS shift_min FROM m""")
def g13(spark, sf):
    d = bent_routes(spark, sf)
    moved = synthetic.perturb_routes(d, F.lit(0), "endpoints")
    first = lambda c: F.get(F.col(c), F.lit(0))
    j = moved.withColumnRenamed("route", "moved").join(d.select("driver_id", "route"), "driver_id")
    return j.select("driver_id", F.round(geo.haversine_km(first("route")["lat"], first("route")["lon"], first("moved")["lat"], first("moved")["lon"]), 6).alias("moved_km"),
                    F.round(synthetic.departure_shift_min(F.lit(0), F.col("driver_id")), 4).alias("shift_min"))


@query("e13_cross_run_summary", with_clause("bookings") + """ SELECT run, status, bookings, mean_km FROM (SELECT 'first' AS run, status, count(*) AS bookings, CAST(NULL AS DOUBLE) AS mean_km FROM bookings WHERE booking_id % 2 = 0 GROUP BY status
  UNION ALL SELECT 'second', status, count(*), round(avg(CAST(distance_km AS DOUBLE)), 4) FROM bookings WHERE booking_id % 2 = 1 GROUP BY status) t""")
def e13(spark, sf):
    """Metrics files of two runs with different columns, read back as one table."""
    b = fixture(spark, sf, "bookings")
    path = readers.scratch(spark, "runs")
    half = lambda i: b.filter(F.col("booking_id") % 2 == i).groupBy("status")
    readers.write_artefacts({"first": half(0).agg(F.count(F.lit(1)).alias("bookings"))}, path)
    readers.write_artefacts({"second": half(1).agg(F.count(F.lit(1)).alias("bookings"), F.round(F.avg(F.col("distance_km").cast("double")), 4).alias("mean_km"))}, path)
    first = readers.read_runs(spark, {"first": f"{path}/first"}, "status string, bookings bigint")
    second = readers.read_runs(spark, {"second": f"{path}/second"}, "status string, bookings bigint, mean_km double")
    return first.unionByName(second, allowMissingColumns=True).select("run", "status", "bookings", "mean_km")


# ---- learning ----

_ART = {"artefact_version": learn.ARTEFACT_VERSION, "features": list(learn.FEATURES), "means": [1.2, 1.7, 0.3, 0.8, 3.0, 14.0, 1.0],
        "scales": [0.5, 0.8, 0.2, 0.2, 1.5, 8.0, 1.0], "weights": [-0.6, -0.4, 0.9, 0.3, -0.2, -0.5, 0.1], "intercept": -0.25, "fallback": None}
_SLACK = "greatest(0, capacity - seats)"


def vectors(spark, sf) -> DataFrame:
    """Eligible pairs with the seven features, label and split (two thirds of the requests train)."""
    return learn.with_slack(labelled(spark, sf).filter("eligible")).withColumn("train", F.col("rider_id") % 3 != 2)


@query("m1_feature_vectors", q.scored() + f" SELECT rider_id, driver_id, {', '.join(f'round({f}, 6) AS {f}' for f in learn.FEATURES[:-1])}, CAST({_SLACK} AS DOUBLE) AS capacity_slack, {_REL} AS relevant, rider_id % 3 <> 2 AS train FROM scored WHERE eligible")
def m1(spark, sf):
    return vectors(spark, sf).select("rider_id", "driver_id", *[F.round(f, 6).alias(f) for f in learn.FEATURES[:-1]], "capacity_slack", "relevant", "train")


@query("m2_standardisation", q.scored() + ", tr AS (SELECT *, " + f"CAST({_SLACK} AS DOUBLE) AS capacity_slack FROM scored WHERE eligible AND rider_id % 3 <> 2) SELECT "
       + ", ".join(f"round(avg({f}), 6) AS {f}_mean, round(CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1e0 END, 6) AS {f}_scale" for f in learn.FEATURES) + " FROM tr")
def m2(spark, sf):
    s = learn.scaling(vectors(spark, sf).filter("train"))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def model(spark, sf) -> dict:
    return once(spark, sf, "model", lambda: learn.fit(vectors(spark, sf).filter("train"), "relevant"))


@query("m3_logistic_fit")
def m3(spark, sf):
    """Fitted weights, and the gradient of the penalised loss at them (near zero)."""
    a = model(spark, sf)
    t = vectors(spark, sf).filter("train").withColumn("_e", learn.probability(a) - F.col("relevant").cast("double"))
    n = F.count(F.lit(1))
    parts = [F.struct(F.lit("intercept").alias("feature"), F.lit(a["intercept"]).alias("weight"), F.avg("_e").alias("gradient"))]
    for f, w, m, s in zip(learn.FEATURES, a["weights"], a["means"], a["scales"]):
        parts.append(F.struct(F.lit(f).alias("feature"), F.lit(w).alias("weight"), (F.avg(F.col("_e") * ((F.col(f) - m) / s)) + w / n).alias("gradient")))
    return t.agg(F.array(*parts).alias("p")).select(F.inline("p"))


@query("m4_score_with_artefact", q.scored() + ", p AS (SELECT rider_id, driver_id, round(1e0/(1e0 + exp(-(-0.25e0 + " + " + ".join(
    f"({w}e0)*(({f if f != 'capacity_slack' else _SLACK} - {m}e0)/{s}e0)" for f, w, m, s in zip(learn.FEATURES, _ART["weights"], _ART["means"], _ART["scales"])) + """))), 9) AS probability FROM scored WHERE eligible)
  SELECT rider_id, driver_id, round(probability, 6) AS probability, rank FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY probability DESC, driver_id) AS rank FROM p) t WHERE rank <= 3""")
def m4(spark, sf):
    ranked = learn.rank_learned(vectors(spark, sf), learn.load(learn.save(_ART)))
    return ranked.select("rider_id", "driver_id", F.round("probability", 6).alias("probability"), F.col("rank").cast("bigint").alias("rank"))


@query("m5_learned_vs_heuristic")
def m5(spark, sf):
    """Held-out requests: learned, heuristic and distance ranking by scenario."""
    c = F.col
    p = learn.with_slack(labelled(spark, sf)).filter(c("rider_id") % 3 == 2)
    keys = F.array(
        F.struct(F.lit("learned").alias("method"), (-learn.probability(model(spark, sf))).alias("key")),
        F.struct(F.lit("route_time").alias("method"), (-c("score")).alias("key")),
        F.struct(F.lit("distance_destination").alias("method"), (c("pickup_km") + c("dest_km")).alias("key")))
    m = evaluate.query_metrics(p.select("*", F.inline(keys)), ["method", "rider_id"], [c("key"), c("driver_id")])
    n = c("candidates")
    m = m.withColumn("scenario", F.when(n <= 2, "thin").when(n <= 4, "balanced").otherwise("dense"))
    return evaluate.mean_by(m, ["scenario", "method"], ("precision_at_k", "recall_at_k", "ndcg_at_k", "coverage"))
