"""Journey, network and marketplace tables derived from the shared Parquet tables.

Each table is one SQL text that Spark and the checking engine both run, so the
two sides read identical rows. Base tables appear as ``{orders}`` and so on.
Journeys live in cities of fixed size (15,000 requests, 1,500 drivers), road
networks in towns of 25 nodes, so every table grows linearly with its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _h(key: str, a: int, m: int) -> str:
    """Integer scatter shared by both engines: ((k*k) % 10007 * a + k*7919) % m."""
    return f"(((({key})*({key})) % 10007)*{a} + ({key})*7919) % {m}"


def _box(key: str, city: str) -> str:
    lat = f"(({city}) % 30)*1e0"
    lon = f"(floor(({city})/30e0) % 90)*1e0"
    return (
        f"31.1e0 + {lat} + ({_h(key, 31, 20011)})/1e5 AS o_lat, 75.4e0 + {lon} + ({_h(key, 1009, 20021)})/1e5 AS o_lon, "
        f"31.3e0 + {lat} + ({_h(key, 4021, 20023)})/1e5 AS d_lat, 75.6e0 + {lon} + ({_h(key, 7103, 20029)})/1e5 AS d_lon"
    )


_EDGE = (
    "SELECT a.node AS u, b.node AS v, a.name AS u_name, b.name AS v_name, {km} AS km, {kmh} AS kmh, "
    "{km}/{kmh}*3600e0 AS secs FROM nodes a JOIN nodes b ON b.node = a.node + ({step}) AND a.town = b.town "
    "WHERE {rule} AND (a.k IN (23,24)) = (b.k IN (23,24))"
)
_EDGES = " UNION ALL ".join(
    _EDGE.format(step=step, rule=rule, km=km, kmh=kmh)
    for step, rule, km, kmh in (
        (1, "a.c < 4", "9.7e0", "50e0"),
        (-1, "a.c > 0", "9.7e0", "50e0"),
        (5, "a.c IN (0,2,4)", "11.3e0", "30e0"),
        (-5, "a.c IN (1,3)", "11.3e0", "30e0"),
    )
)

# name -> (tables it reads, SQL)
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "riders": ((), (
        "SELECT o_orderkey AS rider_id, CAST(floor(o_orderkey/15000e0) AS BIGINT) AS city, "
        "CAST(o_orderkey % 3 + 1 AS INT) AS seats, o_orderkey % 23 <> 0 AS identity_ok, "
        + _box("o_orderkey", "floor(o_orderkey/15000e0)")
        + ", CAST((o_orderkey*37) % 3600 AS BIGINT) AS dep_s FROM {orders}")),
    "drivers": ((), (
        "SELECT k - 1000003 AS driver_id, CAST(floor((k - 1000003)/1500e0) AS BIGINT) AS city, "
        "CAST(k % 5 AS INT) AS capacity, k % 10 <> 9 AS identity_ok, k % 11 <> 10 AS vehicle_ok, k % 37 = 0 AS safety_flag, "
        + _box("k", "floor((k - 1000003)/1500e0)")
        + ", CAST((k*37) % 3600 AS BIGINT) AS dep_s FROM (SELECT c_custkey + 1000003 AS k FROM {customer}) t")),
    # per-request candidate pools: each request lists the drivers offered to it
    "pools": ((), (
        "SELECT l_orderkey AS rider_id, p.c_custkey AS driver_id, min(l_linenumber) AS slot FROM {lineitem} "
        "JOIN {customer} p ON p.c_custkey = CAST(floor(l_orderkey/15000e0) AS BIGINT)*1500 + l_partkey % 1500 "
        "GROUP BY l_orderkey, p.c_custkey")),
    "nodes": ((), (
        "SELECT s_suppkey AS node, CAST(floor(s_suppkey/25e0) AS BIGINT) AS town, CAST(s_suppkey % 25 AS INT) AS k, "
        "CAST(floor((s_suppkey % 25)/5e0) AS INT) AS r, CAST(s_suppkey % 5 AS INT) AS c, "
        "31.1e0 + (floor(s_suppkey/25e0) % 30)*1e0 + floor((s_suppkey % 25)/5e0)*0.1e0 AS lat, "
        "75.4e0 + (floor(s_suppkey/750e0) % 90)*1e0 + (s_suppkey % 5)*0.1e0 AS lon, "
        "CASE CAST(floor((s_suppkey % 25)/5e0) AS INT) WHEN 0 THEN 'folsom' WHEN 1 THEN 'howard' WHEN 2 THEN 'mission' "
        "WHEN 3 THEN 'market' ELSE 'dock' END || '_' || CASE s_suppkey % 5 WHEN 0 THEN '4th' WHEN 1 THEN '3rd' "
        "WHEN 2 THEN '2nd' WHEN 3 THEN '1st' ELSE 'fremont' END AS name FROM {supplier}")),
    "edges": (("nodes",), _EDGES),
    "net_riders": ((), (
        "SELECT o_orderkey AS rider_id, CAST(floor(o_orderkey/3750e0) AS BIGINT) AS town, CAST(o_orderkey % 2 + 1 AS INT) AS seats, "
        "CAST(floor(o_orderkey/3750e0) AS BIGINT)*25 + ((o_orderkey*o_orderkey) % 10007 + o_orderkey*13) % 25 AS o_node, "
        "CAST(floor(o_orderkey/3750e0) AS BIGINT)*25 + ((o_orderkey*o_orderkey) % 10007 + o_orderkey*13 + 1 + o_orderkey % 24) % 25 AS d_node, "
        "CAST((o_orderkey*37) % 3600 AS BIGINT) AS dep_s FROM {orders}")),
    "net_drivers": ((), (
        "SELECT c_custkey AS driver_id, CAST(floor(c_custkey/375e0) AS BIGINT) AS town, CAST(1 + c_custkey % 4 AS INT) AS capacity, "
        "CAST(floor(c_custkey/375e0) AS BIGINT)*25 + ((c_custkey*c_custkey) % 10007 + c_custkey*17) % 25 AS o_node, "
        "CAST(floor(c_custkey/375e0) AS BIGINT)*25 + ((c_custkey*c_custkey) % 10007 + c_custkey*17 + 1 + c_custkey % 24) % 25 AS d_node, "
        "CAST((c_custkey*53) % 3600 AS BIGINT) AS dep_s FROM {customer}")),
    # riders accepted by a driver in id order while its seats last: never more riders than seats
    "cohorts": (("net_riders", "net_drivers"), (
        "SELECT driver_id, capacity, v_o, v_d, rider_id, r_o, r_d, seats, dep_s FROM (SELECT v.driver_id, v.capacity, v.o_node AS v_o, v.d_node AS v_d, "
        "r.rider_id, r.o_node AS r_o, r.d_node AS r_d, r.seats, v.dep_s, sum(r.seats) OVER (PARTITION BY v.driver_id ORDER BY r.rider_id) AS used "
        f"FROM net_riders r JOIN net_drivers v ON v.driver_id = r.town*375 + ({_h('r.rider_id', 31, 375)})) t WHERE used <= capacity")),
    # every rider within a kilometre of a driver's start and a minute of the departure, whatever the seats
    "offers": (("net_riders", "net_drivers", "nodes"), (
        "SELECT v.driver_id, v.capacity, v.o_node AS v_o, v.d_node AS v_d, r.rider_id, r.o_node AS r_o, r.d_node AS r_d, r.seats FROM net_riders r "
        "JOIN net_drivers v ON v.town = r.town AND v.o_node = r.o_node JOIN nodes n ON n.node = v.o_node JOIN nodes m ON m.node = v.d_node JOIN nodes e ON e.node = r.d_node "
        "WHERE abs(v.dep_s - r.dep_s) <= 60")),
    # planned edges of a trip that drives east to the end of its street
    "trip_edges": (("net_riders",), " UNION ALL ".join(
        f"SELECT rider_id AS trip_id, CAST({i} AS BIGINT) AS seq, o_node + {i} AS u, o_node + {i + 1} AS v, dep_s FROM net_riders WHERE o_node % 5 + {i} < 4" for i in range(4))),
    # three incidents per town, on the dep_s clock, half-open interval
    "incidents": (("nodes",), (
        "SELECT town*3 + 0 AS incident_id, town*25 + 6 AS u, town*25 + 7 AS v, CAST(0 AS BIGINT) AS t_start, "
        "CAST(1800 AS BIGINT) AS t_end, 1.0e0 AS reduction, true AS closed FROM nodes WHERE k = 6 "
        "UNION ALL SELECT town*3 + 1, town*25 + 11, town*25 + 12, CAST(600 AS BIGINT), CAST(2400 AS BIGINT), 0.45e0, false FROM nodes WHERE k = 11 "
        "UNION ALL SELECT town*3 + 2, town*25 + 2, town*25 + 7, CAST(300 AS BIGINT), CAST(900 AS BIGINT), 0.65e0, false FROM nodes WHERE k = 2")),
    "zones": ((), (
        "SELECT CAST(r_regionkey AS INT) AS zone_id, 31.32e0 + r_regionkey*0.04e0 AS lat, 75.62e0 + ((r_regionkey*3) % 5)*0.04e0 AS lon, "
        "14e0 + (r_regionkey*r_regionkey*5) % 13 AS base_rate FROM {region}")),
    "bookings": ((), (
        "SELECT o_orderkey AS booking_id, o_custkey AS rider_id, CAST(o_orderkey % 97 AS BIGINT) AS driver_id, "
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'REQUESTED' ELSE 'CANCELLED' END AS status, "
        f"CAST((30 + ({_h('o_orderkey', 31, 4000)}))/1e2 AS DECIMAL(12,2)) AS distance_km, "
        "CAST(3 + o_orderkey % 60 AS INT) AS duration_min, CAST(o_orderkey % 13 AS INT) AS wait_min, "
        "CAST((100 + (o_orderkey % 5)*25)/1e2 AS DECIMAL(5,2)) AS surge, "
        "CASE o_orderkey % 5 WHEN 0 THEN 'FLAT50' WHEN 1 THEN 'PCT20' WHEN 2 THEN 'PCT10' WHEN 3 THEN 'NOSUCH' END AS promo_code, "
        "o_orderdate AS created_at FROM {orders}")),
    "promos": ((), (
        "SELECT * FROM (VALUES ('FLAT50','FLAT',50.0,CAST(NULL AS DECIMAL(5,1)),100.0,1000,true), ('PCT20','PERCENTAGE',20.0,200.0,150.0,500,true), "
        "('PCT10','PERCENTAGE',10.0,100.0,80.0,2000,true), ('OLD5','FLAT',5.0,CAST(NULL AS DECIMAL(5,1)),0.0,10,false)) "
        "AS t(code, discount_type, discount_value, max_discount, min_amount, max_uses, is_active)")),
    "ratings": ((), (
        "SELECT l_orderkey AS booking_id, l_orderkey % 150 AS rater_id, l_orderkey % 97 AS ratee_id, l_linenumber AS seq, "
        "CAST(1 + (l_orderkey + l_partkey) % 5 AS INT) AS stars FROM {lineitem}")),
    "wallet_tx": ((), (
        "SELECT event_id AS tx_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'DEBIT' ELSE 'CREDIT' END AS type, "
        "CAST(round(value, 2) AS DECIMAL(12,2)) AS amount FROM {events} WHERE event_type IN ('purchase','signup')")),
    "pings": ((), (
        "SELECT event_id, user_id AS driver_id, ts, "
        f"31.1e0 + ({_h('event_id', 31, 40009)})/1e5 AS lat, 75.4e0 + ({_h('event_id', 1009, 40013)})/1e5 AS lon FROM {{events}}")),
    "dispatch_events": (("riders",), (
        "SELECT rider_id AS request_id, 'CREATED' AS type, dep_s AS t_s FROM riders "
        "UNION ALL SELECT rider_id, 'ASSIGNED', dep_s + (rider_id*29) % 900 FROM riders WHERE (rider_id*29) % 900 < 60 + (rider_id*53) % 1140 "
        "UNION ALL SELECT rider_id, 'CANCELLED', dep_s + 60 + (rider_id*53) % 1140 FROM riders WHERE (rider_id*29) % 900 >= 60 + (rider_id*53) % 1140 "
        "UNION ALL SELECT rider_id, 'PICKED_UP', dep_s + (rider_id*29) % 900 + 60 + (rider_id*17) % 400 FROM riders WHERE (rider_id*29) % 900 < 60 + (rider_id*53) % 1140 "
        "UNION ALL SELECT rider_id, 'COMPLETED', dep_s + (rider_id*29) % 900 + 360 + (rider_id*17) % 400 + (rider_id*41) % 1200 FROM riders WHERE (rider_id*29) % 900 < 60 + (rider_id*53) % 1140")),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for dep in _ordered(FIXTURES[n][0]):
            if dep not in out:
                out.append(dep)
        if n not in out:
            out.append(n)
    return out


def with_clause(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` over the plain table names, for the checking engine."""
    tables = {t: t for t in BASE_TABLES}
    return "WITH " + ", ".join(f"{n} AS ({FIXTURES[n][1].format(**tables)})" for n in _ordered(names))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame; column pruning and filters reach the Parquet scans."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE_TABLES}
    order = _ordered((name,))
    ctes = ", ".join(f"{n} AS ({FIXTURES[n][1].format(**tables)})" for n in order)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
