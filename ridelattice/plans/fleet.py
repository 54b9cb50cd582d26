"""Assignment, rebalancing, pooling, disruption and dispatch-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.operators import assign, dispatch, network, pairs, pool, recourse, replan
from ridelattice.plans import sqltext as q
from ridelattice.plans.matching import standard_scored
from ridelattice.plans.network import _CONG_OD, _OD, congested_od, od, once
from ridelattice.plans.registry import query
from ridelattice.session import cut_lineage
from ridelattice.sources.fixtures import fixture, with_clause


def feasible_edges(spark, sf) -> DataFrame:
    s = standard_scored(spark, sf).filter("eligible")
    return s.select("driver_id", "rider_id", "score", F.col("r_seats").alias("seats"), F.col("v_capacity").alias("capacity"), F.col("r_city").alias("city"))


def edges_batch(spark, sf) -> DataFrame:
    return once(spark, sf, "edges_scored", lambda: cut_lineage(feasible_edges(spark, sf)))


@query("a1_feasible_edges", q.scored() + " SELECT driver_id, rider_id, score, seats, capacity FROM scored WHERE eligible")
def a1(spark, sf):
    return feasible_edges(spark, sf).drop("city")


@query("a1_graph_counts", q.scored() + """ SELECT t.city, riders*drivers AS total_pairs, coalesce(e.n, 0) AS feasible_edges, round(coalesce(e.n, 0)/CAST(riders*drivers AS DOUBLE), 8) AS density FROM
  (SELECT city, count(*) AS riders FROM riders GROUP BY city) t JOIN (SELECT city, count(*) AS drivers FROM drivers GROUP BY city) d ON d.city = t.city
  LEFT JOIN (SELECT city, count(*) AS n FROM scored WHERE eligible GROUP BY city) e ON e.city = t.city""")
def a1_counts(spark, sf):
    n = lambda df, name: df.groupBy("city").agg(F.count(F.lit(1)).alias(name))
    j = n(fixture(spark, sf, "riders"), "riders").join(n(fixture(spark, sf, "drivers"), "drivers"), "city").join(n(edges_batch(spark, sf), "feasible_edges"), "city", "left")
    j = j.fillna({"feasible_edges": 0}).withColumn("total_pairs", F.col("riders") * F.col("drivers"))
    return j.select("city", "total_pairs", "feasible_edges", F.round(F.col("feasible_edges") / F.col("total_pairs"), 8).alias("density"))


def greedy(spark, sf) -> DataFrame:
    return once(spark, sf, "greedy", lambda: cut_lineage(assign.greedy_assignment(edges_batch(spark, sf))))


@query("a2_greedy_assignment")
def a2(spark, sf):
    return assign.greedy_assignment(feasible_edges(spark, sf))


@query("a3_improved_assignment")
def a3(spark, sf):
    return assign.improve_assignment(edges_batch(spark, sf), greedy(spark, sf))


_FIRST = q.scored() + """, pick AS (SELECT * FROM (SELECT city, driver_id, rider_id, score, seats, capacity, row_number() OVER (PARTITION BY rider_id ORDER BY score DESC, driver_id) AS rk FROM scored WHERE eligible) t WHERE rk = 1),
  chosen AS MATERIALIZED (SELECT * FROM (SELECT *, sum(seats) OVER (PARTITION BY driver_id ORDER BY score DESC, rider_id ROWS UNBOUNDED PRECEDING) AS used FROM pick) t WHERE used <= capacity)"""


def first_choice(spark, sf) -> DataFrame:
    chosen = assign.first_choice_assignment(edges_batch(spark, sf).drop("city"))
    return chosen.join(fixture(spark, sf, "riders").select("rider_id", "city"), "rider_id")


@query("a4_assignment_groups", _FIRST + """ SELECT driver_id, capacity, string_agg(CAST(rider_id AS VARCHAR), ',' ORDER BY rider_id) AS riders, CAST(sum(seats) AS BIGINT) AS seats_used, round(sum(score), 2) AS group_score,
  CAST(capacity - sum(seats) AS BIGINT) AS seats_left FROM chosen GROUP BY driver_id, capacity""")
def a4(spark, sf):
    return assign.assignment_groups(first_choice(spark, sf))


@query("a4_unmatched", _FIRST + """ SELECT 'rider' AS role, rider_id AS id FROM riders WHERE rider_id NOT IN (SELECT rider_id FROM chosen)
  UNION ALL SELECT 'driver', driver_id FROM drivers WHERE driver_id NOT IN (SELECT driver_id FROM chosen)""")
def a4_unmatched(spark, sf):
    a = first_choice(spark, sf)
    r = fixture(spark, sf, "riders").join(a.select("rider_id"), "rider_id", "left_anti").select(F.lit("rider").alias("role"), F.col("rider_id").alias("id"))
    d = fixture(spark, sf, "drivers").join(a.select("driver_id"), "driver_id", "left_anti").select(F.lit("driver").alias("role"), F.col("driver_id").alias("id"))
    return r.unionByName(d)


def _metrics_sql(by: str) -> str:
    return f"""SELECT r.{by}, r.riders, CAST(d.seats_total AS BIGINT) AS seats_total, coalesce(a.matched, 0) AS matched, CAST(coalesce(a.seats_used, 0) AS BIGINT) AS seats_used, coalesce(a.objective, 0e0) AS objective,
  round(coalesce(a.matched, 0)/CAST(r.riders AS DOUBLE), 4) AS match_rate, round(coalesce(a.seats_used, 0)/CAST(d.seats_total AS DOUBLE), 4) AS utilisation,
  CASE WHEN b.best <= 1e-6 THEN 0e0 ELSE round(greatest(0e0, (b.best - coalesce(a.objective, 0e0))/b.best)*100e0, 2) END AS gap_pct
  FROM (SELECT {by}, count(*) AS riders FROM rx GROUP BY 1) r JOIN (SELECT {by}, sum(capacity) AS seats_total FROM dx GROUP BY 1) d ON r.{by} = d.{by}
  LEFT JOIN (SELECT {by}, count(*) AS matched, sum(seats) AS seats_used, round(sum(score), 2) AS objective FROM cx GROUP BY 1) a ON a.{by} = r.{by}
  JOIN (SELECT {by}, sum(score) AS best FROM px GROUP BY 1) b ON b.{by} = r.{by}"""


@query("a5_assignment_metrics", _FIRST + ", rx AS (SELECT city, rider_id FROM riders), dx AS (SELECT city, capacity FROM drivers), cx AS (SELECT * FROM chosen), px AS (SELECT * FROM pick) " + _metrics_sql("city"))
def a5(spark, sf):
    e = edges_batch(spark, sf)
    # reference objective: every rider at its best driver, ignoring seats
    bound = e.groupBy("city", "rider_id").agg(F.max("score").alias("m")).groupBy("city").agg(F.sum("m").alias("_bound"))
    r = fixture(spark, sf, "riders").join(bound, "city")
    m = assign.assignment_metrics(first_choice(spark, sf), r, fixture(spark, sf, "drivers"), "city", F.lit(0.0))
    m = m.drop("gap_pct").join(bound, "city")
    gap = F.when(F.col("_bound") <= 1e-6, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), (F.col("_bound") - F.col("objective")) / F.col("_bound")) * 100.0, 2))
    return m.withColumn("gap_pct", gap).drop("_bound")


@query("a6_scale_summary", _FIRST + """ SELECT cohort, method, count(*) AS matched, CAST(sum(seats) AS BIGINT) AS seats, round(sum(score), 2) AS objective, round(avg(score), 4) AS mean_score FROM (
  SELECT CASE WHEN seats = 1 THEN 'single' WHEN seats = 2 THEN 'pair' ELSE 'group' END AS cohort, 'first_choice' AS method, seats, score FROM chosen
  UNION ALL SELECT CASE WHEN seats = 1 THEN 'single' WHEN seats = 2 THEN 'pair' ELSE 'group' END, 'unconstrained', seats, score FROM pick) t GROUP BY cohort, method""")
def a6(spark, sf):
    e = edges_batch(spark, sf)
    best = e.groupBy("rider_id").agg(F.max_by(F.struct("seats", "score"), F.struct("score", (-F.col("driver_id")).alias("d"))).alias("b")).select("b.*")
    cols = lambda df, m: df.select(F.lit(m).alias("method"), "seats", "score")
    rows = cols(first_choice(spark, sf), "first_choice").unionByName(cols(best, "unconstrained"))
    cohort = F.when(F.col("seats") == 1, "single").when(F.col("seats") == 2, "pair").otherwise("group")
    return rows.groupBy(cohort.alias("cohort"), "method").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("seats").alias("seats"), F.round(F.sum("score"), 2).alias("objective"), F.round(F.avg("score"), 4).alias("mean_score"))


_ZONE = f"""placed AS MATERIALIZED (SELECT driver_id, d_lat, d_lon, zone_id, km AS zone_km FROM (SELECT v.driver_id, v.d_lat, v.d_lon, z.zone_id, {q.hav('v.d_lat', 'v.d_lon', 'z.lat', 'z.lon')} AS km,
    row_number() OVER (PARTITION BY v.driver_id ORDER BY {q.hav('v.d_lat', 'v.d_lon', 'z.lat', 'z.lon')}, z.zone_id) AS rn FROM drivers v CROSS JOIN zones z) t WHERE rn = 1)"""
_BALANCE = """bal AS MATERIALIZED (SELECT *, greatest(supply - target, 0) AS surplus, greatest(target - supply, 0) AS deficit FROM (SELECT z.zone_id, z.lat, z.lon, z.base_rate AS demand, coalesce(s.n, 0) AS supply,
    greatest(1, CAST(round_even(z.base_rate/(SELECT sum(base_rate) FROM zones)*(SELECT count(*) FROM placed), 0) AS BIGINT)) AS target FROM zones z LEFT JOIN (SELECT zone_id, count(*) AS n FROM placed GROUP BY 1) s ON s.zone_id = z.zone_id) t)"""


def placed(spark, sf) -> DataFrame:
    d = fixture(spark, sf, "drivers").select("driver_id", "d_lat", "d_lon")
    return assign.nearest_zone(d, fixture(spark, sf, "zones"), "d_lat", "d_lon", "driver_id")


@query("j19_nearest_zone", with_clause("drivers", "zones") + ", " + _ZONE + " SELECT driver_id, zone_id, round(zone_km, 6) AS zone_km FROM placed")
def j19(spark, sf):
    return placed(spark, sf).select("driver_id", "zone_id", F.round("zone_km", 6).alias("zone_km"))


@query("a7_zone_balance", with_clause("drivers", "zones") + ", " + _ZONE + ", " + _BALANCE + " SELECT zone_id, demand, supply, target, surplus, deficit FROM bal")
def a7(spark, sf):
    return assign.zone_balance(placed(spark, sf), fixture(spark, sf, "zones")).select("zone_id", "demand", "supply", "target", "surplus", "deficit")


def _moves_sql() -> str:
    parts = ["""free0 AS MATERIALIZED (SELECT driver_id, d_lat, d_lon, zone_id FROM (SELECT p.*, row_number() OVER (PARTITION BY p.zone_id ORDER BY driver_id) AS rn FROM placed p) t JOIN bal USING (zone_id) WHERE rn <= surplus)"""]
    for z in range(5):
        gone = " UNION ALL ".join(f"SELECT driver_id FROM take{i}" for i in range(z)) or "SELECT -1"
        parts.append(
            f"take{z} AS MATERIALIZED (SELECT driver_id, zone_id AS origin_zone, {z} AS target_zone, km FROM (SELECT *, row_number() OVER (ORDER BY km, zone_id, driver_id) AS rn FROM (SELECT f.*, b.deficit, "
            f"{q.hav('f.d_lat', 'f.d_lon', 'b.lat', 'b.lon')} AS km FROM free0 f, bal b WHERE b.zone_id = {z} AND f.driver_id NOT IN ({gone})) t WHERE km <= 6e0) s WHERE rn <= deficit)")
    parts.append("moves AS (SELECT driver_id, origin_zone, target_zone, round(km, 3) AS km, round(km/25e0*3600e0, 1) AS transit_s FROM ("
                 + " UNION ALL ".join(f"SELECT * FROM take{z}" for z in range(5)) + ") t)")
    return ", ".join(parts)


_MOVES = with_clause("drivers", "zones") + ", " + _ZONE + ", " + _BALANCE + ", " + _moves_sql()


def moves(spark, sf):
    p = cut_lineage(placed(spark, sf))
    z = fixture(spark, sf, "zones")
    balance = cut_lineage(assign.zone_balance(p, z).select("zone_id", "surplus", "deficit"))
    return assign.relocations(p, balance, "driver_id", "d_lat", "d_lon", z), balance


@query("a8_relocations", _MOVES + " SELECT * FROM moves")
def a8(spark, sf):
    return moves(spark, sf)[0]


@query("a9_rebalance_report", _MOVES + """ SELECT count(*) AS moved, (SELECT CAST(sum(deficit) AS BIGINT) FROM bal) AS unmet_before, (SELECT CAST(sum(deficit) AS BIGINT) FROM bal) - count(*) AS unmet_after,
  CASE WHEN (SELECT sum(deficit) FROM bal) > 0 THEN round(count(*)/CAST((SELECT sum(deficit) FROM bal) AS DOUBLE)*100e0, 1) ELSE 0e0 END AS gain_pct, coalesce(round(avg(km), 2), 0e0) AS mean_km,
  coalesce(round((list(km ORDER BY km))[CAST(least(floor(count(*)*0.95e0), count(*) - 1) AS BIGINT) + 1], 2), 0e0) AS p95_km, coalesce(round(sum(km), 2), 0e0) AS total_km FROM moves""")
def a9(spark, sf):
    d, balance = moves(spark, sf)
    return assign.rebalance_report(d, balance)


POOL_LIMITS = {"detour_km": 40.0, "detour_time_s": 4500.0}
_L = POOL_LIMITS


def _orders_values(ks=(1, 2, 3)) -> str:
    return "(VALUES " + ", ".join(f"({k}, {i}, {o})" for k in ks for i, o in enumerate(pool.stop_orders(k))) + ") o(k, order_no, stops)"


_SUBSETS = with_clause("nodes", "edges", "offers") + """, sets AS MATERIALIZED (SELECT *, CASE WHEN k >= 1 THEN driver_id || '-' || array_to_string(r, '+') END AS pool_id FROM (
  SELECT driver_id, capacity, v_o, v_d, 1 AS k, [rider_id] AS r, [r_o, r_d] AS pts, [seats] AS w FROM offers
  UNION ALL SELECT a.driver_id, a.capacity, a.v_o, a.v_d, 2, [a.rider_id, b.rider_id], [a.r_o, a.r_d, b.r_o, b.r_d], [a.seats, b.seats] FROM offers a JOIN offers b ON a.driver_id = b.driver_id AND a.rider_id < b.rider_id
  UNION ALL SELECT a.driver_id, a.capacity, a.v_o, a.v_d, 3, [a.rider_id, b.rider_id, c.rider_id], [a.r_o, a.r_d, b.r_o, b.r_d, c.r_o, c.r_d], [a.seats, b.seats, c.seats]
    FROM offers a JOIN offers b ON a.driver_id = b.driver_id AND a.rider_id < b.rider_id JOIN offers c ON c.driver_id = b.driver_id AND b.rider_id < c.rider_id) t WHERE k <= capacity)"""


def _walk_sql(ks=(1, 2, 3)) -> str:
    """Every stop order of every set, with its largest load and its places in order."""
    load = "list_sum(list_transform(stops[1:i], lambda x: CASE WHEN x % 2 = 1 THEN w[(x + 1) // 2] ELSE -w[(x + 1) // 2] END))"
    return f"""walk AS MATERIALIZED (SELECT t.*, order_no, stops, list_max(list_transform(range(1, 2*t.k + 1), lambda i: {load})) AS top,
    list_concat([v_o], list_transform(stops, lambda x: pts[x]), [v_d]) AS way FROM sets t JOIN {_orders_values(ks)} ON o.k = t.k)"""


def _pool_sql(od_name: str = "od", out: str = "pe", ks=(1, 2, 3)) -> str:
    walk = "" if out != "pe" else _walk_sql(ks) + ", "
    add = lambda x: f"list_reduce({x}, lambda a, b: a + b)"
    return f"""{walk}{out}l AS (SELECT pool_id, order_no, i, way[i] AS src, way[i + 1] AS dst FROM (SELECT pool_id, order_no, way, unnest(range(1, len(way))) AS i FROM walk)),
  {out}s AS (SELECT pool_id, order_no, count(c.s) AS n, list(c.km ORDER BY i) AS kms, list(c.s ORDER BY i) AS ss FROM {out}l l LEFT JOIN {od_name} c ON c.src = l.src AND c.dst = l.dst GROUP BY pool_id, order_no),
  {out}w AS (SELECT t.driver_id, t.capacity, t.pool_id, t.order_no, t.k, t.top, g.km AS dk, g.s AS ds, CASE WHEN n = 2*k + 1 THEN {add('kms')} END AS km, CASE WHEN n = 2*k + 1 THEN {add('ss')} END AS s,
    CASE WHEN n = 2*k + 1 THEN {add(f"list_transform(range(1, 2*k + 1), lambda i: (CASE WHEN stops[i] % 2 = 1 THEN -1 ELSE 1 END)*{add('ss[1:i]')})")}/k END AS ride
    FROM walk t JOIN {out}s USING (pool_id, order_no) LEFT JOIN {od_name} g ON g.src = v_o AND g.dst = v_d),
  {out}a AS (SELECT *, greatest(0e0, km - dk) AS detour_km, greatest(0e0, s - ds) AS detour_s, {_L['detour_km']}e0*(1e0 + 0.5e0*(k - 1)) AS lk, {_L['detour_time_s']}e0*(1e0 + 0.5e0*(k - 1)) AS ls FROM {out}w u),
  {out} AS MATERIALIZED (SELECT *, coalesce(km IS NOT NULL AND dk IS NOT NULL AND detour_km <= lk AND detour_s <= ls AND top <= capacity, false) AS feasible,
    CASE WHEN km IS NOT NULL AND dk IS NOT NULL AND detour_km <= lk AND detour_s <= ls AND top <= capacity THEN CAST(round(CAST(40e0*k/capacity + 30e0*greatest(0e0, 1e0 - detour_s/ls) + 15e0*greatest(0e0, 1e0 - ride/(ls*1.5e0))
    + 15e0*greatest(0e0, 1e0 - detour_km/lk) AS DECIMAL(20,8)), 2) AS DOUBLE) ELSE 0e0 END AS objective FROM {out}a)"""


def offers(spark, sf) -> DataFrame:
    """Riders offered to drivers: all within a kilometre and a minute, through the grid join."""
    nodes = fixture(spark, sf, "nodes")
    at = lambda end: nodes.select(F.col("node").alias(f"{end}_node"), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    r, v = (fixture(spark, sf, t).join(at("o"), "o_node").join(at("d"), "d_node") for t in ("net_riders", "net_drivers"))
    near = pairs.radius_pairs(r, v, 1.0, 25_000.0, 1.0, by=("town",))
    return near.select("driver_id", F.col("v_capacity").alias("capacity"), F.col("v_o_node").alias("v_o"), F.col("v_d_node").alias("v_d"), "rider_id", F.col("r_o_node").alias("r_o"), F.col("r_d_node").alias("r_d"), F.col("r_seats").alias("seats"))


def offered_pools(spark, sf, k: int) -> DataFrame:
    return pool.pools(cut_lineage(offers(spark, sf)), k)


def placed_offers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Offers, and the places of each driver's offers."""
    o = cut_lineage(offers(spark, sf))
    return o, pool.driver_places(o)


def cohort_pools(spark, sf, k: int) -> DataFrame:
    return pool.pools(fixture(spark, sf, "cohorts").drop("dep_s"), k)


@query("p1_valid_stop_orders", _SUBSETS + ", " + _walk_sql() + " SELECT pool_id, k, CAST(count(*) FILTER (top <= capacity) AS INT) AS valid_orders FROM walk GROUP BY pool_id, k")
def p1(spark, sf):
    valid = pool.valid_orders(offered_pools(spark, sf, 3), 3)
    return valid.groupBy("pool_id", "k").agg(F.sum("valid_orders").cast("int").alias("valid_orders"))


@query("p2_evaluate_orders", _SUBSETS + ", " + _OD + ", " + _pool_sql() + """ SELECT pool_id, order_no, k, round(km, 4) AS km, round(s, 1) AS s, round(CASE WHEN dk IS NOT NULL AND km IS NOT NULL THEN detour_km END, 4) AS detour_km,
  feasible, top AS max_load, objective FROM pe""")
def p2(spark, sf):
    o, places = placed_offers(spark, sf)
    e = pool.evaluate_orders(pool.with_leg_costs(pool.pools(o, 3), od(spark, sf), places), POOL_LIMITS, 3)
    return e.select("pool_id", "order_no", "k", F.round("km", 4).alias("km"), F.round("s", 1).alias("s"), F.round("detour_km", 4).alias("detour_km"), "feasible", "max_load", "objective")


_BEST = """ SELECT driver_id, pool_id, order_no, {0}objective FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY objective DESC, k, pool_id, order_no) AS rk FROM pe WHERE feasible) t WHERE rk = 1"""


@query("p3_best_pool_pairs", _SUBSETS + ", " + _OD + ", " + _pool_sql(ks=(1, 2)) + _BEST.format(""))
def p3(spark, sf):
    o, places = placed_offers(spark, sf)
    e = pool.best_orders(pool.with_leg_costs(pool.pools(o, 2), od(spark, sf), places), POOL_LIMITS, 2)
    return pool.best_pools(e, ["driver_id"]).select("driver_id", "pool_id", "order_no", "objective")


def road_direct(spark, sf):
    d = fixture(spark, sf, "net_drivers").select("driver_id", F.col("o_node").alias("src"), F.col("d_node").alias("dst"))
    return d.join(od(spark, sf).select("src", "dst", F.col("km").alias("direct_km")), ["src", "dst"]).select("driver_id", "direct_km")


def costed_pools(spark, sf) -> DataFrame:
    """Admissible sets of the riders offered, with leg costs."""
    o, places = placed_offers(spark, sf)
    sets = pool.grown_pools(o, fixture(spark, sf, "nodes"), road_direct(spark, sf), POOL_LIMITS["detour_km"], places=places)
    return pool.with_leg_costs(sets, od(spark, sf), places)


@query("p3_best_pool_triples", _SUBSETS + ", " + _OD + ", " + _pool_sql() + _BEST.format("k, "))
def p3_triples(spark, sf):
    """Up to three riders of all that are offered; sets that the straight-line bound rules out are never formed."""
    e = pool.best_orders(costed_pools(spark, sf), POOL_LIMITS, 3)
    return pool.best_pools(e, ["driver_id"]).select("driver_id", "pool_id", "order_no", "k", "objective")


def packed(spark, sf, capacities) -> DataFrame:
    """The best order of every admissible set under each number of seats, packed so that no rider travels twice."""
    seats = F.explode(F.array(*[F.lit(c) for c in capacities])).alias("capacity")
    o, places = placed_offers(spark, sf)
    sets = pool.grown_pools(o.withColumn("capacity", F.lit(max(capacities))), fixture(spark, sf, "nodes"), road_direct(spark, sf), POOL_LIMITS["detour_km"], places=places)
    costed = pool.with_leg_costs(sets, od(spark, sf), places).drop("capacity").select("*", seats).filter(F.col("k") <= F.col("capacity"))
    best = pool.best_orders(costed, POOL_LIMITS, 3)
    # places and seats of the riders are not asked for any more
    return pool.packed_pools(best.withColumn("riders", F.transform("riders", lambda r: F.struct(r["rider_id"].alias("rider_id")))), ["capacity"])


@query("p3_packed_pools")
def p3_packed(spark, sf):
    """Trips of three-seat vehicles that share no rider, taken in order of objective."""
    return packed(spark, sf, (3,)).select("driver_id", "pool_id", F.size("riders").alias("k"), "objective")


@query("p4_insertion_pools")
def p4(spark, sf):
    out = pool.insertion_pools(offers(spark, sf), od(spark, sf), fixture(spark, sf, "nodes"), POOL_LIMITS)
    return out.select("driver_id", F.array_join(F.transform("riders", lambda r: r["rider_id"].cast("string")), "+").alias("riders"),
                      F.array_join(F.col("stops").cast("array<string>"), ">").alias("stops"), "objective")


@query("p5_admissible_pools", _SUBSETS + ", " + _OD + ", " + _walk_sql() + f""", step AS (SELECT pool_id, order_no, i, way[i] AS a, way[i + 1] AS b FROM (SELECT pool_id, order_no, way, unnest(range(1, len(way))) AS i FROM walk WHERE top <= capacity)),
  tour AS (SELECT pool_id, order_no, sum({q.hav('m.lat', 'm.lon', 'n.lat', 'n.lon')}) AS km FROM step JOIN nodes m ON m.node = a JOIN nodes n ON n.node = b GROUP BY pool_id, order_no),
  least_ AS (SELECT pool_id, min(km) AS km FROM tour GROUP BY pool_id)
  SELECT t.pool_id, round(greatest(0e0, l.km - od.km), 6) AS bound_km, coalesce(greatest(0e0, l.km - od.km) <= {_L['detour_km']}e0*(1e0 + 0.5e0*(k - 1)), false) AS admissible
  FROM sets t JOIN od ON od.src = v_o AND od.dst = v_d LEFT JOIN least_ l ON l.pool_id = t.pool_id""")
def p5(spark, sf):
    o, places = placed_offers(spark, sf)
    p = pool.admissible(pool.pools(o, 3), fixture(spark, sf, "nodes"), road_direct(spark, sf), POOL_LIMITS["detour_km"], 3, places)
    return p.select("pool_id", F.round("bound_km", 6).alias("bound_km"), "admissible")


@query("p6_capacity_sweep")
def p6(spark, sf):
    """Matched riders and objective when every vehicle had 1, 2, 3 or 4 seats and no rider travelled twice."""
    drivers = fixture(spark, sf, "net_drivers").count()
    out = packed(spark, sf, (1, 2, 3, 4)).groupBy("capacity").agg(
        F.sum(F.size("riders")).alias("matched"), F.round(F.sum("objective"), 2).alias("objective"), F.count(F.lit(1)).alias("drivers"))
    return out.withColumn("seats_offered", F.lit(drivers) * F.col("capacity"))


_SHIFT_PICK = """SELECT pool_id, order_no, s, objective FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY objective DESC, order_no) AS rk FROM {src} WHERE feasible AND k = 2) t WHERE rk = 1"""


@query("p7_stop_order_shift", _SUBSETS + ", " + _OD + ", " + _CONG_OD + ", " + _pool_sql(ks=(2,)) + ", " + _pool_sql("sev", "ce") + f""" SELECT a.pool_id, a.order_no AS free_order, b.order_no AS busy_order, a.order_no <> b.order_no AS changed,
  round(greatest(0e0, b.s - a.s), 1) AS delay_s FROM ({_SHIFT_PICK.format(src='pe')}) a JOIN ({_SHIFT_PICK.format(src='ce')}) b USING (pool_id)""")
def p7(spark, sf):
    o = cut_lineage(offers(spark, sf).dropDuplicates(["driver_id", "rider_id"]))
    places = pool.driver_places(o)
    j = pool.pools(o, 2).filter("k = 2")
    # one row per pool takes both cost tables in turn
    for tag, table in (("free", od(spark, sf)), ("busy", congested_od(spark, sf))):
        best = pool.best_orders(pool.with_leg_costs(j, table, places), POOL_LIMITS, 2)
        j = best.withColumnsRenamed({"order_no": f"{tag}_order", "s": f"_{tag}_s"}).drop("objective", "km", "feasible")
    return j.select("pool_id", "free_order", "busy_order", (F.col("free_order") != F.col("busy_order")).alias("changed"),
                    F.round(F.greatest(F.lit(0.0), F.col("_busy_s") - F.col("_free_s")), 1).alias("delay_s"))


_DIS = with_clause("nodes", "edges", "incidents", "trip_edges")


@query("i1_affected_trips", _DIS + " SELECT DISTINCT t.trip_id FROM trip_edges t JOIN incidents i ON i.u = t.u AND i.v = t.v AND i.t_start <= t.dep_s AND t.dep_s < i.t_end")
def i1(spark, sf):
    return recourse.affected_trips(fixture(spark, sf, "trip_edges"), fixture(spark, sf, "incidents"))


def _fold_sql() -> str:
    parts = ["te AS MATERIALIZED (SELECT t.*, e.km, e.secs FROM trip_edges t JOIN edges e ON e.u = t.u AND e.v = t.v)",
             "f0 AS (SELECT DISTINCT trip_id, CAST(dep_s AS DOUBLE) AS t, 0e0 AS km, 0e0 AS s, false AS closed FROM te)"]
    for i in range(4):
        live = "FROM incidents i WHERE i.u = e.u AND i.v = e.v AND i.t_start <= f.t AND f.t < i.t_end"
        parts.append(
            f"g{i} AS MATERIALIZED (SELECT f.*, e.km AS ekm, e.secs AS es, f.closed OR coalesce((SELECT bool_or(i.closed) {live}), false) AS now_closed, "
            f"coalesce((SELECT max(CASE WHEN i.closed THEN 1e0 ELSE 1e0 + 8e0*i.reduction END) {live}), 1e0) AS factor FROM f{i} f LEFT JOIN te e ON e.trip_id = f.trip_id AND e.seq = {i}), "
            f"f{i+1} AS MATERIALIZED (SELECT trip_id, CASE WHEN ekm IS NULL OR now_closed THEN t ELSE t + es*factor END AS t, CASE WHEN ekm IS NULL OR now_closed THEN km ELSE km + ekm END AS km, "
            f"CASE WHEN ekm IS NULL OR now_closed THEN s ELSE s + es*factor END AS s, CASE WHEN ekm IS NULL THEN closed ELSE now_closed END AS closed FROM g{i})")
    return ", ".join(parts)


@query("i2_realised_trips", _DIS + ", " + _fold_sql() + " SELECT trip_id, round(km, 4) AS km, round(s, 2) AS s, closed FROM f4")
def i2(spark, sf):
    r = recourse.realised_trips(fixture(spark, sf, "trip_edges"), fixture(spark, sf, "edges"), fixture(spark, sf, "incidents"))
    return r.select("trip_id", F.round("km", 4).alias("km"), F.round("s", 2).alias("s"), "closed")


def planned_trips(spark, sf) -> DataFrame:
    """Trips that share no rider, in their best order at free flow, with departure and the driver's own road."""
    best = cut_lineage(pool.best_orders(costed_pools(spark, sf), POOL_LIMITS, 3).select(
        "driver_id", "pool_id", "v_o", "v_d", "riders", "k", "capacity", "objective", "order_no"))
    taken = best.join(pool.packed_pools(best).select("pool_id"), "pool_id", "left_semi")
    own = fixture(spark, sf, "net_drivers").select("driver_id", "dep_s")
    direct = od(spark, sf).select(F.col("src").alias("v_o"), F.col("dst").alias("v_d"), F.col("km").alias("direct_km"), F.col("s").alias("direct_s"))
    return taken.withColumn("plan", F.get(pool._orders_column(3), F.col("order_no"))).drop("order_no").join(own, "driver_id").join(direct, ["v_o", "v_d"])


def planned_edges(trips: DataFrame, table: DataFrame) -> DataFrame:
    """Road edges of the planned legs: (pool_id, leg, seq, u, v)."""
    way = pool.with_points(trips).withColumn("_way", F.concat(F.array(F.lit(0)), F.col("plan"), F.array(F.size("points") - 1)))
    legs = way.select("pool_id", "points", "_way", F.explode(F.sequence(F.lit(0), F.size("_way") - 2)).alias("leg"))
    at = lambda i: F.get("points", F.get("_way", i))
    legs = cut_lineage(legs.select("pool_id", "leg", at(F.col("leg")).alias("src"), at(F.col("leg") + 1).alias("dst")))
    return legs.join(network.path_edges(legs, table), ["src", "dst"]).select("pool_id", "leg", "seq", "u", "v")


def replanned(spark, sf) -> DataFrame:
    def build():
        trips = cut_lineage(planned_trips(spark, sf))
        planned = cut_lineage(planned_edges(trips, od(spark, sf)))
        return cut_lineage(replan.replan(trips, planned, fixture(spark, sf, "edges"), fixture(spark, sf, "incidents"), POOL_LIMITS, costs=od(spark, sf)))

    return once(spark, sf, "replanned", build)


@query("i3_recourse_choice")
def i3(spark, sf):
    """Stop order of every planned trip after recourse: legs chained by arrival, incidents as they stand on each leg."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ">").alias(c)
    return replanned(spark, sf).select("driver_id", "pool_id", "severity", "triggered", text("plan"), text("chosen"), "nominal_objective", "realised_objective", "recourse_objective", "recourse_feasible")


@query("i4_trip_recovery")
def i4_trips(spark, sf):
    """Recovered share and regrets of the planned trips."""
    return recourse.recovery(replanned(spark, sf)).select("pool_id", "severity", "recovery_pct", "static_regret", "recourse_regret")


@query("i5_trip_summary")
def i5_trips(spark, sf):
    """Planned trips by the heaviest incident on their way, driven as planned and with recourse."""
    return recourse.summary(recourse.recovery(replanned(spark, sf)), ["severity"])


_TRIAL = """trial AS (SELECT rider_id AS trip_id, CASE rider_id % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'moderate' ELSE 'severe' END AS severity, 40e0 + (rider_id*37) % 600/10e0 AS nominal_objective,
    CASE WHEN (rider_id*13) % 10 < 3 THEN 0e0 ELSE 40e0 + (rider_id*37) % 600/10e0 - (rider_id*7) % 300/10e0 END AS realised_objective, (rider_id*13) % 10 >= 3 AS realised_feasible,
    CASE WHEN (rider_id*17) % 10 < 1 THEN 0e0 ELSE 40e0 + (rider_id*37) % 600/10e0 - (rider_id*3) % 100/10e0 END AS recourse_objective, (rider_id*17) % 10 >= 1 AS recourse_feasible,
    CASE WHEN rider_id % 5 <> 0 THEN 40e0 + (rider_id*37) % 600/10e0 + (rider_id*11) % 50/10e0 END AS best_objective FROM net_riders)"""
_RECOVERY = """rec AS (SELECT *, CASE WHEN nominal_objective > realised_objective AND NOT realised_feasible THEN round(least(100e0, recourse_objective/nominal_objective*100e0), 1)
    WHEN nominal_objective - realised_objective > 1e0 THEN round(least(100e0, greatest(0e0, (recourse_objective - realised_objective)/(nominal_objective - realised_objective)*100e0)), 1) END AS recovery_pct,
    CASE WHEN best_objective IS NOT NULL THEN round(greatest(0e0, best_objective - realised_objective), 2) END AS static_regret,
    CASE WHEN best_objective IS NOT NULL AND recourse_feasible THEN round(greatest(0e0, best_objective - recourse_objective), 2) END AS recourse_regret FROM trial)"""


def trials(spark, sf) -> DataFrame:
    r = fixture(spark, sf, "net_riders")
    k = "rider_id"
    return r.selectExpr(
        f"{k} AS trip_id", f"CASE {k} % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'moderate' ELSE 'severe' END AS severity", f"40e0 + ({k}*37) % 600/10e0 AS nominal_objective",
        f"CASE WHEN ({k}*13) % 10 < 3 THEN 0e0 ELSE 40e0 + ({k}*37) % 600/10e0 - ({k}*7) % 300/10e0 END AS realised_objective", f"({k}*13) % 10 >= 3 AS realised_feasible",
        f"CASE WHEN ({k}*17) % 10 < 1 THEN 0e0 ELSE 40e0 + ({k}*37) % 600/10e0 - ({k}*3) % 100/10e0 END AS recourse_objective", f"({k}*17) % 10 >= 1 AS recourse_feasible",
        f"CASE WHEN {k} % 5 <> 0 THEN 40e0 + ({k}*37) % 600/10e0 + ({k}*11) % 50/10e0 END AS best_objective")


@query("i4_recovery_regret", with_clause("net_riders") + ", " + _TRIAL + ", " + _RECOVERY + " SELECT trip_id, recovery_pct, static_regret, recourse_regret FROM rec")
def i4(spark, sf):
    return recourse.recovery(trials(spark, sf)).select("trip_id", "recovery_pct", "static_regret", "recourse_regret")


@query("i5_condition_summary", with_clause("net_riders") + ", " + _TRIAL + ", " + _RECOVERY + """ SELECT severity, count(*) AS trips, round(avg(CASE WHEN realised_feasible THEN 100e0 ELSE 0e0 END), 1) AS static_feasible_pct,
  round(avg(CASE WHEN recourse_feasible THEN 100e0 ELSE 0e0 END), 1) AS recourse_feasible_pct, round(avg(nominal_objective), 2) AS nominal_objective, round(avg(realised_objective), 2) AS static_objective,
  round(avg(recourse_objective), 2) AS recourse_objective, round(avg(recovery_pct), 1) AS recovery_pct, count(recovery_pct) AS recovery_defined, round(avg(static_regret), 2) AS static_regret,
  round(avg(recourse_regret), 2) AS recourse_regret FROM rec GROUP BY severity""")
def i5(spark, sf):
    return recourse.summary(recourse.recovery(trials(spark, sf)), ["severity"])


@query("g12_dwell_times", with_clause("cohorts") + f""", k AS (SELECT driver_id, rider_id, kind, CASE kind WHEN 'pickup' THEN 60e0 ELSE 25e0 END AS mean,
    {q.uniform('42', 'driver_id', 'rider_id', 'kind', '1')} AS u1, {q.uniform('42', 'driver_id', 'rider_id', 'kind', '2')} AS u2 FROM cohorts CROSS JOIN (VALUES ('pickup'), ('dropoff')) AS t(kind))
  SELECT driver_id, rider_id, kind, round(greatest(5e0, least(3e0*mean, exp(ln(mean) - ln(1e0 + 0.35e0*0.35e0)/2e0 + sqrt(ln(1e0 + 0.35e0*0.35e0))*sqrt(-2e0*ln(u1))*cos(2e0*pi()*u2)))), 3) AS dwell_s FROM k""")
def g12(spark, sf):
    c = fixture(spark, sf, "cohorts").select("driver_id", "rider_id", F.explode(F.array(F.lit("pickup"), F.lit("dropoff"))).alias("kind"))
    u = lambda n: recourse.hashed_uniform(F.lit(42), "driver_id", "rider_id", "kind", F.lit(n))
    return c.select("driver_id", "rider_id", "kind", F.round(recourse.dwell_seconds(F.col("kind"), u(1), u(2)), 3).alias("dwell_s"))


HORIZON_S = 4200.0
_LIFE = f"""life AS (SELECT request_id, min(t_s) FILTER (type = 'CREATED') AS created_s, min(t_s) FILTER (type = 'ASSIGNED') AS assigned_s, min(t_s) FILTER (type = 'PICKED_UP') AS picked_s,
    min(t_s) FILTER (type = 'COMPLETED') AS completed_s, min(t_s) FILTER (type = 'CANCELLED') AS cancelled_s FROM dispatch_events WHERE t_s <= {HORIZON_S} GROUP BY request_id),
  req AS (SELECT *, picked_s - created_s AS wait_s, completed_s - picked_s AS ride_s, completed_s - created_s AS total_s, CASE WHEN completed_s IS NOT NULL THEN 'COMPLETED' WHEN picked_s IS NOT NULL THEN 'PICKED_UP'
    ELSE 'CANCELLED' END AS status, CASE WHEN request_id % 2 = 0 THEN 'static' ELSE 'event' END AS policy, CASE request_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'balanced' ELSE 'high' END AS regime FROM life)"""


def requests(spark, sf) -> DataFrame:
    r = dispatch.request_lifecycle(fixture(spark, sf, "dispatch_events"), HORIZON_S)
    third = F.col("request_id") % 3
    return r.withColumns({"policy": F.when(F.col("request_id") % 2 == 0, "static").otherwise("event"),
                          "regime": F.when(third == 0, "low").when(third == 1, "balanced").otherwise("high")})


@query("d1_request_lifecycle", with_clause("dispatch_events") + ", " + _LIFE + " SELECT request_id, wait_s, ride_s, total_s, status FROM req")
def d1(spark, sf):
    return requests(spark, sf).select("request_id", "wait_s", "ride_s", "total_s", "status")


def _policy_sql(keys: str) -> str:
    q_ = lambda c: f"round(avg({c}), 6) AS mean_{c}, round(quantile_cont({c}, 0.5), 6) AS p50_{c}, round(quantile_cont({c}, 0.95), 6) AS p95_{c}"
    return f"""SELECT {keys}, count(*) AS requests, round(count(*) FILTER (status = 'COMPLETED')*100e0/count(*), 2) AS fulfilled_pct, round(count(*) FILTER (status = 'CANCELLED')*100e0/count(*), 2) AS cancelled_pct,
  {q_('wait_s')}, {q_('total_s')} FROM req GROUP BY {keys}"""


@query("d2_policy_metrics", with_clause("dispatch_events") + ", " + _LIFE + " " + _policy_sql("policy, regime"))
def d2(spark, sf):
    return dispatch.policy_metrics(requests(spark, sf), ["policy", "regime"])


_D3 = ["fulfilled_pct", "mean_wait_s", "p95_wait_s"]


@query("d3_policy_comparison", with_clause("dispatch_events") + ", " + _LIFE + f", pm AS ({_policy_sql('policy, regime')}) SELECT a.regime, "
       + ", ".join(f"a.{c} AS static_{c}, b.{c} AS event_{c}, CASE WHEN a.{c} <> 0 THEN round((b.{c} - a.{c})/a.{c}*100e0, 2) END AS {c}_change_pct" for c in _D3)
       + " FROM (SELECT * FROM pm WHERE policy = 'static') a JOIN (SELECT * FROM pm WHERE policy = 'event') b ON a.regime = b.regime")
def d3(spark, sf):
    m = dispatch.policy_metrics(requests(spark, sf), ["policy", "regime"])
    return dispatch.compare_policies(m, "regime", "policy", "static", "event", _D3)


_STOPS = """stops AS (SELECT (request_id % 997) AS vehicle_id, request_id, CASE WHEN type = 'PICKED_UP' THEN 'pickup' ELSE 'dropoff' END AS kind, t_s, request_id*2 + CASE WHEN type = 'PICKED_UP' THEN 0 ELSE 1 END AS stop_no,
    CAST(request_id % 3 + 1 AS INT) AS seats, 4 AS capacity FROM dispatch_events WHERE type IN ('PICKED_UP', 'COMPLETED'))"""


@query("d4_itinerary_checks", with_clause("dispatch_events") + ", " + _STOPS + """, ld AS (SELECT *, sum(CASE WHEN kind = 'pickup' THEN seats ELSE -seats END) OVER (PARTITION BY vehicle_id ORDER BY t_s, stop_no ROWS UNBOUNDED PRECEDING) AS load FROM stops),
  pr AS (SELECT vehicle_id, request_id, min(CASE WHEN kind = 'pickup' THEN t_s END) AS p, min(CASE WHEN kind = 'dropoff' THEN t_s END) AS d FROM stops GROUP BY 1, 2)
  SELECT vehicle_id, overloads, negative_loads, max_load, precedence_errors FROM (SELECT vehicle_id, count(*) FILTER (load > capacity) AS overloads, count(*) FILTER (load < 0) AS negative_loads, CAST(max(load) AS BIGINT) AS max_load FROM ld GROUP BY 1) a
  JOIN (SELECT vehicle_id, count(*) FILTER (d IS NOT NULL AND (p IS NULL OR d < p)) AS precedence_errors FROM pr GROUP BY 1) b USING (vehicle_id)""")
def d4(spark, sf):
    e = fixture(spark, sf, "dispatch_events").filter(F.col("type").isin("PICKED_UP", "COMPLETED"))
    pick = F.col("type") == "PICKED_UP"
    stops = e.select(
        (F.col("request_id") % 997).alias("vehicle_id"), "request_id", F.when(pick, "pickup").otherwise("dropoff").alias("kind"), "t_s",
        (F.col("request_id") * 2 + F.when(pick, 0).otherwise(1)).alias("stop_no"), (F.col("request_id") % 3 + 1).cast("int").alias("seats"), F.lit(4).alias("capacity"))
    return dispatch.itinerary_violations(stops)
