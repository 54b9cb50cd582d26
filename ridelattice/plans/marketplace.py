"""Marketplace queries and their checking SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import Window

from ridelattice.functions import geo
from ridelattice.functions.money import estimated_trip, with_fare
from ridelattice.operators import market
from ridelattice.operators.running import running_row_number
from ridelattice.plans import sqltext as q
from ridelattice.plans.registry import query
from ridelattice.sources.fixtures import fixture, table, with_clause

_DEC = lambda *names: [F.col(n).cast("double").alias(n) for n in names]

_FARE_CTE = """fare0 AS (SELECT *, CAST(round(greatest(distance_km - 1, 0)*8, 2) AS DECIMAL(12,2)) AS distance_fare,
    CAST(round(duration_min*CAST(0.5 AS DECIMAL(3,1)), 2) AS DECIMAL(12,2)) AS time_fare, CAST(greatest(wait_min - 5, 0) AS DECIMAL(12,2)) AS wait_fare FROM bookings),
  fare1 AS (SELECT *, 50 + distance_fare + time_fare + wait_fare AS subtotal FROM fare0),
  fare2 AS (SELECT *, CAST(round(subtotal*least(greatest(surge, 1), 3), 2) AS DECIMAL(12,2)) AS surged FROM fare1),
  fare3 AS (SELECT *, CAST(round(surged*CAST(0.05 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS tax FROM fare2),
  fares AS (SELECT *, surged + tax AS total FROM fare3)"""


def fares(spark, sf):
    b = fixture(spark, sf, "bookings")
    c = F.col
    return with_fare(b, c("distance_km"), c("duration_min"), c("wait_min"), c("surge"), F.lit(Decimal("0")))


@query("g15_fare_breakdown", with_clause("bookings") + ", " + _FARE_CTE + """ SELECT booking_id, CAST(distance_fare AS DOUBLE) AS distance_fare,
  CAST(time_fare AS DOUBLE) AS time_fare, CAST(wait_fare AS DOUBLE) AS wait_fare, CAST(subtotal AS DOUBLE) AS subtotal,
  CAST(surged AS DOUBLE) AS surged, CAST(tax AS DOUBLE) AS tax, CAST(total AS DOUBLE) AS total FROM fares""")
def g15(spark, sf):
    return fares(spark, sf).select("booking_id", *_DEC("distance_fare", "time_fare", "wait_fare", "subtotal", "surged", "tax", "total"))


def _estimate_sql(src: str) -> str:
    return f"""est0 AS (SELECT *, {q.hav('o_lat', 'o_lon', 'd_lat', 'd_lon')} AS direct FROM {src}),
  est1 AS (SELECT *, CASE WHEN direct > 0.1e0 THEN direct*1.25e0 ELSE 0.5e0 END AS km FROM est0),
  est2 AS (SELECT *, greatest(5e0, km/35e0*60e0) AS minutes FROM est1),
  est3 AS (SELECT *, CAST(50 + CAST(round(greatest(km - 1e0, 0e0)*8e0, 2) AS DECIMAL(12,2)) + CAST(round(minutes*0.5e0, 2) AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS subtotal FROM est2),
  estimates AS (SELECT *, subtotal + CAST(round(subtotal*CAST(0.05 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS total FROM est3)"""


def estimates(spark, sf):
    r = fixture(spark, sf, "riders")
    km, minutes = estimated_trip(geo.haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("d_lat"), F.col("d_lon")))
    r = r.withColumn("km", km).withColumn("minutes", F.greatest(F.lit(5.0), F.col("km") / 35.0 * 60.0))
    return with_fare(r, F.col("km"), F.col("minutes"), F.lit(0), F.lit(Decimal("1")), F.lit(Decimal("0")))


@query("g16_fare_estimate", with_clause("riders") + ", " + _estimate_sql("riders") + """ SELECT rider_id, round(km, 4) AS km,
  round(minutes, 3) AS minutes, CAST(total AS DOUBLE) AS total FROM estimates""")
def g16(spark, sf):
    return estimates(spark, sf).select("rider_id", F.round("km", 4).alias("km"), F.round("minutes", 3).alias("minutes"), *_DEC("total"))


@query("b1_booking_detail", with_clause("bookings") + """ SELECT b.booking_id, b.status, CAST(b.distance_km AS DOUBLE) AS distance_km,
  c.c_name AS rider_name, s.s_name AS driver_name FROM bookings b LEFT JOIN customer c ON c.c_custkey = b.rider_id
  LEFT JOIN supplier s ON s.s_suppkey = b.driver_id""")
def b1(spark, sf):
    b = fixture(spark, sf, "bookings")
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("rider_id"), F.col("c_name").alias("rider_name"))
    drivers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("driver_id"), F.col("s_name").alias("driver_name"))
    return b.join(users, "rider_id", "left").join(drivers, "driver_id", "left").select(
        "booking_id", "status", *_DEC("distance_km"), "rider_name", "driver_name")


@query("b2_rider_bookings", with_clause("bookings") + """ SELECT rider_id, booking_id, status,
  row_number() OVER (PARTITION BY rider_id ORDER BY created_at DESC, booking_id) AS n FROM bookings""")
def b2(spark, sf):
    b = fixture(spark, sf, "bookings")
    # newest first: days count down
    day = -F.unix_date(F.to_date("created_at"))
    out = running_row_number(b, ["rider_id"], day, [F.desc("created_at"), F.col("booking_id")], "n")
    return out.select("rider_id", "booking_id", "status", "n")


@query("b3_driver_profile", """SELECT s.s_suppkey AS driver_id, s.s_name AS name, n.n_name AS home, p.p_type AS vehicle, p.p_size AS vehicle_size
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN part p ON p.p_partkey = s.s_suppkey*3""")
def b3(spark, sf):
    s, n, p = (table(spark, sf, t) for t in ("supplier", "nation", "part"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(p, p.p_partkey == s.s_suppkey * 3, "left")
        .select(F.col("s_suppkey").alias("driver_id"), F.col("s_name").alias("name"), F.col("n_name").alias("home"),
                F.col("p_type").alias("vehicle"), F.col("p_size").alias("vehicle_size"))
    )


_OFFERS = """offers AS (SELECT l_orderkey AS booking_id, l_suppkey AS driver_id, l_linenumber AS offer_no,
  CASE l_returnflag WHEN 'R' THEN 'ACCEPTED' WHEN 'A' THEN 'DECLINED' ELSE 'SENT' END AS status FROM lineitem)"""


def offers(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "ACCEPTED").when(F.col("l_returnflag") == "A", "DECLINED").otherwise("SENT")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("booking_id"), F.col("l_suppkey").alias("driver_id"), F.col("l_linenumber").alias("offer_no"), status.alias("status"))


@query("b4_open_requests", with_clause("bookings") + f""", {_OFFERS} SELECT o.driver_id, o.booking_id, o.offer_no, b.rider_id, CAST(b.distance_km AS DOUBLE) AS distance_km
  FROM offers o JOIN bookings b USING (booking_id) WHERE o.status = 'SENT' AND b.status = 'REQUESTED'""")
def b4(spark, sf):
    o = offers(spark, sf).filter(F.col("status") == "SENT").drop("status")
    b = fixture(spark, sf, "bookings").filter(F.col("status") == "REQUESTED")
    return o.join(b.select("booking_id", "rider_id", "distance_km"), "booking_id").select("driver_id", "booking_id", "offer_no", "rider_id", *_DEC("distance_km"))


@query("b5_driver_earnings", with_clause("bookings") + ", " + _FARE_CTE + """, clock AS (SELECT CAST(max(created_at) AS DATE) AS today FROM bookings)
  SELECT driver_id, CAST(sum(CASE WHEN status = 'COMPLETED' AND CAST(created_at AS DATE) = today THEN total ELSE 0 END) AS DOUBLE) AS today,
  CAST(sum(CASE WHEN status = 'COMPLETED' AND date_trunc('week', created_at) = date_trunc('week', today) THEN total ELSE 0 END) AS DOUBLE) AS week,
  CAST(sum(CASE WHEN status = 'COMPLETED' AND date_trunc('month', created_at) = date_trunc('month', today) THEN total ELSE 0 END) AS DOUBLE) AS month,
  count(*) FILTER (status = 'COMPLETED') AS rides, round(count(*) FILTER (status <> 'CANCELLED')/CAST(count(*) AS DOUBLE), 4) AS acceptance
  FROM fares, clock GROUP BY driver_id""")
def b5(spark, sf):
    f = fares(spark, sf)
    today = fixture(spark, sf, "bookings").agg(F.to_date(F.max("created_at")).alias("today"))
    # scalar subquery: one row, planned once
    f = f.withColumn("today", today.scalar())
    done = F.col("status") == "COMPLETED"
    earned = lambda rule: F.sum(F.when(done & rule, F.col("total")).otherwise(F.lit(Decimal("0")))).cast("double")
    same = lambda unit: F.date_trunc(unit, "created_at") == F.date_trunc(unit, "today")
    return f.groupBy("driver_id").agg(
        earned(F.to_date("created_at") == F.col("today")).alias("today"), earned(same("week")).alias("week"), earned(same("month")).alias("month"),
        F.count_if(done).alias("rides"), F.round(F.count_if(F.col("status") != "CANCELLED") / F.count(F.lit(1)), 4).alias("acceptance"))


@query("b6_latest_payment", """SELECT booking_id, line, CAST(amount AS DOUBLE) AS amount, status, attempts FROM (
  SELECT l_orderkey AS booking_id, l_linenumber AS line, round(l_extendedprice, 2) AS amount, l_linestatus AS status,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS attempts
  FROM lineitem) t WHERE rn = 1""")
def b6(spark, sf):
    li = table(spark, sf, "lineitem")
    # one pass with map-side combine instead of a window sort
    last = F.max_by(F.struct("l_linenumber", "l_extendedprice", "l_linestatus"), F.struct("l_shipdate", "l_linenumber", "l_partkey"))
    return li.groupBy(F.col("l_orderkey").alias("booking_id")).agg(last.alias("p"), F.count(F.lit(1)).alias("attempts")).select(
        "booking_id", F.col("p.l_linenumber").alias("line"), F.round("p.l_extendedprice", 2).alias("amount"), F.col("p.l_linestatus").alias("status"), "attempts")


@query("b6_status_timeline", with_clause("dispatch_events") + """ SELECT request_id, type, t_s, row_number() OVER (PARTITION BY request_id ORDER BY t_s, type) AS step,
  t_s - lag(t_s) OVER (PARTITION BY request_id ORDER BY t_s, type) AS since_previous FROM dispatch_events""")
def b6_timeline(spark, sf):
    # a request has at most five events, so its window is bounded
    w = Window.partitionBy("request_id").orderBy("t_s", "type")
    return fixture(spark, sf, "dispatch_events").select(
        "request_id", "type", "t_s", F.row_number().over(w).cast("bigint").alias("step"), (F.col("t_s") - F.lag("t_s").over(w)).alias("since_previous"))


_PROMO_CTE = """checked AS (SELECT f.*, p.code, p.max_uses, CASE WHEN p.code IS NULL THEN 'unknown' WHEN NOT p.is_active THEN 'inactive'
    WHEN f.total < p.min_amount THEN 'below minimum' ELSE 'ok' END AS reason,
    CASE WHEN p.discount_type = 'FLAT' THEN CAST(least(p.discount_value, f.total) AS DECIMAL(12,2))
      ELSE CAST(least(round(f.total*p.discount_value*CAST(0.01 AS DECIMAL(3,2)), 2), p.max_discount) AS DECIMAL(12,2)) END AS off
    FROM fares f LEFT JOIN promos p ON p.code = f.promo_code WHERE f.promo_code IS NOT NULL)"""


def checked_promos(spark, sf):
    return market.check_promos(fares(spark, sf), fixture(spark, sf, "promos"), F.col("total"))


@query("b7_promo_check", with_clause("bookings", "promos") + ", " + _FARE_CTE + ", " + _PROMO_CTE + """ SELECT booking_id, promo_code, reason,
  CAST(CASE WHEN reason = 'ok' THEN off ELSE 0 END AS DOUBLE) AS discount,
  CAST(greatest(total - CASE WHEN reason = 'ok' THEN off ELSE 0 END, 0) AS DOUBLE) AS final_amount FROM checked""")
def b7(spark, sf):
    return checked_promos(spark, sf).select("booking_id", "promo_code", "reason", *_DEC("discount", "final_amount"))


@query("b8_promo_application", with_clause("bookings", "promos") + ", " + _FARE_CTE + ", " + _PROMO_CTE + """ SELECT booking_id, promo_code, use_no,
  CAST(off AS DOUBLE) AS discount FROM (SELECT *, row_number() OVER (PARTITION BY promo_code ORDER BY created_at, booking_id) AS use_no
  FROM checked WHERE reason = 'ok') t WHERE use_no <= max_uses""")
def b8(spark, sf):
    return market.apply_promos(checked_promos(spark, sf)).select("booking_id", "promo_code", "use_no", *_DEC("discount"))


_LAST_RATING = """last AS (SELECT booking_id, rater_id, ratee_id, seq, stars FROM (SELECT *, row_number() OVER
  (PARTITION BY booking_id, rater_id, ratee_id ORDER BY seq DESC, stars DESC) AS rn FROM ratings) t WHERE rn = 1)"""


@query("b9_driver_ratings", with_clause("ratings") + f""", {_LAST_RATING}, agg AS (SELECT ratee_id, round(avg(stars), 1) AS avg_rating, count(*) AS reviews,
  {', '.join(f'count(*) FILTER (stars = {s}) AS stars_{s}' for s in range(1, 6))} FROM last GROUP BY ratee_id)
  SELECT s.s_suppkey AS driver_id, coalesce(avg_rating, 5e0) AS avg_rating, coalesce(reviews, 0) AS reviews,
  {', '.join(f'coalesce(stars_{s}, 0) AS stars_{s}' for s in range(1, 6))} FROM supplier s LEFT JOIN agg ON ratee_id = s.s_suppkey""")
def b9(spark, sf):
    drivers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("driver_id"))
    return market.driver_ratings(drivers, fixture(spark, sf, "ratings"))


@query("b9_latest_reviews", with_clause("ratings") + f""", {_LAST_RATING} SELECT ratee_id, booking_id, stars, n FROM (SELECT *,
  row_number() OVER (PARTITION BY ratee_id ORDER BY booking_id DESC, rater_id) AS n FROM last) t WHERE n <= 5""")
def b9_latest(spark, sf):
    last = market.latest_ratings(fixture(spark, sf, "ratings"))
    out = market.newest(last, "ratee_id", [F.desc("booking_id"), F.col("rater_id")], 5, "n")
    return out.select("ratee_id", "booking_id", "stars", F.col("n").cast("bigint").alias("n"))


@query("b10_wallet_ledger", with_clause("wallet_tx") + """ SELECT tx_id, user_id, CAST(credited AS DOUBLE) AS credited, CAST(debited AS DOUBLE) AS debited,
  CAST(credited - debited AS DOUBLE) AS balance, credited - debited < 0 AS overdraft FROM (SELECT *,
  sum(CASE WHEN type = 'CREDIT' THEN amount ELSE 0 END) OVER w AS credited, sum(CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END) OVER w AS debited
  FROM wallet_tx WINDOW w AS (PARTITION BY user_id ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING)) t""")
def b10(spark, sf):
    return market.wallet_ledger(fixture(spark, sf, "wallet_tx")).select("tx_id", "user_id", *_DEC("credited", "debited", "balance"), "overdraft")


@query("b11_ride_history", with_clause("bookings") + """ SELECT rider_id, booking_id, driver_name, n FROM (SELECT b.rider_id, b.booking_id, s.s_name AS driver_name,
  row_number() OVER (PARTITION BY b.rider_id ORDER BY b.created_at DESC, b.booking_id DESC) AS n FROM bookings b LEFT JOIN supplier s ON s.s_suppkey = b.driver_id
  WHERE b.status = 'COMPLETED') t WHERE n <= 50""")
def b11(spark, sf):
    b = fixture(spark, sf, "bookings").filter(F.col("status") == "COMPLETED").dropDuplicates(["booking_id", "rider_id"])
    top = market.newest(b, "rider_id", [F.desc("created_at"), F.desc("booking_id")], 50, "n")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("driver_id"), F.col("s_name").alias("driver_name"))
    return top.join(names, "driver_id", "left").select("rider_id", "booking_id", "driver_name", F.col("n").cast("bigint").alias("n"))


@query("b12_spend", with_clause("bookings") + ", " + _FARE_CTE + """ SELECT rider_id, strftime(created_at, '%Y-%m') AS month, CAST(sum(total) AS DOUBLE) AS spend, count(*) AS rides
  FROM fares WHERE status = 'COMPLETED' GROUP BY 1, 2 UNION ALL SELECT rider_id, 'all', CAST(sum(total) AS DOUBLE), count(*) FROM fares WHERE status = 'COMPLETED' GROUP BY 1""")
def b12(spark, sf):
    f = fares(spark, sf).filter(F.col("status") == "COMPLETED").withColumn("month", F.date_format("created_at", "yyyy-MM"))
    monthly = f.groupBy("rider_id", "month").agg(F.sum("total").alias("spend"), F.count(F.lit(1)).alias("rides"))
    # both grains from one pass over the fares
    grains = F.explode(F.array(F.col("month"), F.lit("all")))
    return monthly.withColumn("month", grains).groupBy("rider_id", "month").agg(
        F.sum("spend").cast("double").alias("spend"), F.sum("rides").alias("rides"))


_RECEIPT_TXN = """txn AS (SELECT booking_id, total, tax, subtotal FROM fares WHERE booking_id % 4 <> 0)"""


@query("b13_trip_receipt", with_clause("bookings") + ", " + _FARE_CTE + ", " + _RECEIPT_TXN + """ SELECT b.booking_id, coalesce(s.s_name, 'unassigned') AS driver,
  CAST(b.distance_km AS DOUBLE) AS distance_km, CAST(coalesce(t.total, 250) AS DOUBLE) AS total, CAST(coalesce(t.tax, 12) AS DOUBLE) AS tax,
  CASE WHEN t.booking_id IS NOT NULL THEN 'CARD' ELSE 'CASH' END AS method,
  CASE WHEN t.booking_id IS NOT NULL OR b.status = 'COMPLETED' THEN 'COMPLETED' ELSE 'PENDING' END AS payment
  FROM bookings b LEFT JOIN txn t USING (booking_id) LEFT JOIN supplier s ON s.s_suppkey = b.driver_id""")
def b13(spark, sf):
    b = fixture(spark, sf, "bookings").select("booking_id", "driver_id", "distance_km", "status")
    paid = fares(spark, sf).filter(F.col("booking_id") % 4 != 0).select("booking_id", "total", "tax", F.lit(True).alias("paid"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("driver_id"), F.col("s_name").alias("driver"))
    j = b.join(paid, "booking_id", "left").join(names, "driver_id", "left")
    has = F.col("paid").isNotNull()
    return j.select(
        "booking_id", F.coalesce("driver", F.lit("unassigned")).alias("driver"), *_DEC("distance_km"),
        F.coalesce("total", F.lit(Decimal("250"))).cast("double").alias("total"), F.coalesce("tax", F.lit(Decimal("12"))).cast("double").alias("tax"),
        F.when(has, "CARD").otherwise("CASH").alias("method"),
        F.when(has | (F.col("status") == "COMPLETED"), "COMPLETED").otherwise("PENDING").alias("payment"))


@query("b14_scheduled_rides", with_clause("riders") + ", " + _estimate_sql("riders") + """ SELECT rider_id, dep_s, CAST(total AS DOUBLE) AS estimate,
  CASE WHEN dep_s < 2700 THEN 'CONFIRMED' ELSE 'SCHEDULED' END AS status FROM estimates WHERE dep_s > 1800""")
def b14(spark, sf):
    # the clock is a parameter: rides after second 1800 lie in the future, those within 15 minutes are confirmed
    now = 1800
    e = estimates(spark, sf).filter(F.col("dep_s") > now)
    return e.select("rider_id", "dep_s", F.col("total").cast("double").alias("estimate"),
                    F.when(F.col("dep_s") < now + 900, "CONFIRMED").otherwise("SCHEDULED").alias("status"))


def routes(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("route_id"), F.col("p_name").alias("name"), F.col("p_type").alias("pickup_name"), F.col("p_brand").alias("dropoff_name"),
        F.concat(F.col("p_type"), F.lit(" street")).alias("pickup_address"), F.concat(F.col("p_brand"), F.lit(" gate")).alias("dropoff_address"),
        F.col("p_brand").alias("category"), (F.col("p_size") % 5).alias("group_key"))


@query("b15_route_search", """SELECT p_partkey AS route_id, p_name AS name, fav.c AS favourites FROM part LEFT JOIN
  (SELECT l_partkey, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY 1) fav ON fav.l_partkey = p_partkey
  WHERE p_size % 5 = 2 AND (p_name ILIKE '%1%' OR p_type ILIKE '%eco%' OR p_brand ILIKE '%1%' OR p_type || ' street' ILIKE '%1%' OR p_brand || ' gate' ILIKE '%1%')""")
def b15(spark, sf):
    hits = market.search_routes(routes(spark, sf).filter(F.col("group_key") == 2), "1")
    more = market.search_routes(routes(spark, sf).filter(F.col("group_key") == 2), "ECO", columns=("pickup_name",))
    found = hits.unionByName(more).dropDuplicates(["route_id"])
    fav = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("route_id")).agg(F.countDistinct("l_suppkey").alias("favourites"))
    return found.join(fav, "route_id", "left").select("route_id", "name", "favourites")


@query("b16_favourite_drivers", """SELECT user_id, driver_id, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = user_id AND o.o_orderkey % 97 = driver_id) AS has_ridden
  FROM (SELECT DISTINCT o_custkey AS user_id, l_suppkey % 97 AS driver_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45) f""")
def b16(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 45).select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    fav = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("user_id"), (F.col("l_suppkey") % 97).alias("driver_id")).distinct()
    ridden = o.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 97).alias("driver_id")).distinct().withColumn("_r", F.lit(True))
    return fav.join(ridden, ["user_id", "driver_id"], "left").select("user_id", "driver_id", F.col("_r").isNotNull().alias("has_ridden"))


@query("b17_status_funnel", with_clause("bookings") + """ SELECT status, count(*) AS bookings, CASE status WHEN 'REQUESTED' THEN 1 WHEN 'COMPLETED' THEN 5 ELSE 6 END AS step
  FROM bookings GROUP BY status""")
def b17(spark, sf):
    return market.status_funnel(fixture(spark, sf, "bookings")).withColumn("step", F.col("step").cast("int"))


def _text2(e: str) -> str:
    return f"CAST(CAST(round({e}*100e0)/100e0 AS DECIMAL(9,2)) AS VARCHAR)"


_POOL_CTE = f"""keyed AS (SELECT r.rider_id, r.dep_s, substr(md5({_text2('a.lat')} || '_' || {_text2('a.lon')} || '_' || {_text2('b.lat')} || '_' || {_text2('b.lon')}), 1, 12) AS route_hash
    FROM net_riders r JOIN nodes a ON a.node = r.o_node JOIN nodes b ON b.node = r.d_node),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY route_hash ORDER BY dep_s, rider_id) - 1 AS rn FROM keyed)"""


def pooled(spark, sf):
    r = fixture(spark, sf, "net_riders")
    n = fixture(spark, sf, "nodes")
    a = n.select(F.col("node").alias("o_node"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = n.select(F.col("node").alias("d_node"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    keyed = r.join(a, "o_node").join(b, "d_node").withColumn("route_hash", geo.route_hash(*map(F.col, ("a_lat", "a_lon", "b_lat", "b_lon"))))
    return market.route_pools(keyed.select("rider_id", "dep_s", "route_hash"), "route_hash", "dep_s", "rider_id")


@query("p8_route_pools", with_clause("net_riders", "nodes") + ", " + _POOL_CTE + """ SELECT rider_id, route_hash, CAST(floor(rn/4e0) AS BIGINT) AS pool_no, rn % 4 = 0 AS is_primary,
  CASE WHEN rn % 4 = 0 THEN 0e0 ELSE 15e0 END AS discount_pct FROM numbered""")
def p8(spark, sf):
    return pooled(spark, sf).select("rider_id", "route_hash", F.col("pool_no").cast("bigint").alias("pool_no"), "is_primary", "discount_pct")


@query("p9_pool_status", with_clause("net_riders", "nodes") + ", " + _POOL_CTE + """, of AS (SELECT rider_id, route_hash || '-' || CAST(CAST(floor(rn/4e0) AS BIGINT) AS VARCHAR) AS pool_id FROM numbered)
  SELECT rider_id AS booking_id, pool_id, riders, CASE WHEN riders > 1 THEN 15e0 ELSE 0e0 END AS discount_pct
  FROM of JOIN (SELECT pool_id, count(*) AS riders FROM of GROUP BY 1) s USING (pool_id)""")
def p9(spark, sf):
    p = pooled(spark, sf).select(
        F.col("rider_id").alias("booking_id"), F.concat_ws("-", "route_hash", F.col("pool_no").cast("bigint").cast("string")).alias("pool_id"), "is_primary")
    out = market.pool_status(p.filter(~F.col("is_primary")), p.filter("is_primary"))
    return out.select("booking_id", "pool_id", "riders", "discount_pct")
