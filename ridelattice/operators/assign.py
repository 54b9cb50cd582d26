"""Batch assignment of requests to drivers under seat limits, and fleet rebalancing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.functions import geo
from ridelattice.operators.network import near_nodes, ranked_element, snap
from ridelattice.operators.running import running_row_number, running_sum
from ridelattice.session import cut_lineage

FRONT = 64  # edges per driver looked at in one round; later rounds see the rest
MIN_GAIN = 0.01


def _front(edges: DataFrame, n: int = FRONT) -> DataFrame:
    """First n edges per driver in global order (cut before the shuffle by the window group limit)."""
    w = Window.partitionBy("driver_id").orderBy(F.desc("score"), F.col("rider_id"))
    return edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def greedy_assignment(edges: DataFrame, max_rounds: int = 500) -> DataFrame:
    """Same result as taking edges one by one by (-score, driver, rider) while seats last.

    ``edges``: driver_id, rider_id, score, seats, capacity. A round decides every
    edge whose earlier competitors are all decided: the leading run of a driver's
    list in which each edge is its rider's best. Accepted riders and edges that no
    longer fit then leave, and the next round sees a shorter list.
    """
    alive = cut_lineage(edges.select("driver_id", "rider_id", "score", "seats", F.col("capacity").alias("room")).filter(F.col("seats") <= F.col("room")))
    accepted: list[DataFrame] = []
    for _ in range(max_rounds):
        if alive.isEmpty():
            break
        heads = alive.groupBy("rider_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("driver_id").alias("d")))["d"].alias("_head"))
        front = _front(alive).join(heads, "rider_id").withColumn("_is_head", F.col("_head") == F.col("driver_id"))
        # at most FRONT entries per driver
        lists = front.groupBy("driver_id", "room").agg(F.array_sort(F.collect_list(F.struct("_rn", "_is_head", "rider_id", "seats", "score"))).alias("list"))
        start = F.struct(F.lit(True).alias("open"), F.col("room").alias("room"), F.expr("CAST(array() AS ARRAY<STRUCT<rider_id: BIGINT, seats: INT, score: DOUBLE>>)").alias("taken"))

        def step(acc: Column, e: Column) -> Column:
            open_ = acc["open"] & e["_is_head"]
            take = open_ & (e["seats"] <= acc["room"])
            one = F.array(F.struct(e["rider_id"].alias("rider_id"), e["seats"].alias("seats"), e["score"].alias("score")))
            return F.struct(
                open_.alias("open"), F.when(take, acc["room"] - e["seats"]).otherwise(acc["room"]).alias("room"),
                F.when(take, F.concat(acc["taken"], one)).otherwise(acc["taken"]).alias("taken"))

        decided = cut_lineage(lists.select("driver_id", F.aggregate("list", start, step).alias("r")).select("driver_id", F.col("r.room").alias("_left"), "r.taken"))
        taken = decided.select("driver_id", F.inline("taken"))
        accepted.append(taken)
        alive = cut_lineage(
            alive.join(taken.select("rider_id"), "rider_id", "left_anti").join(decided.select("driver_id", "_left"), "driver_id", "left")
            .withColumn("room", F.coalesce("_left", "room")).drop("_left").filter(F.col("seats") <= F.col("room")))
    else:
        raise RuntimeError("assignment did not finish; raise max_rounds")
    if not accepted:
        return edges.select("driver_id", "rider_id", "seats", "score").limit(0)
    return reduce(DataFrame.unionByName, accepted)


def improve_assignment(edges: DataFrame, assigned: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Place unmatched riders and move riders to a better driver that still has room.

    Every round each rider proposes its best improving driver and each driver
    accepts proposals in score order while seats last, so the objective never
    falls and no capacity is exceeded.
    """
    e = cut_lineage(edges.select("driver_id", "rider_id", "score", "seats", "capacity"))
    now = cut_lineage(assigned.select("rider_id", "driver_id", "score", "seats"))
    for _ in range(max_rounds):
        used = now.groupBy("driver_id").agg(F.sum("seats").alias("_used"))
        cur = now.select("rider_id", F.col("driver_id").alias("_cur"), F.col("score").alias("_now"))
        offers = e.join(used, "driver_id", "left").join(cur, "rider_id", "left").withColumn("_room", F.col("capacity") - F.coalesce("_used", F.lit(0)))
        better = F.col("_now").isNull() | (F.col("score") > F.col("_now") + MIN_GAIN)
        offers = offers.filter((F.col("seats") <= F.col("_room")) & better & (F.coalesce("_cur", F.lit(-1)) != F.col("driver_id")))
        best = offers.groupBy("rider_id").agg(F.max_by(F.struct("driver_id", "score", "seats", "_room"), F.struct("score", (-F.col("driver_id")).alias("d"))).alias("o"))
        front = _front(best.select("rider_id", "o.*"))
        w = Window.partitionBy("driver_id").orderBy("_rn")
        moves = front.withColumn("_seats", F.sum("seats").over(w)).filter(F.col("_seats") <= F.col("_room"))
        moves = cut_lineage(moves.select("rider_id", "driver_id", "score", "seats"))
        if moves.isEmpty():
            break
        now = cut_lineage(now.join(moves.select("rider_id"), "rider_id", "left_anti").unionByName(moves))
    return now


def first_choice_assignment(edges: DataFrame) -> DataFrame:
    """Each rider's best driver; drivers take them in score order while seats last."""
    best = edges.groupBy("rider_id").agg(
        F.max_by(F.struct("driver_id", "score", "seats", "capacity"), F.struct("score", (-F.col("driver_id")).alias("d"))).alias("b")).select("rider_id", "b.*")
    run = running_sum(best, ["driver_id"], -F.floor(F.col("score")), [F.desc("score"), F.col("rider_id")], {"_seats": F.col("seats")})
    return run.filter(F.col("_seats") <= F.col("capacity")).drop("_seats")


def assignment_groups(assigned: DataFrame) -> DataFrame:
    """Riders per driver (at most the seat capacity), seats used and left, group score."""
    return assigned.groupBy("driver_id", "capacity").agg(
        F.array_join(F.array_sort(F.collect_list("rider_id")).cast("array<string>"), ",").alias("riders"),
        F.sum("seats").alias("seats_used"), F.round(F.sum("score"), 2).alias("group_score"),
    ).withColumn("seats_left", F.col("capacity") - F.col("seats_used"))


def assignment_metrics(assigned: DataFrame, riders: DataFrame, drivers: DataFrame, by: str, reference: Column) -> DataFrame:
    """Match rate, seat utilisation, objective, and gap to a given reference objective."""
    r = riders.groupBy(by).agg(F.count(F.lit(1)).alias("riders"))
    d = drivers.groupBy(by).agg(F.sum("capacity").alias("seats_total"))
    a = assigned.groupBy(by).agg(F.count(F.lit(1)).alias("matched"), F.sum("seats").alias("seats_used"), F.round(F.sum("score"), 2).alias("objective"))
    j = r.join(d, by).join(a, by, "left").fillna({"matched": 0, "seats_used": 0, "objective": 0.0}).withColumn("_ref", reference)
    gap = F.when(F.col("_ref") <= 1e-6, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), (F.col("_ref") - F.col("objective")) / F.col("_ref")) * 100.0, 2))
    return j.withColumns({
        "match_rate": F.round(F.col("matched") / F.col("riders"), 4), "utilisation": F.round(F.col("seats_used") / F.col("seats_total"), 4), "gap_pct": gap,
    }).drop("_ref")


# ---- rebalancing ----

# Fixed values
RELOCATION_KM = 6.0
RELOCATION_KMH = 25.0
#: First search radius for the nearest zone, and half the way round the Earth, within which every zone lies.
ZONE_KM, FARTHEST_KM = 5.0, 20_100.0


def nearest_zone(points: DataFrame, zones: DataFrame, lat: str, lon: str, key: str) -> DataFrame:
    """Nearest centroid, first zone wins ties; one plan for any number of zones.

    A grid join with a radius that grows fourfold until every point is placed. Without any zone there is nothing to
    place points in, and no row comes out.
    """
    nodes = zones.select(F.col("zone_id").alias("node"), "lat", "lon")
    left, found, radius = cut_lineage(points), [], ZONE_KM
    while True:
        hit = cut_lineage(snap(left, nodes, key, lat, lon, radius).select(key, F.col("node").alias("zone_id"), F.col("snap_km").alias("zone_km")))
        found.append(left.join(hit, key))
        left = cut_lineage(left.join(hit, key, "left_anti"))
        if radius >= FARTHEST_KM or left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        radius = min(4 * radius, FARTHEST_KM)


def zone_balance(placed: DataFrame, zones: DataFrame, multipliers: dict[int, float] | None = None) -> DataFrame:
    """Supply, target, surplus and deficit per zone."""
    rate = F.col("base_rate")
    for zone, m in (multipliers or {}).items():
        rate = F.when(F.col("zone_id") == zone, F.col("base_rate") * m).otherwise(rate)
    z = zones.withColumn("demand", rate)
    total = z.agg(F.sum("demand").alias("t")).scalar()
    fleet = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    supply = placed.groupBy("zone_id").agg(F.count(F.lit(1)).alias("supply"))
    z = z.withColumns({"_total": total, "_fleet": fleet}).join(supply, "zone_id", "left").fillna({"supply": 0})
    share = F.greatest(F.lit(1), F.bround(F.col("demand") / F.col("_total") * F.col("_fleet")).cast("bigint"))
    target = F.when((F.col("_total") > 0) & (F.col("_fleet") > 0), share).otherwise(F.ceil(F.col("demand") * 0.5))
    z = z.withColumn("target", target.cast("bigint"))
    diff = F.col("supply") - F.col("target")
    return z.withColumns({"surplus": F.greatest(diff, F.lit(0)), "deficit": F.greatest(-diff, F.lit(0))}).drop("_total", "_fleet")


def relocations(placed: DataFrame, balance: DataFrame, key: str, lat: str, lon: str, zones: DataFrame) -> DataFrame:
    """Directives: each deficit zone, in order of id, takes its nearest unused surplus drivers within 6 km.

    All zones propose at once to as many of their nearest drivers as they lack, leaving out drivers that a zone before
    them holds; a driver goes to the first zone that proposes. A zone that lost a driver proposes to the next one. When
    nothing changes any more, every zone has what it would get in its turn, for zones before it never lose a driver to it.
    """
    extra = running_row_number(placed, ["zone_id"], F.floor(F.col(key) / 1000), [key], "_rn")
    surplus = extra.join(balance.select("zone_id", "surplus"), "zone_id").filter(F.col("_rn") <= F.col("surplus"))
    free = cut_lineage(surplus.select(key, F.col("zone_id").alias("origin_zone"), lat, lon))
    short = balance.filter("deficit > 0").select("zone_id", "deficit").join(zones.select("zone_id", "lat", "lon"), "zone_id")
    near = near_nodes(free, short.select(F.col("zone_id").alias("node"), "lat", "lon"), key, lat, lon, RELOCATION_KM)
    near = near.join(free.select(key, "origin_zone"), key).withColumnRenamed("node", "target_zone")
    near = cut_lineage(near.join(short.select(F.col("zone_id").alias("target_zone"), "deficit"), "target_zone"))
    held = near.select(key, F.col("target_zone").alias("holder")).limit(0)
    mark = None
    while True:
        open_ = near.join(held, key, "left").filter(F.coalesce(F.col("holder") >= F.col("target_zone"), F.lit(True)))
        order = running_row_number(open_.drop("holder"), ["target_zone"], F.floor(F.col("km") * 100), ["km", "origin_zone", key], "_rn")
        asked = order.filter(F.col("_rn") <= F.col("deficit"))
        held = cut_lineage(asked.groupBy(key).agg(F.min("target_zone").alias("holder")))
        now = held.agg(F.count("*"), F.sum(F.hash(key, "holder").cast("bigint"))).first()
        if now == mark:
            break
        mark = now
    moved = near.join(held.withColumnRenamed("holder", "target_zone"), [key, "target_zone"]).select(key, "origin_zone", "target_zone", "km")
    return moved.withColumns({"transit_s": F.round(F.col("km") / RELOCATION_KMH * 3600.0, 1), "km": F.round("km", 3)})


def rebalance_report(directives: DataFrame, balance: DataFrame) -> DataFrame:
    """Moved vehicles, unmet demand before and after, gain, distances."""
    unmet = balance.agg(F.sum("deficit").alias("unmet_before"))
    moved = directives.agg(F.count(F.lit(1)).alias("moved"), F.round(F.avg("km"), 2).alias("mean_km"), F.round(F.sum("km"), 2).alias("total_km"))
    p95 = ranked_element(directives.withColumn("_all", F.lit(1)), ["_all"], "km", 0.95, 0.01, "p").agg(F.max("p")).scalar()
    j = moved.withColumns({"unmet_before": unmet.scalar(), "p95_km": F.round(p95, 2)})
    gain = F.when(F.col("unmet_before") > 0, F.round(F.col("moved") / F.col("unmet_before") * 100.0, 1)).otherwise(0.0)
    return j.withColumns({"unmet_after": F.col("unmet_before") - F.col("moved"), "gain_pct": gain}).select(
        "moved", "unmet_before", "unmet_after", "gain_pct", F.coalesce("mean_km", F.lit(0.0)).alias("mean_km"),
        F.coalesce("p95_km", F.lit(0.0)).alias("p95_km"), F.coalesce("total_km", F.lit(0.0)).alias("total_km"))
