"""Candidate pairs and their features.

The radius join is a grid-cell equi-join: requests carry the cell they lie in,
drivers are repeated into the few cells their radius touches. Cells and time
buckets are join keys, so no task ever sees the full product; a cell crowded on
either side is split into blocks whose number follows from both row counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.functions import geo

HOT_CELL_ROWS = 20_000


def as_requests(riders: DataFrame) -> DataFrame:
    """Prefix request columns with ``r_`` (ids keep their name)."""
    return riders.select("rider_id", *[F.col(c).alias(f"r_{c}") for c in riders.columns if c != "rider_id"])


def as_vehicles(drivers: DataFrame) -> DataFrame:
    """Prefix driver columns with ``v_`` (ids keep their name)."""
    return drivers.select("driver_id", *[F.col(c).alias(f"v_{c}") for c in drivers.columns if c != "driver_id"])


def pool_pairs(pools: DataFrame, riders: DataFrame, drivers: DataFrame) -> DataFrame:
    """Every driver offered to each request: an equi-join on ids, no filter."""
    return pools.select("rider_id", "driver_id").join(as_requests(riders), "rider_id").join(as_vehicles(drivers), "driver_id")


def _row_cells(row: Column, cell_deg: float, radius_km: float) -> Column:
    """Number of cells in a row: each covers the radius at the largest latitude that a neighbour of the row reaches.

    Rows that touch a pole have two cells, which are each other's neighbours, so a pair across the pole meets.
    """
    worst = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * cell_deg, F.lit(90.0))
    ratio = math.sin(min(radius_km / geo.EARTH_RADIUS_KM / 2, math.pi / 2)) / F.cos(F.radians(worst))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * (1 + 1e-9)
    return F.greatest(F.lit(1), F.floor(360.0 / width)).cast("bigint")


def cell_column(lon: Column, row: Column, cell_deg: float, radius_km: float) -> Column:
    """Cell of a longitude in its row; the row closes at 180 degrees."""
    n = _row_cells(row, cell_deg, radius_km)
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)


def cell_columns(lon: Column, row: Column, cell_deg: float, radius_km: float) -> Column:
    """The cell of a longitude and its neighbours round the row, each once."""
    n, at = _row_cells(row, cell_deg, radius_km), cell_column(lon, row, cell_deg, radius_km)
    return F.array_distinct(F.array(F.pmod(at - 1, n), at, F.pmod(at + 1, n)))


def radius_pairs(
    riders: DataFrame,
    drivers: DataFrame,
    pickup_km: float = 2.0,
    dest_km: float = 3.0,
    minutes: float = 30.0,
    by: Sequence[str] = ("city",),
    hot_rows: int = HOT_CELL_ROWS,
) -> DataFrame:
    """Pairs within the time, pickup and destination limits, with the two distances.

    ``by`` lists columns that must agree (the market). Same rows as the full
    product followed by the three filters.
    """
    cell = pickup_km / geo.KM_PER_DEGREE * (1 + 1e-9)
    bucket = 2 * minutes * 60.0
    r, v = as_requests(riders), as_vehicles(drivers)
    keys = [f"_by_{b}" for b in by] + ["_row", "_col", "_tb"]

    r = r.withColumns({f"_by_{b}": F.col(f"r_{b}") for b in by})
    r = r.withColumn("_row", F.floor(F.col("r_o_lat") / cell))
    r = r.withColumns({
        "_col": cell_column(F.col("r_o_lon"), F.col("_row"), cell, pickup_km),
        "_tb": F.floor(F.col("r_dep_s") / bucket),
    })

    v = v.withColumns({f"_by_{b}": F.col(f"v_{b}") for b in by})
    mine = F.floor(F.col("v_o_lat") / cell)
    v = v.withColumn("_row", F.explode(F.sequence(mine - 1, mine + 1)))
    # skip neighbour rows that lie further away than the radius
    gap = F.greatest(F.col("_row") * cell - F.col("v_o_lat"), F.col("v_o_lat") - (F.col("_row") + 1) * cell)
    v = v.filter(gap <= cell)
    v = v.withColumn("_col", F.explode(cell_columns(F.col("v_o_lon"), F.col("_row"), cell, pickup_km)))
    v = v.withColumns({"_o_reach": _lon_reach(F.col("v_o_lat"), pickup_km), "_d_reach": _lon_reach(F.col("v_d_lat"), dest_km)})
    span = minutes * 60.0
    v = v.withColumn("_tb", F.explode(F.sequence(
        F.floor((F.col("v_dep_s") - span) / bucket), F.floor((F.col("v_dep_s") + span) / bucket))))

    r, v = split_into_blocks(r, v, keys, F.col("rider_id"), F.col("driver_id"), hot_rows)
    near_in_time = F.abs(F.col("v_dep_s") - F.col("r_dep_s")) <= minutes * 60.0
    # the shuffle a large join needs anyway; keeps the probe side parallel when the other side is small
    joined = r.repartition(*keys, "_salt").join(v, [*keys, "_salt"]).filter(near_in_time & _in_box("d", dest_km) & _in_box("o", pickup_km))
    pickup = geo.haversine_km(F.col("v_o_lat"), F.col("v_o_lon"), F.col("r_o_lat"), F.col("r_o_lon"))
    dest = geo.haversine_km(F.col("v_d_lat"), F.col("v_d_lon"), F.col("r_d_lat"), F.col("r_d_lon"))
    joined = joined.drop(*keys, "_salt", "_o_reach", "_d_reach")
    joined = joined.withColumn("pickup_km", pickup).filter(F.col("pickup_km") <= pickup_km)
    return joined.withColumn("dest_km", dest).filter(F.col("dest_km") <= dest_km)


def _lon_reach(lat: Column, km: float) -> Column:
    """Widest difference in longitude, in degrees, to a point within ``km`` of one on the latitude."""
    worst = F.least(F.abs(lat) + km / geo.KM_PER_DEGREE, F.lit(90.0))
    ratio = math.sin(min(km / geo.EARTH_RADIUS_KM / 2, math.pi / 2)) / F.cos(F.radians(worst))
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * (1 + 1e-9) + 1e-9


def _in_box(end: str, km: float) -> Column:
    """Plain comparisons that every pair within ``km`` passes; most others are spared the trigonometry."""
    c = F.col
    east = F.abs(c(f"v_{end}_lon") - c(f"r_{end}_lon"))
    reach = c(f"_{end}_reach")
    near = F.abs(c(f"v_{end}_lat") - c(f"r_{end}_lat")) <= km / geo.KM_PER_DEGREE * (1 + 1e-9) + 1e-9
    return near & ((east <= reach) | (east >= 360.0 - reach))


def split_into_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Column, right_id: Column, hot_rows: int,
    counted: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Turn keys with more than ``hot_rows`` rows on either side into a grid of blocks, named by ``_salt``.

    A side is dealt by its id to as many parts as it has times ``hot_rows`` rows, and repeated once per part of the other
    side, so each pair meets in exactly one block and a block holds about ``hot_rows`` rows of each side at most. Both sides
    are counted in one map-side combined aggregate, and only hot keys survive it: a few at most, as each stands for ``hot_rows``
    rows, so they are sent to the rows and not the rows to them. ``counted`` are frames of the same keys that are cheaper to count.
    """
    one, none = F.lit(1), F.lit(0)
    l_keys, r_keys = counted or (left, right)
    both = l_keys.select(*keys, one.alias("_l"), none.alias("_r")).unionByName(r_keys.select(*keys, none.alias("_l"), one.alias("_r")))
    counts = both.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    parts = lambda c: F.greatest(one, F.ceil(F.col(c) / hot_rows).cast("int"))
    # a key on one side only has no pairs
    hot = F.broadcast(counts.filter((F.least("_l", "_r") > 0) & (F.greatest("_l", "_r") > hot_rows)).select(*keys, parts("_l").alias("_lp"), parts("_r").alias("_rp")))
    lp, rp = F.coalesce("_lp", one), F.coalesce("_rp", one)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = left.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.transform(F.sequence(none, rp - 1), lambda j: dealt(left_id, lp) * rp + j)))
    right = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.transform(F.sequence(none, lp - 1), lambda i: i * rp + dealt(right_id, rp))))
    return left.drop("_lp", "_rp"), right.drop("_lp", "_rp")


def pair_features(pairs: DataFrame, tolerance_km: float = 0.5, similarity: bool = True) -> DataFrame:
    """The eight pair features for two-point routes, as wide double columns."""
    v_o, v_d = (F.col("v_o_lat"), F.col("v_o_lon")), (F.col("v_d_lat"), F.col("v_d_lon"))
    r_o, r_d = (F.col("r_o_lat"), F.col("r_o_lon")), (F.col("r_d_lat"), F.col("r_d_lon"))
    if "pickup_km" not in pairs.columns:
        pairs = pairs.withColumn("pickup_km", geo.haversine_km(*v_o, *r_o))
    if "dest_km" not in pairs.columns:
        pairs = pairs.withColumn("dest_km", geo.haversine_km(*v_d, *r_d))
    pairs = pairs.withColumns({
        "direction_sim": geo.direction_similarity(v_o, v_d, r_o, r_d),
        "driver_route_km": geo.haversine_km(*v_o, *v_d),
        "_shared_km": geo.haversine_km(*r_o, *r_d),
        "dep_diff_min": F.abs(F.col("v_dep_s") - F.col("r_dep_s")) / 60.0,
        "detour_seconds": F.lit(0.0),
    })
    added = F.col("pickup_km") + F.col("_shared_km") + F.col("dest_km") - F.col("driver_route_km")
    pairs = pairs.withColumn("detour_km", F.greatest(F.lit(0.0), added)).drop("_shared_km")
    if similarity:
        pairs = geo.with_route_similarity_2pt(
            pairs, ("v_o_lat", "v_o_lon", "v_d_lat", "v_d_lon"), ("r_o_lat", "r_o_lon", "r_d_lat", "r_d_lon"), tolerance_km)
    return pairs


def road_features(features: DataFrame, snapped_riders: DataFrame, snapped_drivers: DataFrame, od: DataFrame) -> DataFrame:
    """Replace straight-line distances by road costs wherever a road route exists.

    ``snapped_*`` give ``o_node`` and ``d_node`` per journey, ``od`` the table
    (src, dst, km, s). Each feature falls back to its geometric value on its own.
    """
    base = features.join(
        snapped_riders.select("rider_id", F.col("o_node").alias("_rn"), F.col("d_node").alias("_rm")), "rider_id", "left"
    ).join(snapped_drivers.select("driver_id", F.col("o_node").alias("_vn"), F.col("d_node").alias("_vm")), "driver_id", "left")
    for tag, src, dst in (("mid", "_rn", "_rm"), ("direct", "_vn", "_vm")):
        base = _with_costs(base, od, src, dst, tag)
    return node_features(base, od).select(*features.columns)


def _with_costs(df: DataFrame, od: DataFrame, src: str, dst: str, tag: str) -> DataFrame:
    leg = od.select(F.col("src").alias(src), F.col("dst").alias(dst), F.col("km").alias(f"_{tag}_km"), F.col("s").alias(f"_{tag}_s"))
    return df.join(leg, [src, dst], "left")


def with_own_road(journeys: DataFrame, snapped: DataFrame, od: DataFrame, key: str) -> DataFrame:
    """Journeys with the nodes of their ends (``o_node``, ``d_node``) and the road between them (``road_km``, ``road_s``); null without."""
    j = journeys.join(snapped.select(key, "o_node", "d_node"), key, "left")
    leg = od.select(F.col("src").alias("o_node"), F.col("dst").alias("d_node"), F.col("km").alias("road_km"), F.col("s").alias("road_s"))
    return j.join(leg, ["o_node", "d_node"], "left")


def node_features(features: DataFrame, od: DataFrame) -> DataFrame:
    """Road costs for pairs that carry their four nodes (``_vn``, ``_vm``, ``_rn``, ``_rm``) and the roads ``_direct`` and ``_mid``.

    Pairs are shuffled twice, by their first nodes and by their last: the road from end to end is looked up both ways at once.
    Pairs without a node are spread by their ids, as they find no road anyway.
    """
    c = F.col
    both = od.select(c("src").alias("_vm"), c("dst").alias("_rm"), c("km").alias("_dest_km")).join(
        od.select(c("dst").alias("_vm"), c("src").alias("_rm"), c("km").alias("_last_km"), c("s").alias("_last_s")), ["_vm", "_rm"], "full")
    first = od.select(c("src").alias("_vn"), c("dst").alias("_rn"), c("km").alias("_pick_km"), c("s").alias("_pick_s"))
    base = features
    for leg, nodes in ((first, ["_vn", "_rn"]), (both, ["_vm", "_rm"])):
        known = c(nodes[0]).isNotNull() & c(nodes[1]).isNotNull()
        spread = F.when(known, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("rider_id", "driver_id"), F.lit(1000)).cast("int"))
        base = base.withColumn("_spread", spread).join(leg.withColumn("_spread", F.lit(0)), [*nodes, "_spread"], "left").drop("_spread")
    pooled_km = F.round(c("_pick_km") + c("_mid_km") + c("_last_km"), 4)
    pooled_s = F.round(c("_pick_s") + c("_mid_s") + c("_last_s"), 2)
    # greatest() skips nulls, so an unreachable leg must be kept null explicitly
    known = pooled_km.isNotNull() & c("_direct_km").isNotNull()
    detour = F.when(known, F.round(F.greatest(F.lit(0.0), pooled_km - c("_direct_km")), 4))
    seconds = F.when(known, F.round(F.greatest(F.lit(0.0), pooled_s - c("_direct_s")), 2))
    return base.withColumns({
        "pickup_km": F.coalesce(c("_pick_km"), c("pickup_km")),
        "dest_km": F.coalesce(c("_dest_km"), c("dest_km")),
        "detour_km": F.coalesce(detour, c("detour_km")),
        "detour_seconds": F.coalesce(seconds, F.lit(0.0)),
    })
