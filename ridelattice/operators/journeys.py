"""Pairs of journeys that start and end on nodes, with the road legs between them.

A leg depends on two nodes only, so legs are joined to what carries both nodes before riders and drivers meet: the own road to the
journey, the legs to a pickup and from a drop-off to the pairs of places that are near each other. A driver is repeated for the places
near its start and its end where requests start and end, and meets the requests by an equi-join on both. Only journeys are shuffled,
never their pairs, and a journey carries no more costs than a query asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.functions import geo
from ridelattice.operators.network import with_leg
from ridelattice.operators.pairs import HOT_CELL_ROWS, as_requests, as_vehicles, cell_column, cell_columns, split_into_blocks


def _place(side: str, end: str) -> list[str]:
    return [f"{side}_{end}_{c}" for c in ("node", "lat", "lon")]


def near_places(a: DataFrame, b: DataFrame, keys: Sequence[str], a_place: Sequence[str], b_place: Sequence[str], limit_km: float, out: str) -> DataFrame:
    """Pairs of places (node, lat, lon) of both sides within the limit, each once per ``keys``: a grid-cell equi-join."""
    cell = limit_km / geo.KM_PER_DEGREE * (1 + 1e-9)
    (_, a_lat, a_lon), (_, b_lat, b_lon) = a_place, b_place
    a = a.select(*keys, *a_place).distinct().withColumn("_row", F.floor(F.col(a_lat) / cell))
    a = a.withColumn("_col", cell_column(F.col(a_lon), F.col("_row"), cell, limit_km))
    mine = F.floor(F.col(b_lat) / cell)
    b = b.select(*keys, *b_place).distinct().withColumn("_row", F.explode(F.sequence(mine - 1, mine + 1)))
    b = b.withColumn("_col", F.explode(cell_columns(F.col(b_lon), F.col("_row"), cell, limit_km)))
    near = a.join(b, [*keys, "_row", "_col"]).drop("_row", "_col")
    return near.withColumn(out, geo.haversine_km(F.col(a_lat), F.col(a_lon), F.col(b_lat), F.col(b_lon))).filter(F.col(out) <= limit_km)


def _offers(v: DataFrame, starts: DataFrame, ends: DataFrame, same: Sequence[str]) -> DataFrame:
    """A driver in a row for each place of pickup and place of drop-off near its own."""
    return v.join(starts, [*same, *_place("v", "o")]).join(ends, [*same, *_place("v", "d")])


def _bucketed(offers: DataFrame, span: float, bucket: float) -> DataFrame:
    """Offers in the time buckets of the requests that they can meet."""
    at = F.col("v_dep_s")
    return offers.withColumn("_tb", F.explode(F.sequence(F.floor((at - span) / bucket), F.floor((at + span) / bucket))))


def pairs_of_offers(
    riders: DataFrame, drivers: DataFrame, pickup_km: float, dest_km: float, minutes: float, costed: Callable[[DataFrame], DataFrame],
    by: Sequence[str] = ("town",), hot_rows: int = HOT_CELL_ROWS,
) -> DataFrame:
    """The pairs of :func:`road_pairs` with what ``costed`` adds to the offers: a driver in a row for each place of pickup and drop-off.

    All riders between two places share an offer, so it is costed before riders and drivers meet. ``costed`` gets the columns of the
    driver and of both places, and keeps its rows.
    """
    c, span = F.col, minutes * 60.0
    bucket = 4 * span
    same = [f"_by_{b}" for b in by]
    r = as_requests(riders).withColumns({f"_by_{b}": c(f"r_{b}") for b in by}).withColumn("_tb", F.floor(c("r_dep_s") / bucket))
    v = as_vehicles(drivers).withColumns({f"_by_{b}": c(f"v_{b}") for b in by})
    starts = near_places(v, r, same, _place("v", "o"), _place("r", "o"), pickup_km, "pickup_km")
    ends = near_places(v, r, same, _place("v", "d"), _place("r", "d"), dest_km, "dest_km")
    keys = [*same, *_place("r", "o"), *_place("r", "d"), "_tb"]
    met = _offers(v.filter(c("v_dep_s").isNotNull()), starts, ends, same).drop(*(f"v_{b}" for b in by), *(f"v_{e}_{x}" for e in "od" for x in ("lat", "lon")), "pickup_km", "dest_km")
    near = costed(met).drop("v_o_node", "v_d_node")
    counted = r.select(keys), _bucketed(met, span, bucket).select(keys)
    r, v = split_into_blocks(r.select("rider_id", "r_dep_s", *keys), _bucketed(near, span, bucket), keys, c("rider_id"), c("driver_id"), hot_rows, counted)
    p = r.repartition(*keys, "_salt").join(v, [*keys, "_salt"])
    return p.filter(F.abs(c("v_dep_s") - c("r_dep_s")) <= span).drop(*keys, "_salt")


def road_pairs(
    riders: DataFrame, drivers: DataFrame, od: DataFrame, pickup_km: float, dest_km: float, minutes: float,
    by: Sequence[str] = ("town",), costs: Sequence[str] = ("km", "s"), hot_rows: int = HOT_CELL_ROWS,
) -> DataFrame:
    """Pairs within the limits with straight-line features and five road legs.

    Journeys as for ``radius_pairs`` with ``o_node`` and ``d_node``; ``od`` has one row per (src, dst) with the columns ``costs``. The
    rows are those of ``radius_pairs``. Legs are ``direct`` (the driver alone), ``pick``, ``ride``, ``last`` (drop-off to the driver's
    end) and ``back`` (the reverse of ``last``), each as ``{leg}_{cost}``, null without a route.
    """
    c = F.col
    span = minutes * 60.0
    bucket = 4 * span
    same = [f"_by_{b}" for b in by]
    r = as_requests(riders).withColumns({f"_by_{b}": c(f"r_{b}") for b in by}).withColumn("_tb", F.floor(c("r_dep_s") / bucket))
    v = as_vehicles(drivers).withColumns({f"_by_{b}": c(f"v_{b}") for b in by})
    starts = near_places(v, r, same, _place("v", "o"), _place("r", "o"), pickup_km, "pickup_km")
    ends = near_places(v, r, same, _place("v", "d"), _place("r", "d"), dest_km, "dest_km")
    keys = [*same, *_place("r", "o"), *_place("r", "d"), "_tb"]

    offered = lambda v, starts, ends: _bucketed(_offers(v, starts, ends, same), span, bucket)
    counted = r.select(keys), offered(v, starts, ends).select(keys)
    leg = lambda df, src, dst, tag: with_leg(df, od, src, dst, tag, costs=costs)
    ends_of = lambda s: ((c(f"{s}_o_lat"), c(f"{s}_o_lon")), (c(f"{s}_d_lat"), c(f"{s}_d_lon")))
    line = lambda s: geo.haversine_km(*ends_of(s)[0], *ends_of(s)[1])
    bearing = lambda s: geo.bearing_rad(*ends_of(s)[0], *ends_of(s)[1])
    r = leg(r, "r_o_node", "r_d_node", "ride").withColumns({"shared_km": line("r"), "_r_bearing": bearing("r")})
    v = leg(v, "v_o_node", "v_d_node", "direct").withColumns({"driver_route_km": line("v"), "_v_bearing": bearing("v")})
    starts = leg(starts, "v_o_node", "r_o_node", "pick")
    ends = leg(leg(ends, "r_d_node", "v_d_node", "last"), "v_d_node", "r_d_node", "back")
    r, v = split_into_blocks(r, offered(v, starts, ends), keys, c("rider_id"), c("driver_id"), hot_rows, counted)
    near_in_time = F.abs(c("v_dep_s") - c("r_dep_s")) <= span
    p = r.repartition(*keys, "_salt").join(v, [*keys, "_salt"]).filter(near_in_time).drop(*same, "_tb", "_salt")
    return p.withColumns({
        "direction_sim": geo.bearing_similarity(c("_v_bearing"), c("_r_bearing")),
        "dep_diff_min": F.abs(c("v_dep_s") - c("r_dep_s")) / 60.0,
        "geo_detour_km": F.greatest(F.lit(0.0), c("pickup_km") + c("shared_km") + c("dest_km") - c("driver_route_km")),
    }).drop("_v_bearing", "_r_bearing")
