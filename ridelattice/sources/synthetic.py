"""Scale-out generators: every draw is a hash of ids, so results do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.functions import geo
from ridelattice.operators.recourse import hashed_uniform
from ridelattice.operators.running import running_sum

# Fixed values of the corridor scenarios
SCENARIOS = {"thin": 4, "balanced": 12, "dense": 24}
LENGTH_KM = 8.0
NEGATIVE_CYCLE = 12  # modes 6..11: reversed, far, late, no identity, no vehicle check, no seats
PATIENCE_S = (60.0, 1200.0)


def _draw(low: float, high: float, *ids: Column | str) -> Column:
    return low + (high - low) * hashed_uniform(*ids)


def corridor_candidates(requests: DataFrame, seed: int = 11) -> DataFrame:
    """Candidates with labels for requests ``(request_id, idx, scenario)`` on an equatorial corridor."""
    n = F.lit(0)
    for name, count in SCENARIOS.items():
        n = F.when(F.col("scenario") == name, count).otherwise(n)
    c = requests.withColumn("slot", F.explode(F.sequence(F.lit(0), n - 1)))
    ids = lambda tag: (F.lit(seed), F.lit(tag), F.col("request_id"), F.col("slot"))
    per_request = lambda tag: (F.lit(seed), F.lit(tag), F.col("request_id"))
    mode = F.pmod(F.col("idx") + F.col("slot"), F.lit(NEGATIVE_CYCLE))
    c = c.withColumns({
        "mode": mode,
        "y0": F.when(mode == 7, 4.0).otherwise(_draw(-1.2, 1.2, *ids("y0"))),
        "y1": F.when(mode == 7, 4.0).otherwise(_draw(-1.5, 1.5, *ids("y1"))),
        "minutes": F.when(mode == 8, 75.0).otherwise(_draw(-25.0, 25.0, *ids("t"))),
        "distance_tolerance": _draw(0.35, 2.5, *per_request("dt")), "time_tolerance": _draw(5.0, 35.0, *per_request("tt")),
        "reverse": mode == 6, "identity_ok": mode != 9, "vehicle_ok": mode != 10, "capacity": F.when(mode == 11, 0).otherwise(2),
    })
    p = 0.05 + 0.90 * F.exp(-0.5 * ((F.abs("y0") + F.abs("y1")) / F.col("distance_tolerance") + F.abs("minutes") / F.col("time_tolerance")))
    c = c.withColumn("probability", F.when(F.col("reverse"), p * 0.15).otherwise(p))
    label = (F.pmod(F.col("idx"), F.lit(10)) != 0) & (hashed_uniform(*ids("label")) < F.col("probability"))
    km = lambda v: F.degrees(v / geo.EARTH_RADIUS_KM)
    xs, xe = F.when(F.col("reverse"), LENGTH_KM).otherwise(0.0), F.when(F.col("reverse"), 0.0).otherwise(LENGTH_KM)
    ys, ye = F.when(F.col("reverse"), F.col("y1")).otherwise(F.col("y0")), F.when(F.col("reverse"), F.col("y0")).otherwise(F.col("y1"))
    return c.withColumns({"relevant": label, "o_lat": km(ys), "o_lon": km(xs), "d_lat": km(ye), "d_lon": km(xe)})


def network_commuters(people: DataFrame, nodes: DataFrame, role: str, seed: int = 101) -> DataFrame:
    """Journeys on the network for people ``(id, town)``: drivers follow a street slice, riders any two nodes."""
    u = lambda tag: hashed_uniform(F.lit(seed), F.lit(role), F.lit(tag), F.col("id"))
    if role == "driver":
        row = F.floor(u("row") * 5)
        start = F.floor(u("s") * 4)
        end = start + 1 + F.floor(u("e") * (4 - start))
        o, d = row * 5 + start, row * 5 + end
    else:
        o = F.floor(u("o") * 25)
        d = F.pmod(o + 1 + F.floor(u("d") * 24), F.lit(25))
    j = people.select("id", "town", (F.col("town") * 25 + o).alias("o_node"), (F.col("town") * 25 + d).alias("d_node"),
                      F.floor(u("dep") * (20 if role == "driver" else 25)).alias("offset_min"))
    at = lambda tag: nodes.select(F.col("node").alias(f"{tag}_node"), F.col("lat").alias(f"{tag}_lat"), F.col("lon").alias(f"{tag}_lon"))
    return j.join(at("o"), "o_node").join(at("d"), "d_node")


def poisson_requests(slots: DataFrame, key: str, index: str, rate_per_min: float = 1.0, mean_patience_min: float = 8.0, seed: int = 42) -> DataFrame:
    """Poisson arrivals per key with bounded exponential patience.

    Arrival times are running sums of hashed exponential gaps, taken over blocks
    of the index so that one key's stream is summed in parallel.
    """
    u = lambda tag: hashed_uniform(F.lit(seed), F.lit(tag), F.col(key), F.col(index))
    gap = -F.log(u("gap")) * (60.0 / rate_per_min)
    out = running_sum(slots, [key], F.floor(F.col(index) / 256), [index], {"created_s": gap})
    patience = -F.log(u("patience")) * mean_patience_min * 60.0
    return out.withColumn("patience_s", F.greatest(F.lit(PATIENCE_S[0]), F.least(F.lit(PATIENCE_S[1]), patience)))


def disk_offset(lat: Column, lon: Column, u1: Column, u2: Column, radius_km: float = 0.1) -> tuple[Column, Column]:
    """Point moved uniformly within a disk."""
    r, angle = radius_km * F.sqrt(u1), 2 * math.pi * u2
    return (lat + F.degrees(r * F.sin(angle) / geo.EARTH_RADIUS_KM),
            lon + F.degrees(r * F.cos(angle) / (geo.EARTH_RADIUS_KM * F.cos(F.radians(lat)))))


def perturb_routes(drivers: DataFrame, query: Column, where: str, seed: int = 1) -> DataFrame:
    """Move the route's end points or its inner vertices by up to 100 m (route: array of lat/lon)."""
    last = F.size("route") - 1

    def move(p: Column, i: Column) -> Column:
        u = lambda tag: hashed_uniform(F.lit(seed), query, F.lit(where), F.col("driver_id"), i, F.lit(tag))
        la, lo = disk_offset(p["lat"], p["lon"], u(1), u(2))
        end = (i == 0) | (i == last)
        hit = end if where == "endpoints" else ~end
        return F.struct(F.when(hit, la).otherwise(p["lat"]).alias("lat"), F.when(hit, lo).otherwise(p["lon"]).alias("lon"))

    return drivers.withColumn("route", F.transform("route", move))


def departure_shift_min(query: Column, driver: Column, seed: int = 1) -> Column:
    return _draw(-5.0, 5.0, F.lit(seed), query, F.lit("departure"), driver)
