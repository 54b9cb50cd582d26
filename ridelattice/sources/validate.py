"""Validation: reasons per journey, id rules, and a data-quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.functions import geo

# Fixed values
MAX_ABS_LATITUDE = 70.0
MAX_EXTENT_DEG = 2.0
MAX_DIAGONAL_KM = 200.0
MIN_LENGTH_KM = 1e-6


def with_reasons(j: DataFrame) -> DataFrame:
    """Add ``reasons`` (ordered, empty when valid).

    Columns: o_lat, o_lon, d_lat, d_lon, departure, route (array of lat/lon
    structs), seats, capacity, safety_flags.
    """
    c = F.col
    lats, lons = F.transform("route", lambda p: p["lat"]), F.transform("route", lambda p: p["lon"])
    in_range = F.forall("route", lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180) & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"]))
    ends = (c("o_lat").between(-90, 90) & c("o_lon").between(-180, 180) & c("d_lat").between(-90, 90) & c("d_lon").between(-180, 180))
    south, north, west, east = F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons)
    wide = (
        (F.greatest(F.abs(south), F.abs(north)) > MAX_ABS_LATITUDE) | (north - south > MAX_EXTENT_DEG) | (east - west > MAX_EXTENT_DEG)
        | (geo.haversine_km(south, west, north, east) > MAX_DIAGONAL_KM))
    first, last = F.get("route", F.lit(0)), F.element_at("route", -1)
    same_ends = (first["lat"] == c("o_lat")) & (first["lon"] == c("o_lon")) & (last["lat"] == c("d_lat")) & (last["lon"] == c("d_lon"))
    rules = [
        (~F.coalesce(in_range & ends, F.lit(False)), "coordinate out of range"),
        (c("departure").isNull(), "departure missing"),
        (F.coalesce(F.size("route"), F.lit(0)) < 2, "route shorter than two points"),
        (wide, "outside the local domain"),
        (~same_ends, "route endpoints differ from start or destination"),
        (geo.haversine_km(c("o_lat"), c("o_lon"), c("d_lat"), c("d_lon")) <= MIN_LENGTH_KM, "start equals destination"),
        (c("seats") < 1, "seats below one"),
        (c("capacity") < 0, "negative capacity"),
        (F.exists("safety_flags", lambda f: F.trim(f) == ""), "blank safety flag"),
    ]
    return j.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules])))


def split(j: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their reasons."""
    r = with_reasons(j)
    return r.filter(F.size("reasons") == 0).drop("reasons"), r.filter(F.size("reasons") > 0)


def id_violations(drivers: DataFrame, riders: DataFrame) -> DataFrame:
    """Duplicate driver ids, duplicate rider ids, and ids used on both sides."""
    count = lambda df: df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    d, r = count(drivers), count(riders)
    pick = lambda df, kind: df.select(F.lit(kind).alias("violation"), "id", "n")
    shared = d.join(r.select("id", F.col("n").alias("_rn")), "id").withColumn("n", F.col("n") + F.col("_rn"))
    return pick(d.filter("n > 1"), "duplicate driver").unionByName(pick(r.filter("n > 1"), "duplicate rider")).unionByName(pick(shared, "driver and rider"))


def quality_report(j: DataFrame, key: str) -> DataFrame:
    """One pass over a journey table: missing, impossible, out of order, duplicates."""
    c = F.col
    return j.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c("departure").isNull()).alias("missing_departure"),
        F.count_if(c("o_lat").isNull() | c("o_lon").isNull() | c("d_lat").isNull() | c("d_lon").isNull()).alias("missing_coordinate"),
        F.count_if(~c("o_lat").between(-90, 90) | ~c("d_lat").between(-90, 90) | ~c("o_lon").between(-180, 180) | ~c("d_lon").between(-180, 180)).alias("impossible_coordinate"),
        F.count_if(c("arrival") < c("departure")).alias("arrival_before_departure"), F.count_if(c("seats") < 1).alias("bad_seats"),
        (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicate_ids"), F.round(F.min("o_lat"), 6).alias("min_lat"), F.round(F.max("o_lat"), 6).alias("max_lat"))
