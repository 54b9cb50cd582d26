"""Geometry as Column expressions: distances, bearings, detours, route overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
EARTH_RADIUS_KM = 6371.0088
SAMPLE_SPACING_KM = 0.1
MAX_SAMPLES = 2048
NOMINAL_SPEED_KMH = 40.0

KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def bearing_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass bearing in 0..360."""
    return F.pmod(F.degrees(bearing_rad(lat1, lon1, lat2, lon2)) + 360.0, F.lit(360.0))


def direction_similarity(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """``(1 + cos(bearing(a,b) - bearing(c,d))) / 2``; points are (lat, lon) column pairs."""
    return bearing_similarity(bearing_rad(*a, *b), bearing_rad(*c, *d))


def bearing_similarity(one: Column, other: Column) -> Column:
    """``(1 + cos(difference)) / 2`` of two bearings in radians."""
    raw = (1.0 + F.cos(one - other)) / 2.0
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def insertion_detour_2pt(start: tuple, end: tuple, pickup: tuple, dropoff: tuple) -> Column:
    """Ordered insertion on a two-point route: the only edge takes both stops."""
    extra = haversine_km(*start, *pickup) + haversine_km(*pickup, *dropoff) + haversine_km(*dropoff, *end)
    return F.greatest(F.lit(0.0), extra - haversine_km(*start, *end))


def _legs(route: Column) -> Column:
    """Consecutive vertex pairs of a route ``ARRAY<STRUCT<lat,lon>>``."""
    return F.zip_with(
        F.slice(route, F.lit(1), F.size(route) - 1),
        F.slice(route, F.lit(2), F.size(route) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def polyline_km(route: Column) -> Column:
    return F.aggregate(
        _legs(route), F.lit(0.0),
        lambda acc, e: acc + haversine_km(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]),
    )


def insertion_detour(route: Column, p_lat: Column, p_lon: Column, q_lat: Column, q_lon: Column) -> Column:
    """Cheapest pickup-then-dropoff insertion on a polyline.

    One ordered fold over the edges remembers the cheapest pickup insertion seen
    so far, so a drop-off on a later edge costs that plus its own insertion.
    """
    inf = F.lit(float("inf"))
    between = haversine_km(p_lat, p_lon, q_lat, q_lon)

    def step(acc: Column, e: Column) -> Column:
        a, b = (e["a"]["lat"], e["a"]["lon"]), (e["b"]["lat"], e["b"]["lon"])
        edge = haversine_km(*a, *b)
        ap, qb = haversine_km(*a, p_lat, p_lon), haversine_km(q_lat, q_lon, *b)
        pick = F.greatest(F.lit(0.0), ap + haversine_km(p_lat, p_lon, *b) - edge)
        drop = F.greatest(F.lit(0.0), haversine_km(*a, q_lat, q_lon) + qb - edge)
        both = F.greatest(F.lit(0.0), ap + between + qb - edge)
        return F.struct(
            F.least(acc["best"], both, acc["pick"] + drop).alias("best"),
            F.least(acc["pick"], pick).alias("pick"),
        )

    zero = F.struct(inf.alias("best"), inf.alias("pick"))
    return F.aggregate(_legs(route), zero, step, lambda acc: acc["best"])


def geometric_detour(start: tuple, end: tuple, pickup: tuple, dropoff: tuple) -> Column:
    """Straight-line detour ``max(0, a + b + c - direct)``."""
    return insertion_detour_2pt(start, end, pickup, dropoff)


def with_route_similarity_2pt(
    df: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str],
    tolerance_km: float = 0.5, out: str = "route_sim",
) -> DataFrame:
    """Overlap of two two-point routes without building sample arrays.

    ``a`` and ``b`` name (start lat, start lon, end lat, end lon). The points of
    one route that lie within the tolerance of the other segment form a single
    interval, because a segment's neighbourhood is convex; counting uniform
    samples inside that interval gives the sampled share in closed form, inside
    whole-stage code generation.
    """
    lat0 = (F.least(a[0], a[2], b[0], b[2]) + F.greatest(a[0], a[2], b[0], b[2])) / 2
    lon0 = (F.least(a[1], a[3], b[1], b[3]) + F.greatest(a[1], a[3], b[1], b[3])) / 2
    keep = df.columns
    df = df.withColumns({"_lat0": lat0, "_lon0": lon0})
    df = df.withColumn("_k", F.cos(F.radians("_lat0")))
    xy = {}
    for tag, cols in (("a", a), ("b", b)):
        for end, la, lo in (("s", cols[0], cols[1]), ("e", cols[2], cols[3])):
            xy[f"_{tag}{end}x"] = F.lit(EARTH_RADIUS_KM) * F.radians(F.col(lo) - F.col("_lon0")) * F.col("_k")
            xy[f"_{tag}{end}y"] = F.lit(EARTH_RADIUS_KM) * F.radians(F.col(la) - F.col("_lat0"))
    df = df.withColumns(xy)
    tol = tolerance_km + 1e-10
    for x, y, share in (("a", "b", "_fa"), ("b", "a", "_fb")):
        df = covered_share(df, x, y, tol, share)
    return df.withColumn(out, (F.col("_fa") + F.col("_fb")) / 2).select(*keep, out)


def covered_share(df: DataFrame, x: str, y: str, tol: float, out: str) -> DataFrame:
    """Share of uniform samples of segment x within ``tol`` of segment y.

    The part of x that is near y remains in ``_lo`` and ``_hi``, as shares of x; ``_lo > _hi`` if there is none.
    """
    c = F.col
    df = df.withColumns({
        "_dx": c(f"_{x}ex") - c(f"_{x}sx"), "_dy": c(f"_{x}ey") - c(f"_{x}sy"),
        "_ex": c(f"_{y}ex") - c(f"_{y}sx"), "_ey": c(f"_{y}ey") - c(f"_{y}sy"),
        "_wx": c(f"_{x}sx") - c(f"_{y}sx"), "_wy": c(f"_{x}sy") - c(f"_{y}sy"),
        "_vx": c(f"_{x}sx") - c(f"_{y}ex"), "_vy": c(f"_{x}sy") - c(f"_{y}ey"),
    })
    df = df.withColumns({
        "_dd": c("_dx") * c("_dx") + c("_dy") * c("_dy"),
        "_ee": c("_ex") * c("_ex") + c("_ey") * c("_ey"),
        "_de": c("_dx") * c("_ex") + c("_dy") * c("_ey"),
        "_we": c("_wx") * c("_ex") + c("_wy") * c("_ey"),
        "_cr": c("_dx") * c("_ey") - c("_dy") * c("_ex"),
        "_wc": c("_wx") * c("_ey") - c("_wy") * c("_ex"),
        "_wd": c("_wx") * c("_dx") + c("_wy") * c("_dy"),
        "_vd": c("_vx") * c("_dx") + c("_vy") * c("_dy"),
        "_ww": c("_wx") * c("_wx") + c("_wy") * c("_wy"),
        "_vv": c("_vx") * c("_vx") + c("_vy") * c("_vy"),
    })
    none_lo, none_hi = F.lit(float("inf")), F.lit(float("-inf"))

    def disc(wd: str, ww: str, tag: str) -> dict:
        q = c(wd) * c(wd) - c("_dd") * (c(ww) - tol * tol)
        root = F.sqrt(F.greatest(q, F.lit(0.0)))
        return {
            f"_{tag}lo": F.when(q < 0, none_lo).otherwise((-c(wd) - root) / c("_dd")),
            f"_{tag}hi": F.when(q < 0, none_hi).otherwise((-c(wd) + root) / c("_dd")),
        }

    def band(base: Column, slope: Column, low: Column, high: Column, tag: str) -> dict:
        """t with low <= base + slope*t <= high."""
        t1, t2 = (low - base) / slope, (high - base) / slope
        inside = base.between(low, high)
        return {
            f"_{tag}lo": F.when(slope != 0, F.least(t1, t2)).when(inside, none_hi).otherwise(none_lo),
            f"_{tag}hi": F.when(slope != 0, F.greatest(t1, t2)).when(inside, none_lo).otherwise(none_hi),
        }

    length = F.sqrt(c("_ee"))
    df = df.withColumns({
        **disc("_wd", "_ww", "p"), **disc("_vd", "_vv", "q"),
        **band(c("_wc"), c("_cr"), -tol * length, tol * length, "n"),
        **band(c("_we"), c("_de"), F.lit(0.0), c("_ee"), "m"),
    })
    df = df.withColumns({"_slo": F.greatest("_nlo", "_mlo"), "_shi": F.least("_nhi", "_mhi")})
    slab = c("_slo") <= c("_shi")
    df = df.withColumns({
        "_lo": F.greatest(F.lit(0.0), F.least(c("_plo"), c("_qlo"), F.when(slab, c("_slo")).otherwise(none_lo))),
        "_hi": F.least(F.lit(1.0), F.greatest(c("_phi"), c("_qhi"), F.when(slab, c("_shi")).otherwise(none_hi))),
        "_n": F.least(F.lit(MAX_SAMPLES), F.greatest(F.lit(2), F.ceil(F.sqrt("_dd") / SAMPLE_SPACING_KM).cast("int") + 1)),
    })
    steps = c("_n") - 1
    hits = F.floor(c("_hi") * steps + 1e-9) - F.ceil(c("_lo") * steps - 1e-9) + 1
    return df.withColumn(out, F.when(c("_lo") <= c("_hi"), F.greatest(hits, F.lit(0)) / c("_n")).otherwise(F.lit(0.0)))


def with_route_similarity(df: DataFrame, a: str, b: str, tolerance_km: float = 0.5, out: str = "route_sim") -> DataFrame:
    """Overlap of two polylines (``ARRAY<STRUCT<lat,lon>>`` columns), sampled by arc length.

    Intermediate arrays are columns of their own, so that no sample recomputes them.
    """
    keep = df.columns
    lat, lon = (lambda p: p["lat"]), (lambda p: p["lon"])
    lo = lambda f: F.least(F.array_min(F.transform(a, f)), F.array_min(F.transform(b, f)))
    hi = lambda f: F.greatest(F.array_max(F.transform(a, f)), F.array_max(F.transform(b, f)))
    df = df.withColumns({"_lat0": (lo(lat) + hi(lat)) / 2, "_lon0": (lo(lon) + hi(lon)) / 2}).withColumn("_k", F.cos(F.radians("_lat0")))

    def plane(route: str) -> Column:
        return F.transform(route, lambda p: F.struct(
            (F.lit(EARTH_RADIUS_KM) * F.radians(p["lon"] - F.col("_lon0")) * F.col("_k")).alias("x"),
            (F.lit(EARTH_RADIUS_KM) * F.radians(p["lat"] - F.col("_lat0"))).alias("y")))

    df = df.withColumns({"_pa": plane(a), "_pb": plane(b)})
    pairs = lambda line: F.zip_with(
        F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1),
        lambda u, v: F.struct(u.alias("a"), v.alias("b"), F.hypot(v["x"] - u["x"], v["y"] - u["y"]).alias("len")))
    df = df.withColumns({"_ra": pairs("_pa"), "_rb": pairs("_pb")})
    passed = lambda raw: F.transform(raw, lambda g, i: F.struct(
        g["a"].alias("a"), g["b"].alias("b"), g["len"].alias("len"),
        F.aggregate(F.slice(raw, F.lit(1), i), F.lit(0.0), lambda acc, t: acc + t["len"]).alias("before")))
    df = df.withColumns({"_sa": passed("_ra"), "_sb": passed("_rb")})
    end = lambda c: F.element_at(c, -1)
    df = df.withColumns({f"_t{x}": end(f"_s{x}")["before"] + end(f"_s{x}")["len"] for x in "ab"})
    df = df.withColumns({
        f"_n{x}": F.least(F.lit(MAX_SAMPLES), F.greatest(F.lit(2), F.ceil(F.col(f"_t{x}") / SAMPLE_SPACING_KM).cast("int") + 1)) for x in "ab"})
    # the sample points first, then the test of each point against the other line
    for x in "ab":
        step = F.col(f"_t{x}") / (F.col(f"_n{x}") - 1)
        at = F.transform(F.sequence(F.lit(0), F.col(f"_n{x}") - 1), lambda i: F.struct(
            (step * i).alias("t"), F.coalesce(F.get(F.filter(f"_s{x}", lambda g: (g["len"] > 0) & (g["before"] + g["len"] >= step * i)), F.lit(0)), end(f"_s{x}")).alias("g")))
        df = df.withColumn(f"_at{x}", at)
        share = lambda m: F.when(m["g"]["len"] > 0, (m["t"] - m["g"]["before"]) / m["g"]["len"]).otherwise(0.0)
        df = df.withColumn(f"_pt{x}", F.transform(f"_at{x}", lambda m: F.struct(
            (m["g"]["a"]["x"] + share(m) * (m["g"]["b"]["x"] - m["g"]["a"]["x"])).alias("x"),
            (m["g"]["a"]["y"] + share(m) * (m["g"]["b"]["y"] - m["g"]["a"]["y"])).alias("y"))))
    for x, y in (("a", "b"), ("b", "a")):
        near = F.filter(f"_pt{x}", lambda p: F.exists(f"_s{y}", lambda g: _point_segment(p["x"], p["y"], g) <= tolerance_km + 1e-10))
        df = df.withColumn(f"_f{x}", F.size(near) / F.col(f"_n{x}"))
    return df.withColumn(out, (F.col("_fa") + F.col("_fb")) / 2).select(*keep, out)


def _point_segment(px: Column, py: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    q = dx * dx + dy * dy
    raw = ((px - s["a"]["x"]) * dx + (py - s["a"]["y"]) * dy) / q
    t = F.when(q > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(0.0)
    return F.hypot(px - s["a"]["x"] - t * dx, py - s["a"]["y"] - t * dy)


def nominal_route(km: Column, speed_kmh: float = NOMINAL_SPEED_KMH) -> tuple[Column, Column]:
    """Rounded distance and duration at a nominal speed."""
    return F.round(km, 4), F.round(km / speed_kmh * 3600.0, 2)


def route_hash(*numbers: Column) -> Column:
    """First 12 hex digits of the MD5 over coordinates written with two decimals."""
    text = F.concat_ws("_", *[(F.round(n * 100.0) / 100.0).cast("decimal(9,2)").cast("string") for n in numbers])
    return F.substring(F.md5(text), 1, 12)


def with_position(df: DataFrame, route: str, progress: Column, out: str = "position") -> DataFrame:
    """Point and bearing at a share 0..1 of a polyline: ``STRUCT<lat, lon, bearing>``."""
    keep = df.columns
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    df = df.withColumn("_raw", F.transform(_legs(F.col(route)), lambda e: F.struct(
        e["a"].alias("a"), e["b"].alias("b"), haversine_km(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]).alias("len"))))
    df = df.withColumn("_legs", F.transform("_raw", lambda e, i: F.struct(
        e["a"].alias("a"), e["b"].alias("b"), e["len"].alias("len"),
        F.aggregate(F.slice("_raw", F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x["len"]).alias("before"))))
    last = F.element_at("_legs", -1)
    df = df.withColumn("_target", t * (last["before"] + last["len"]))
    df = df.withColumn("_leg", F.coalesce(F.get(F.filter("_legs", lambda e: F.col("_target") <= e["before"] + e["len"]), F.lit(0)), last))
    leg = F.col("_leg")
    df = df.withColumn("_share", F.when(leg["len"] > 0, (F.col("_target") - leg["before"]) / leg["len"]).otherwise(0.0))
    point = F.struct(
        (leg["a"]["lat"] + (leg["b"]["lat"] - leg["a"]["lat"]) * F.col("_share")).alias("lat"),
        (leg["a"]["lon"] + (leg["b"]["lon"] - leg["a"]["lon"]) * F.col("_share")).alias("lon"),
        bearing_deg(leg["a"]["lat"], leg["a"]["lon"], leg["b"]["lat"], leg["b"]["lon"]).alias("bearing"))
    return df.withColumn(out, point).select(*keep, out)
