"""Snippets of checking SQL, written independently of the Column expressions."""

from __future__ import annotations

from ridelattice.sources.fixtures import with_clause


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2e0*6371.0088e0*asin(sqrt(greatest(0e0, least(1e0, pow(sin(radians(({c})-({a}))/2e0),2) + "
        f"cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2e0),2))))))"
    )


def uniform(*parts: str) -> str:
    """Uniform in (0, 1) from the first 52 bits of an MD5."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) + 0.5e0)/4503599627370496e0)"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return (
        f"atan2(sin(radians(({d})-({b})))*cos(radians({c})), cos(radians({a}))*sin(radians({c})) - "
        f"sin(radians({a}))*cos(radians({c}))*cos(radians(({d})-({b}))))"
    )


def journeys_join(pickup: float, dest: float, minutes: float) -> str:
    """Pairs by plain join and filters, with distances."""
    return f"""pairs AS (SELECT * FROM (
  SELECT v.driver_id, r.rider_id, r.city, v.capacity, r.seats, v.identity_ok AND r.identity_ok AS ident, v.vehicle_ok, v.safety_flag,
    v.o_lat AS vo_lat, v.o_lon AS vo_lon, v.d_lat AS vd_lat, v.d_lon AS vd_lon,
    r.o_lat AS ro_lat, r.o_lon AS ro_lon, r.d_lat AS rd_lat, r.d_lon AS rd_lon,
    abs(v.dep_s - r.dep_s)/60e0 AS dep_diff_min,
    {hav('v.o_lat', 'v.o_lon', 'r.o_lat', 'r.o_lon')} AS pickup_km,
    {hav('v.d_lat', 'v.d_lon', 'r.d_lat', 'r.d_lon')} AS dest_km
  FROM riders r JOIN drivers v ON r.city = v.city AND abs(v.dep_s - r.dep_s) <= {minutes * 60}
    AND abs(v.o_lat - r.o_lat) <= {pickup / 110.0} AND abs(v.d_lat - r.d_lat) <= {dest / 110.0}
  ) t WHERE pickup_km <= {pickup}e0 AND dest_km <= {dest}e0)"""


FEATURES = f"""feat0 AS (SELECT *,
  (1e0 + cos({bearing('vo_lat', 'vo_lon', 'vd_lat', 'vd_lon')} - {bearing('ro_lat', 'ro_lon', 'rd_lat', 'rd_lon')}))/2e0 AS direction_sim,
  {hav('vo_lat', 'vo_lon', 'vd_lat', 'vd_lon')} AS driver_route_km,
  greatest(0e0, pickup_km + {hav('ro_lat', 'ro_lon', 'rd_lat', 'rd_lon')} + dest_km - {hav('vo_lat', 'vo_lon', 'vd_lat', 'vd_lon')}) AS detour_km
  FROM pairs)"""


def _xy(side: str) -> str:
    return ", ".join(
        f"6371.0088e0*radians({side}{e}_lon - lon0)*cos(radians(lat0)) AS {side}{e}x, 6371.0088e0*radians({side}{e}_lat - lat0) AS {side}{e}y"
        for e in ("o", "d")
    )


def _sampled(x: str, y: str, tol: float) -> str:
    """Share of samples of x near y, by testing each sample."""
    ex, ey = f"({y}dx-{y}ox)", f"({y}dy-{y}oy)"
    t = f"greatest(0e0, least(1e0, ((px-{y}ox)*{ex}+(py-{y}oy)*{ey})/({ex}*{ex}+{ey}*{ey})))"
    dist = f"sqrt(pow(px-{y}ox-({t})*{ex},2)+pow(py-{y}oy-({t})*{ey},2))"
    return f"""SELECT driver_id, rider_id, avg(CASE WHEN {dist} <= {tol}e0 + 1e-10 THEN 1e0 ELSE 0e0 END) AS share FROM (
      SELECT *, {x}ox + ({x}dx-{x}ox)*i/(n-1e0) AS px, {x}oy + ({x}dy-{x}oy)*i/(n-1e0) AS py FROM (
        SELECT *, unnest(range(0, n)) AS i FROM (
          SELECT *, CAST(least(2048, greatest(2, ceil(sqrt(pow({x}dx-{x}ox,2)+pow({x}dy-{x}oy,2))/0.1e0)+1)) AS BIGINT) AS n FROM plane))) GROUP BY driver_id, rider_id"""


def similarity(source: str = "pairs", tol: float = 0.5) -> str:
    return f"""mid AS (SELECT driver_id, rider_id, vo_lat, vo_lon, vd_lat, vd_lon, ro_lat, ro_lon, rd_lat, rd_lon,
    (least(vo_lat,vd_lat,ro_lat,rd_lat)+greatest(vo_lat,vd_lat,ro_lat,rd_lat))/2e0 AS lat0,
    (least(vo_lon,vd_lon,ro_lon,rd_lon)+greatest(vo_lon,vd_lon,ro_lon,rd_lon))/2e0 AS lon0 FROM {source}),
  plane AS (SELECT driver_id, rider_id, {_xy('v')}, {_xy('r')} FROM mid),
  fa AS ({_sampled('v', 'r', tol)}), fb AS ({_sampled('r', 'v', tol)}),
  sim AS (SELECT driver_id, rider_id, (fa.share + fb.share)/2e0 AS route_sim FROM fa JOIN fb USING (driver_id, rider_id))"""


GATED = """gated AS (SELECT *, direction_sim > 0.5e0 AS ok_direction, pickup_km <= 2e0 AS ok_pickup, dest_km <= 3e0 AS ok_dest,
  dep_diff_min <= 30e0 AS ok_departure, detour_km <= 5e0 AS ok_detour, ident AS ok_identity, vehicle_ok AS ok_vehicle,
  capacity >= seats AS ok_capacity, NOT safety_flag AS ok_safety,
  direction_sim > 0.5e0 AND pickup_km <= 2e0 AND dest_km <= 3e0 AND dep_diff_min <= 30e0 AND detour_km <= 5e0 AND ident
    AND vehicle_ok AND capacity >= seats AND NOT safety_flag AS eligible FROM {src})"""

RAW = (
    "100e0*0.25e0*greatest(0e0,1e0-pickup_km/2e0) + 100e0*0.20e0*greatest(0e0,1e0-dest_km/3e0) + 100e0*0.25e0*route_sim + "
    "100e0*0.10e0*direction_sim + 100e0*0.10e0*greatest(0e0,1e0-detour_km/5e0) + 100e0*0.10e0*greatest(0e0,1e0-dep_diff_min/30e0)"
)


def scored(*more: str) -> str:
    """WITH clause ending in table ``scored``: every feature, gate and the raw index of the standard pairs."""
    return (
        with_clause("riders", "drivers", *more) + ", " + journeys_join(2, 3, 30) + ", " + FEATURES + ", " + similarity() + ", "
        "feat AS (SELECT feat0.*, route_sim FROM feat0 JOIN sim USING (driver_id, rider_id)), " + GATED.format(src="feat")
        + f", scored AS (SELECT *, {RAW} AS raw, CAST(round(CAST({RAW} AS DECIMAL(20,8)), 2) AS DOUBLE) AS score FROM gated)"
    )
