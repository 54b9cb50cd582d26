"""Pair features for routes of many points.

A route is ``ARRAY<STRUCT<lat, lon>>``. Both routes of a pair are cut into legs; a leg meets only those legs of the other
route whose boxes come within the tolerance. The part of a leg that is near another leg is one interval, known in closed
form, so no sample points are made. A pair's routes are compared in its row, numpy taking the rows of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.functions import geo
from ridelattice.operators.pairs import pair_features
from ridelattice.operators.stops import ragged, table

#: Cells of tables and pairs of legs that are worked on at a time.
CELLS = 1_000_000

def _route(side: str) -> Column:
    """The route, or the straight line where it is null, has fewer than two points or a point without a coordinate."""
    route = F.col(f"{side}_route")
    line = F.array(*[F.struct(F.col(f"{side}_{e}_lat").alias("lat"), F.col(f"{side}_{e}_lon").alias("lon")) for e in "od"])
    whole = (F.size(route) >= 2) & F.forall(route, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.when(whole, route).otherwise(line)


def bent_pair_features(pairs: DataFrame, tolerance_km: float = 0.5, similarity: bool = True) -> DataFrame:
    """The eight pair features along ``v_route`` and ``r_route``; pairs with equal ids are one pair.

    Distances and direction are those of the end points. The length is that of the driver's polyline, the detour the
    cheapest insertion on it, the overlap that of ``with_route_overlap``.
    """
    f = pair_features(pairs, similarity=False).withColumns({"v_route": _route("v"), "r_route": _route("r")})
    along = F.arrow_udf(_along, "struct<km: double, detour: double>").asNondeterministic()
    f = f.withColumn("_along", along("v_route", "r_o_lat", "r_o_lon", "r_d_lat", "r_d_lon"))
    f = f.withColumns({"driver_route_km": F.col("_along.km"), "detour_km": F.col("_along.detour")}).drop("_along")
    return with_route_overlap(f, tolerance_km) if similarity else f


def with_route_overlap(pairs: DataFrame, tolerance_km: float = 0.5, out: str = "route_sim") -> DataFrame:
    """Mean share of either route that lies within the tolerance of the other, on uniform samples by arc length.

    Needs ``rider_id``, ``driver_id``, ``v_route``, ``r_route``. Repeated vertices change nothing. The overlap is null if a
    route is null or has no length. All rows come back, rows with equal ids as one.
    """
    keys = ["rider_id", "driver_id"]
    rest = [n for n in pairs.columns if n not in (*keys, out)]
    share = F.arrow_udf(_overlap(tolerance_km), "double").asNondeterministic()
    # found before rows of equal ids become one, so that no route is shuffled
    return pairs.select(*keys, *rest, share("v_route", "r_route").alias(out)).dropDuplicates(keys)


def _runs(size: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows whose table, as wide as the largest of them, has at most ``most`` cells (one row at least)."""
    start = 0
    while start < len(size):
        wide = np.maximum.accumulate(size[start:]) * np.arange(1, len(size) - start + 1)
        n = max(1, int(np.searchsorted(wide, most, "right")))
        yield slice(start, start + n)
        start += n


def _coordinates(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lat, lon = points.flatten()
    return lat.to_numpy(zero_copy_only=False), lon.to_numpy(zero_copy_only=False)


def _hav(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Kilometres between points in radians."""
    up, over = np.sin((lat2 - lat1) / 2), np.sin((lon2 - lon1) / 2)
    return 2 * geo.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(up * up + np.cos(lat1) * np.cos(lat2) * over * over, 0.0, 1.0)))


def _along(route: pa.Array, p_lat: pa.Array, p_lon: pa.Array, q_lat: pa.Array, q_lon: pa.Array) -> pa.Array:
    """Length of each route, and the cheapest insertion of a pickup and a later drop-off, on one leg or on two."""
    start, size, points = ragged(route)
    lat, lon = (np.radians(x) for x in _coordinates(points))
    p, q = ([np.radians(x.to_numpy(zero_copy_only=False))[:, None] for x in ends] for ends in ((p_lat, p_lon), (q_lat, q_lon)))
    km, detour = np.zeros(len(route)), np.full(len(route), np.inf)
    with np.errstate(all="ignore"):
        for rows in _runs(size, CELLS):
            y, x = table(start[rows], size[rows], lat, np.nan), table(start[rows], size[rows], lon, np.nan)
            if y.shape[1] < 2:
                continue
            leg = np.arange(1, y.shape[1]) < size[rows][:, None]
            edge = _hav(y[:, :-1], x[:, :-1], y[:, 1:], x[:, 1:])
            to_p, to_q = _hav(y, x, p[0][rows], p[1][rows]), _hav(y, x, q[0][rows], q[1][rows])
            between = _hav(p[0][rows], p[1][rows], q[0][rows], q[1][rows])
            pick = np.where(leg, np.maximum(0.0, to_p[:, :-1] + to_p[:, 1:] - edge), np.inf)
            drop = np.where(leg, np.maximum(0.0, to_q[:, :-1] + to_q[:, 1:] - edge), np.inf)
            both = np.where(leg, np.maximum(0.0, to_p[:, :-1] + between + to_q[:, 1:] - edge), np.inf)
            before = np.minimum.accumulate(pick, 1)
            detour[rows] = both.min(1)
            if leg.shape[1] > 1:
                detour[rows] = np.minimum(detour[rows], (before[:, :-1] + drop[:, 1:]).min(1))
            km[rows] = np.where(leg, edge, 0.0).cumsum(1)[:, -1]
    return pa.StructArray.from_arrays([pa.array(x, mask=~np.isfinite(x)) for x in (km, detour)], names=["km", "detour"])


def _overlap(tolerance_km: float) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Mean share of either route within the tolerance of the other; null if one has no length."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = []
        for route in (a, b):
            start, size, points = ragged(route)
            sides.append((start, size, *_coordinates(points)))
        out = np.full(len(a), np.nan)
        with np.errstate(all="ignore"):
            for rows in _runs(np.maximum(1, sides[0][1] * sides[1][1]), CELLS):
                out[rows] = _shares(*[(table(start[rows], size[rows], lat, np.nan), table(start[rows], size[rows], lon, np.nan)) for start, size, lat, lon in sides], tolerance_km)
        return pa.array(out, mask=np.isnan(out))

    return run


def _shares(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tolerance_km: float) -> np.ndarray:
    """Both routes in the plane around the middle of both, leg against leg."""
    n = len(a[0])
    if a[0].shape[1] < 2 or b[0].shape[1] < 2:
        return np.full(n, np.nan)
    middle = lambda i: (np.fmin(np.fmin.reduce(a[i], 1), np.fmin.reduce(b[i], 1)) + np.fmax(np.fmax.reduce(a[i], 1), np.fmax.reduce(b[i], 1))) / 2
    lat0, lon0 = middle(0), middle(1)
    k = np.cos(np.radians(lat0))
    legs = [_Legs(geo.EARTH_RADIUS_KM * np.radians(lon - lon0[:, None]) * k[:, None], geo.EARTH_RADIUS_KM * np.radians(lat - lat0[:, None])) for lat, lon in (a, b)]
    la, lb = legs
    # every leg of one route beside every leg of the other, as far as their boxes meet
    per = lb.count[la.row]
    i = np.repeat(np.arange(len(la.row)), per)
    j = np.repeat(lb.first[la.row], per) + np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per)
    meet = np.ones(len(i), bool)
    for s, e in (("sx", "ex"), ("sy", "ey")):
        p0, p1, q0, q1 = (f(getattr(g, s), getattr(g, e))[at] for g, at in ((la, i), (lb, j)) for f in (np.minimum, np.maximum))
        meet &= (p0 <= q1 + tolerance_km + 1e-6) & (q0 <= p1 + tolerance_km + 1e-6)
    i, j = i[meet], j[meet]
    one = la.covered(i, lb, j, tolerance_km + 1e-10, n)
    other = lb.covered(j, la, i, tolerance_km + 1e-10, n)
    known = (la.total > 0) & (lb.total > 0)
    return np.where(known, (one / la.samples + other / lb.samples) / 2, np.nan)


class _Legs:
    """Legs of the routes of some rows, those without length left out, row by row."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        length = np.hypot(x[:, 1:] - x[:, :-1], y[:, 1:] - y[:, :-1])
        real = length > 0
        passed = np.where(real, length, 0.0).cumsum(1)
        self.total = passed[:, -1]
        self.samples = np.minimum(geo.MAX_SAMPLES, np.maximum(2, np.ceil(self.total / geo.SAMPLE_SPACING_KM) + 1))
        self.row = np.nonzero(real)[0]
        self.count = real.sum(1)
        self.first = np.cumsum(self.count) - self.count
        self.len = length[real]
        self.before = (passed - np.where(real, length, 0.0))[real]
        self.sx, self.sy, self.ex, self.ey = x[:, :-1][real], y[:, :-1][real], x[:, 1:][real], y[:, 1:][real]

    def covered(self, i: np.ndarray, other: _Legs, j: np.ndarray, tol: float, rows: int) -> np.ndarray:
        """Uniform samples per row that lie on the near part of one of the legs ``i``, each beside its leg ``j`` of the other route."""
        lo, hi = _near_part(*(getattr(g, f)[at] for g, at in ((self, i), (other, j)) for f in ("sx", "sy", "ex", "ey")), tol)
        some = lo <= hi
        i, lo, hi = i[some], lo[some], hi[some]
        row = self.row[i]
        step = self.total[row] / (self.samples[row] - 1)
        at = lambda share: (self.before[i] + share * self.len[i]) / step
        lo, hi = np.ceil(at(lo) - 1e-9).astype(np.int64), np.floor(at(hi) + 1e-9).astype(np.int64)
        order = np.lexsort((hi, lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        # the highest sample that earlier intervals of the row have covered
        wide = 2 * geo.MAX_SAMPLES
        reached = np.maximum.accumulate(hi + row * wide)
        last = np.maximum(np.concatenate(([-1], reached[:-1])), row * wide - 1) - row * wide
        return np.bincount(row, np.maximum(0, hi - np.maximum(lo, last + 1) + 1), rows)


def _near_part(sx, sy, ex, ey, ux, uy, wx, wy, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of segments s-e within ``tol`` of segments u-w, as shares from lo to hi; lo > hi if there is none."""
    dx, dy, fx, fy = ex - sx, ey - sy, wx - ux, wy - uy
    ax, ay, bx, by = sx - ux, sy - uy, sx - wx, sy - wy
    dd, ff = dx * dx + dy * dy, fx * fx + fy * fy

    def disc(px, py):
        along = px * dx + py * dy
        q = along * along - dd * (px * px + py * py - tol * tol)
        root = np.sqrt(np.maximum(q, 0.0))
        return np.where(q < 0, np.inf, (-along - root) / dd), np.where(q < 0, -np.inf, (-along + root) / dd)

    def band(base, slope, low, high):
        t, u = (low - base) / slope, (high - base) / slope
        inside = (base >= low) & (base <= high)
        return (np.where(slope != 0, np.minimum(t, u), np.where(inside, -np.inf, np.inf)), np.where(slope != 0, np.maximum(t, u), np.where(inside, np.inf, -np.inf)))

    length = np.sqrt(ff)
    (p0, p1), (q0, q1) = disc(ax, ay), disc(bx, by)
    n0, n1 = band(ax * fy - ay * fx, dx * fy - dy * fx, -tol * length, tol * length)
    m0, m1 = band(ax * fx + ay * fy, dx * fx + dy * fy, np.zeros(len(ff)), ff)
    s0, s1 = np.maximum(n0, m0), np.minimum(n1, m1)
    slab = s0 <= s1
    lo = np.minimum(np.minimum(p0, q0), np.where(slab, s0, np.inf))
    hi = np.maximum(np.maximum(p1, q1), np.where(slab, s1, -np.inf))
    return np.maximum(0.0, lo), np.minimum(1.0, hi)
