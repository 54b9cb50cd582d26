"""Stop orders of pools, driven in batches: numpy over the rows that Spark hands to a Python worker.

A row brings the places of its driver (``at``, ascending), the legs between them (``legs``: pos = i * size(at) + j, km, s), the
points of its pool (the driver's start, pickup and drop-off per rider, the driver's end) and the riders' seats. A leg that is not
listed has no route. Rows of equal numbers of riders are driven together, one stop at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ridelattice.functions.geo import EARTH_RADIUS_KM

# Objective weights, per-rider stretch of the detour limits
OBJECTIVE = {"seats": 40.0, "detour": 30.0, "ride": 15.0, "direct": 15.0}
STRETCH = 0.5
RIDE_FACTOR = 1.5

NOWHERE = np.iinfo(np.int64).min
#: Cells of the leg tables that are filled in at a time.
CELLS = 2_000_000


def stop_orders(k: int) -> list[list[int]]:
    """Orders of 2k stops with every pickup before its drop-off.

    Rider i (1-based) has stop 2i-1 (pickup) and 2i (drop-off): 1, 6, 90 orders for k = 1, 2, 3.
    """
    return [list(p) for p in itertools.permutations(range(1, 2 * k + 1)) if all(p.index(2 * i - 1) < p.index(2 * i) for i in range(1, k + 1))]


def ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Start and length of every list, and all values; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(size) - size, size, lists.flatten()


def _whole_numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values.cast(pa.int64()), int(NOWHERE)).to_numpy(zero_copy_only=False)


def table(start: np.ndarray, size: np.ndarray, values: np.ndarray, fill) -> np.ndarray:
    """Lists as the rows of one table, filled up at the right."""
    inside = np.arange(size.max(initial=0)) < size[:, None]
    out = np.full(inside.shape, fill, dtype=values.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[inside] = values[np.repeat(start, size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
    return out


def _alike(size: np.ndarray, cells: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of equal size, in runs of at most CELLS cells (one row at least)."""
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        most = max(1, CELLS // int(max(1, cells[rows].max())))
        for i in range(0, len(rows), most):
            yield rows[i: i + most]


class _Rows:
    """The columns of a batch."""

    def __init__(self, points: pa.Array, seats: pa.Array, capacity: pa.Array):
        start, self.size, values = ragged(points)
        self.points, self.start = _whole_numbers(values), start
        self.seat_start, self.riders, values = ragged(seats)
        self.seats = _whole_numbers(values)
        self.capacity = _whole_numbers(capacity)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points, seats and capacity of rows with equal numbers of riders."""
        k = int(self.riders[rows[0]])
        return self.points[self.start[rows][:, None] + np.arange(2 * k + 2)], self.seats[self.seat_start[rows][:, None] + np.arange(k)], self.capacity[rows]


class _Legs:
    """Leg costs of a batch; infinite where there is no route."""

    def __init__(self, at: pa.Array, legs: pa.Array):
        self.at_start, self.at_size, values = ragged(at)
        self.at = _whole_numbers(values)
        self.start, self.size, values = ragged(legs)
        pos, km, s = values.flatten()
        self.pos, self.km, self.s = _whole_numbers(pos), km.to_numpy(zero_copy_only=False), s.to_numpy(zero_copy_only=False)

    def between(self, rows: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """km and s from every point to every point of a row; a row may come several times, with other points."""
        rows, back = np.unique(rows, return_inverse=True)
        at = table(self.at_start[rows], self.at_size[rows], self.at, NOWHERE)
        if at.shape[1] == 0:
            none = np.full((*points.shape, points.shape[1]), np.inf)
            return none, none.copy()
        same = at[back][:, None, :] == points[:, :, None]
        place, known = same.argmax(2), same.any(2) & (points != NOWHERE)
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        listed = np.repeat(self.start[rows], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        cell = place[:, :, None] * self.at_size[rows][back][:, None, None] + place[:, None, :]
        both = known[:, :, None] & known[:, None, :]
        out = []
        for cost in (self.km, self.s):
            all_ = np.full((len(rows), at.shape[1] ** 2), np.inf)
            all_[row, self.pos[listed]] = cost[listed]
            out.append(np.where(both, all_[back[:, None, None], cell], np.inf))
        return out[0], out[1]


def _at(legs: np.ndarray, here, there) -> np.ndarray:
    if np.ndim(here) == 0 and np.ndim(there) == 0:
        return legs[:, here, there]
    return legs[np.arange(len(legs)), here, there]


def _drive(km: np.ndarray, s: np.ndarray, seats: np.ndarray, order) -> dict[str, np.ndarray]:
    """What adds up along an order (each stop a number, or one per row): whole km and s, infinite without a route, the top load, the mean ride."""
    n, k = seats.shape
    here, far, long = 0, np.zeros(n), np.zeros(n)
    load, top, ride = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for stop in order:
        far, long = far + _at(km, here, stop), long + _at(s, here, stop)
        who = (stop + 1) // 2 - 1
        size = seats[:, who] if np.ndim(who) == 0 else seats[np.arange(n), who]
        sign = np.where(stop % 2 == 1, 1, -1)
        load = load + sign * size
        top, ride, here = np.maximum(top, load), ride - sign * long, stop
    end = 2 * k + 1
    return {"km": far + _at(km, here, end), "s": long + _at(s, here, end), "top": top, "ride": ride / k, "direct_km": km[:, 0, end], "direct_s": s[:, 0, end]}


def _worth(d: dict[str, np.ndarray], k: int, capacity: np.ndarray, limits: dict[str, float]) -> np.ndarray:
    """Objective in hundredths, -1 where a limit is broken or a route is missing; rounded half up on eight decimals, then on two."""
    stretch = 1.0 + STRETCH * (k - 1)
    lim_km, lim_s = limits["detour_km"] * stretch, limits["detour_time_s"] * stretch
    more_km, more_s = np.maximum(0.0, d["km"] - d["direct_km"]), np.maximum(0.0, d["s"] - d["direct_s"])
    known = np.isfinite(d["km"]) & np.isfinite(d["s"]) & np.isfinite(d["direct_km"]) & np.isfinite(d["direct_s"])
    left = lambda v, lim: np.maximum(0.0, 1.0 - v / lim)
    o = OBJECTIVE
    score = o["seats"] * k / capacity + o["detour"] * left(more_s, lim_s) + o["ride"] * left(d["ride"], lim_s * RIDE_FACTOR) + o["direct"] * left(more_km, lim_km)
    ok = known & (more_km <= lim_km) & (more_s <= lim_s) & (d["top"] <= capacity)
    units = np.floor(np.where(ok, score, 0.0) * 1e8 + 0.5).astype(np.int64)
    return np.where(ok, (units + 500_000) // 1_000_000, -1)


def _nullable(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Numbers that are not finite are null."""
    return pa.array(values, type=kind, mask=~np.isfinite(values))


def _udf(run: Callable, kind: str) -> Callable:
    # once per row, wherever its result is used
    return F.arrow_udf(run, kind).asNondeterministic()


def best_order(limits: dict[str, float], max_k: int) -> Callable:
    """(at, legs, points, seats, capacity) -> the feasible order of the highest objective, the earlier of equals, or null."""
    orders = {k: stop_orders(k) for k in range(1, max_k + 1)}

    def run(at: pa.Array, legs: pa.Array, points: pa.Array, seats: pa.Array, capacity: pa.Array) -> pa.Array:
        all_, costs = _Rows(points, seats, capacity), _Legs(at, legs)
        worth, no = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        far, long = np.zeros(len(at)), np.zeros(len(at))
        with np.errstate(all="ignore"):
            for rows in _alike(all_.riders, np.maximum(costs.at_size, 8) ** 2):
                k = int(all_.riders[rows[0]])
                p, w, cap = all_.of(rows)
                km, s = costs.between(rows, p)
                for i, order in enumerate(orders.get(k, ())):
                    d = _drive(km, s, w, order)
                    found = _worth(d, k, cap, limits)
                    better = found > worth[rows]
                    now = rows[better]
                    worth[now], no[now], far[now], long[now] = found[better], i, d["km"][better], d["s"][better]
        mask = worth < 0
        return pa.StructArray.from_arrays(
            [pa.array(worth / 100.0), pa.array(no.astype(np.int32)), pa.array(far), pa.array(long)], names=["objective", "order_no", "km", "s"], mask=pa.array(mask))

    return _udf(run, "struct<objective: double, order_no: int, km: double, s: double>")


_DRIVEN = "km: double, s: double, max_load: int, mean_ride_s: double, direct_km: double, direct_s: double, detour_km: double, detour_s: double, _o: double"


def _driven(d: dict[str, np.ndarray], worth: np.ndarray) -> list[pa.Array]:
    more = lambda a, b: np.maximum(0.0, a - b)
    return [
        _nullable(d["km"]), _nullable(d["s"]), pa.array(d["top"].astype(np.int32)), pa.array(d["ride"]), _nullable(d["direct_km"]), _nullable(d["direct_s"]),
        _nullable(more(d["km"], d["direct_km"])), _nullable(more(d["s"], d["direct_s"])), pa.array(worth / 100.0, mask=worth < 0)]


_NAMES = [x.split(":")[0] for x in _DRIVEN.split(", ")]


def all_orders(limits: dict[str, float], max_k: int) -> Callable:
    """(at, legs, points, seats, capacity) -> every order with what it costs."""
    orders = {k: stop_orders(k) for k in range(1, max_k + 1)}

    def run(at: pa.Array, legs: pa.Array, points: pa.Array, seats: pa.Array, capacity: pa.Array) -> pa.Array:
        all_, costs = _Rows(points, seats, capacity), _Legs(at, legs)
        count = np.array([len(orders.get(int(k), ())) for k in all_.riders], np.int64)
        start = np.cumsum(count) - count
        total = int(count.sum())
        out = {n: np.zeros(total) for n in ("km", "s", "ride", "direct_km", "direct_s")} | {"top": np.zeros(total, np.int64)}
        worth, no = np.zeros(total, np.int64), np.zeros(total, np.int32)
        with np.errstate(all="ignore"):
            for rows in _alike(all_.riders, np.maximum(costs.at_size, 8) ** 2):
                k = int(all_.riders[rows[0]])
                p, w, cap = all_.of(rows)
                km, s = costs.between(rows, p)
                for i, order in enumerate(orders.get(k, ())):
                    d = _drive(km, s, w, order)
                    to = start[rows] + i
                    for n in out:
                        out[n][to] = d[n]
                    worth[to], no[to] = _worth(d, k, cap, limits), i
            values = pa.StructArray.from_arrays([pa.array(no), *_driven(out, worth)], names=["order_no", *_NAMES])
        return pa.ListArray.from_arrays(pa.array(np.append(start, total).astype(np.int32)), values)

    return _udf(run, f"array<struct<order_no: int, {_DRIVEN}>>")


def given_order(limits: dict[str, float]) -> Callable:
    """(at, legs, points, seats, capacity, stops) -> what the row's own order costs."""

    def run(at: pa.Array, legs: pa.Array, points: pa.Array, seats: pa.Array, capacity: pa.Array, stops: pa.Array) -> pa.Array:
        all_, costs = _Rows(points, seats, capacity), _Legs(at, legs)
        first, _, values = ragged(stops)
        values = _whole_numbers(values)
        out = {n: np.zeros(len(at)) for n in ("km", "s", "ride", "direct_km", "direct_s")} | {"top": np.zeros(len(at), np.int64)}
        worth = np.full(len(at), -1, np.int64)
        with np.errstate(all="ignore"):
            for rows in _alike(all_.riders, np.maximum(costs.at_size, 8) ** 2):
                k = int(all_.riders[rows[0]])
                p, w, cap = all_.of(rows)
                d = _drive(*costs.between(rows, p), w, [values[first[rows] + i] for i in range(2 * k)])
                for n in out:
                    out[n][rows] = d[n]
                worth[rows] = _worth(d, k, cap, limits)
            return pa.StructArray.from_arrays(_driven(out, worth), names=_NAMES)

    return _udf(run, f"struct<{_DRIVEN}>")


def _inserted(km: np.ndarray, s: np.ndarray, seats: np.ndarray, capacity: np.ndarray, others: list[np.ndarray], k: int, limits: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Worth and stops of the best place of the last rider's two stops among the others; -1 where there is none."""
    rows = len(seats)
    worth, best = np.full(rows, -1, np.int64), np.zeros((rows, 2 * k), np.int32)
    pick, drop = np.full(rows, 2 * k - 1), np.full(rows, 2 * k)
    for a in range(len(others) + 1):
        for b in range(a, len(others) + 1):
            order = [*others[:a], pick, *others[a:b], drop, *others[b:]]
            found = _worth(_drive(km, s, seats, order), k, capacity, limits)
            better = found > worth
            worth[better] = found[better]
            for i, stop in enumerate(order):
                best[better, i] = stop[better]
    return worth, best


def best_insertion(limits: dict[str, float]) -> Callable:
    """(at, legs, points, seats, capacity, stops) -> the best place of the last rider's two stops among the others, or null.

    Places are tried by pickup, then by drop-off; the earlier of equals is taken.
    """

    def run(at: pa.Array, legs: pa.Array, points: pa.Array, seats: pa.Array, capacity: pa.Array, stops: pa.Array) -> pa.Array:
        all_, costs = _Rows(points, seats, capacity), _Legs(at, legs)
        first, _, values = ragged(stops)
        values = _whole_numbers(values)
        worth = np.full(len(at), -1, np.int64)
        size = 2 * all_.riders
        start = np.cumsum(size) - size
        best = np.zeros(int(size.sum()), np.int32)
        with np.errstate(all="ignore"):
            for rows in _alike(all_.riders, np.maximum(costs.at_size, 8) ** 2):
                k = int(all_.riders[rows[0]])
                p, w, cap = all_.of(rows)
                km, s = costs.between(rows, p)
                found, order = _inserted(km, s, w, cap, [values[first[rows] + i] for i in range(2 * k - 2)], k, limits)
                worth[rows] = found
                best[start[rows][:, None] + np.arange(2 * k)] = order
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(best)).astype(np.int32)), pa.array(best))
        return pa.StructArray.from_arrays([pa.array(worth / 100.0), lists], names=["objective", "stops"], mask=pa.array(worth < 0))

    return _udf(run, "struct<objective: double, stops: array<int>>")


def best_insertions(limits: dict[str, float]) -> Callable:
    """(at, legs, points, seats, capacity, stops, new) -> for each new rider (r_o, r_d, seats), taken alone, what :func:`best_insertion` finds.

    The points, seats and stops are those of the trip without a new rider.
    """

    def run(at: pa.Array, legs: pa.Array, points: pa.Array, seats: pa.Array, capacity: pa.Array, stops: pa.Array, new: pa.Array) -> pa.Array:
        trips, costs = _Rows(points, seats, capacity), _Legs(at, legs)
        first, _, values = ragged(stops)
        values = _whole_numbers(values)
        _, count, asked = ragged(new)
        pick, drop, size = (_whole_numbers(x) for x in asked.flatten())
        trip = np.repeat(np.arange(len(at)), count)
        riders = trips.riders[trip] + 1
        worth = np.full(len(trip), -1, np.int64)
        length = 2 * riders
        start = np.cumsum(length) - length
        best = np.zeros(int(length.sum()), np.int32)
        with np.errstate(all="ignore"):
            for rows in _alike(riders, (np.maximum(costs.at_size, 8) ** 2)[trip]):
                k, own = int(riders[rows[0]]), trip[rows]
                p, w, cap = trips.of(own)
                p = np.column_stack([p[:, :-1], pick[rows], drop[rows], p[:, -1]])
                found, order = _inserted(*costs.between(own, p), np.column_stack([w, size[rows]]), cap, [values[first[own] + i] for i in range(2 * k - 2)], k, limits)
                worth[rows] = found
                best[start[rows][:, None] + np.arange(2 * k)] = order
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(best)).astype(np.int32)), pa.array(best))
        each = pa.StructArray.from_arrays([pa.array(worth / 100.0), lists], names=["objective", "stops"], mask=pa.array(worth < 0))
        return pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(count) - count, len(trip)).astype(np.int32)), each)

    return _udf(run, "array<struct<objective: double, stops: array<int>>>")


def valid_orders(max_k: int) -> Callable:
    """(seats, capacity) -> number of stop orders whose load never exceeds the seats of the vehicle."""
    orders = {k: stop_orders(k) for k in range(1, max_k + 1)}

    def run(seats: pa.Array, capacity: pa.Array) -> pa.Array:
        start, riders, values = ragged(seats)
        values, room = _whole_numbers(values), _whole_numbers(capacity)
        out = np.zeros(len(seats), np.int32)
        for k in np.unique(riders):
            rows = np.flatnonzero(riders == k)
            w = values[start[rows][:, None] + np.arange(k)]
            for order in orders.get(int(k), ()):
                load, top = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for stop in order:
                    load = load + (w[:, (stop + 1) // 2 - 1] if stop % 2 else -w[:, (stop + 1) // 2 - 1])
                    top = np.maximum(top, load)
                out[rows] += top <= room[rows]
        return pa.array(out)

    return _udf(run, "int")


def shortest_line(max_k: int) -> Callable:
    """(places, points, seats, capacity) -> the shortest straight-line tour that the seats allow, null if there is none.

    ``places``: node, rows of it among the nodes, lat, lon; ``whole`` tells whether each point is one of the nodes.
    """
    orders = {k: stop_orders(k) for k in range(1, max_k + 1)}

    def run(places: pa.Array, points: pa.Array, seats: pa.Array, capacity: pa.Array) -> pa.Array:
        all_ = _Rows(points, seats, capacity)
        first, size, values = ragged(places)
        node, times, lat, lon = values.flatten()
        node, times = _whole_numbers(node), _whole_numbers(times)
        lat, lon = (np.radians(x.to_numpy(zero_copy_only=False)) for x in (lat, lon))
        best, found = np.full(len(points), np.nan), np.zeros(len(points), bool)
        with np.errstate(all="ignore"):
            for rows in _alike(all_.riders, np.maximum(8 * size, 64)):
                k = int(all_.riders[rows[0]])
                p, w, cap = all_.of(rows)
                at = table(first[rows], size[rows], node, NOWHERE)
                if at.shape[1] == 0:
                    continue
                same = (at[:, None, :] == p[:, :, None]) & (p[:, :, None] != NOWHERE)
                at_row = first[rows][:, None] + same.argmax(2)
                at_row = np.minimum(at_row, len(node) - 1)
                known = same.any(2)
                found[rows] = known.all(1) & (times[at_row] == 1).all(1)
                y, x = lat[at_row], lon[at_row]
                up, over = np.sin((y[:, None, :] - y[:, :, None]) / 2), np.sin((x[:, None, :] - x[:, :, None]) / 2)
                h = up * up + np.cos(y)[:, :, None] * np.cos(y)[:, None, :] * over * over
                km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))
                for order in orders.get(k, ()):
                    d = _drive(km, km, w, order)
                    best[rows] = np.fmin(best[rows], np.where(d["top"] <= cap, d["km"], np.nan))
        return pa.StructArray.from_arrays([_nullable(best), pa.array(found)], names=["km", "whole"])

    return _udf(run, "struct<km: double, whole: boolean>")
