"""Detours with legs chained by arrival time, searched in batches by numpy over the rows that Spark hands to a Python worker.

An offer is a driver with a place of pickup and a place of drop-off; all riders between these places share its detour. Offers lie by
the driver's start, or shares of them where they are many, beside the roads that can be reached from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.functions.congestion import DIRECTIONS, edge_direction, link_factors

#: Offers in a row, about.
MOST_OFFERS = 2048
#: Labels that are computed together, about.
MOST_LABELS = 1_000_000
OUT = ("dyn_km", "dyn_s", "dyn_ff_s")


def roads(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges that can be met from every place: ``(src, edges)``. ``reached``: pairs (src, dst) with a route, those of one place included."""
    c = F.col
    code = F.lit(len(DIRECTIONS) - 1)
    for i, d in enumerate(DIRECTIONS[:-1]):
        code = F.when(edge_direction(c("u_name"), c("v_name")) == d, i).otherwise(code)
    e = edges.select(c("u").cast("bigint"), c("v").cast("bigint"), c("km").cast("double"), c("secs").cast("double"), code.cast("bigint").alias("way")).dropna().distinct()
    near = reached.select("src", c("dst").cast("bigint").alias("u")).join(e, "u")
    return near.groupBy("src").agg(F.collect_list(F.struct("u", "v", "km", "secs", "way")).alias("edges"))


def chained_detours(offers: DataFrame, road: DataFrame, scenario: str, clock_start_hour: float = 8.0) -> DataFrame:
    """``offers`` with what the trip by the pickup and the drop-off takes more than the direct one: ``dyn_km``, ``dyn_s`` and ``dyn_ff_s``.

    ``offers``: ``v_o_node``, ``v_d_node``, ``v_dep_s``, ``r_o_node``, ``r_d_node`` and columns that are handed on. Each leg is entered when the
    one before it ends, and takes the earliest arrival as of :func:`network.earliest_arrival`; the differences are not floored. They
    are null where a leg has no route. ``road`` as of :func:`roads`.
    """
    c = F.col
    nodes = ("v_o_node", "v_d_node", "r_o_node", "r_d_node")
    offers = offers.withColumns({n: c(n).cast("bigint") for n in nodes} | {"_at": c("v_dep_s").cast("double")})
    share = offers.groupBy("v_o_node").agg(F.ceil(F.count(F.lit(1)) / MOST_OFFERS).alias("_shares")).withColumnRenamed("v_o_node", "_src")
    rows = offers.join(share, c("v_o_node").eqNullSafe(c("_src"))).withColumn("_share", F.pmod(F.xxhash64("_at", "v_d_node"), c("_shares")))
    rows = rows.groupBy("_src", "_share").agg(F.collect_list(F.struct(*offers.columns)).alias("offers"))
    rows = rows.join(road, c("_src") == c("src"), "left").select(c("_src").alias("src"), "offers", "edges")
    out = offers.schema
    for name in OUT:
        out = out.add(name, "double")
    return rows.mapInArrow(_detours(scenario, clock_start_hour), out).drop("_at")


def _detours(scenario: str, clock: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in _groups(batch):
                part = batch.slice(first, n)
                rows = part["offers"].flatten()
                columns = rows.flatten()
                names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
                values = {k: x.to_numpy(zero_copy_only=False).astype(np.float64) for k, x in zip(names, columns) if k in ("v_o_node", "v_d_node", "r_o_node", "r_d_node", "_at")}
                more = _group(part["src"], np.diff(part["offers"].offsets.to_numpy()), part["edges"], values, scenario, clock)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, from_pandas=True) for x in more)], names=[*names, *OUT])

    return run


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows that are searched together: first row and number."""
    size = np.diff(batch["offers"].offsets.to_numpy())
    wide = np.maximum(1, np.diff(batch["edges"].offsets.to_numpy()))
    first = labels = 0
    for i, more in enumerate((size * wide).tolist()):
        if i > first and labels + more > MOST_LABELS:
            yield first, i - first
            first, labels = i, 0
        labels += more
    if len(size) > first:
        yield first, len(size) - first


class _Net:
    """The networks of a group of rows side by side: out-edges of a node in one line, places numbered per row."""

    def __init__(self, src: pa.Array, edges: pa.ListArray) -> None:
        cut = edges.offsets.to_numpy() - edges.offsets[0].as_py()
        flat = [x.to_numpy(zero_copy_only=False) for x in edges.flatten().flatten()] if cut[-1] else [np.zeros(0)] * 5
        self.nodes, lines = [], []
        for g, s in enumerate(src.to_pylist()):
            u, v, km, secs, way = (x[cut[g]: cut[g + 1]] for x in flat)
            nodes = np.unique(np.concatenate([u, v, [] if s is None else [s]]))
            self.nodes.append(nodes)
            at = np.searchsorted(nodes, u)
            order = np.argsort(at, kind="stable")
            at = at[order]
            lines.append((g, at, np.arange(len(at)) - np.searchsorted(at, at), np.searchsorted(nodes, v[order]), km[order], secs[order], way[order]))
        self.size = max(1, *(len(n) for n in self.nodes))
        degree = max([int(x[2].max()) + 1 for x in lines if len(x[2])], default=1)
        shape = (len(lines) * self.size, degree)
        self.to, self.km, self.secs, self.way = np.zeros(shape, np.int64), np.zeros(shape), np.full(shape, np.inf), np.zeros(shape, np.int64)
        for g, at, place, v, km, secs, way in lines:
            line = g * self.size + at, place
            self.to[line], self.km[line], self.secs[line], self.way[line] = v, km, secs, way

    def placed(self, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Numbers of nodes in the networks of ascending rows, -1 where a node is not in it."""
        out, cut = np.full(len(node), -1), np.searchsorted(row, np.arange(len(self.nodes) + 1))
        for g, nodes in enumerate(self.nodes):
            here = node[cut[g]: cut[g + 1]]
            if len(nodes) and len(here):
                at = np.minimum(np.searchsorted(nodes, here), len(nodes) - 1)
                out[cut[g]: cut[g + 1]] = np.where(nodes[at] == here, at, -1)
        return out

    def search(self, row: np.ndarray, start: np.ndarray, depart: np.ndarray, scenario: str, clock: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrival, km and free-flow seconds per departure and node; the arrival is infinite where a node is not reached.

        The open node of the earliest arrival is final, as costs are positive, and its roads are entered at that moment. Of equal
        arrivals the one of fewer km and then fewer seconds counts.
        """
        n, each = len(row), np.arange(len(row))
        arrive, km, ff = (np.full((n, self.size), np.inf) for _ in range(3))
        arrive[each, start], km[each, start], ff[each, start] = depart, 0.0, 0.0
        open_ = arrive.copy()
        for _ in range(self.size):
            i = open_.argmin(axis=1)
            t = open_[each, i]
            known = np.isfinite(t)
            if not known.any():
                break
            open_[each, i] = np.inf
            line = row * self.size + i
            factor = link_factors(np.fmod(clock + np.where(known, t, 0.0) / 3600.0, 24.0), scenario)
            to, secs = self.to[line], self.secs[line]
            then = t[:, None] + secs * np.take_along_axis(factor, self.way[line], axis=1)
            far, free = km[each, i][:, None] + self.km[line], ff[each, i][:, None] + secs
            for d in range(to.shape[1]):
                v, a = to[:, d], then[:, d]
                old = arrive[each, v]
                better = a < old
                same = (a == old) & known
                if same.any():
                    better |= same & ((far[:, d] < km[each, v]) | ((far[:, d] == km[each, v]) & (free[:, d] < ff[each, v])))
                at = np.flatnonzero(better & np.isfinite(a))
                w = v[at]
                arrive[at, w] = open_[at, w] = a[at]
                km[at, w], ff[at, w] = far[at, d], free[at, d]
        return arrive, km, ff


def _group(src: pa.Array, count: np.ndarray, edges: pa.ListArray, offers: dict[str, np.ndarray], scenario: str, clock: float) -> list[np.ndarray]:
    """The differences of a group's offers in km, seconds and free-flow seconds; nan where a leg has no route."""
    net = _Net(src, edges)
    row = np.repeat(np.arange(len(src)), count)
    place = {k: net.placed(row, offers[k]) for k in ("v_o_node", "v_d_node", "r_o_node", "r_d_node")}
    known = np.isfinite(offers["_at"]) & np.all([p >= 0 for p in place.values()], axis=0)
    n = len(row)
    total = [np.full(n, np.nan) for _ in range(3)]
    step = max(1, MOST_LABELS // net.size)
    live = np.flatnonzero(known)

    def legs(of: np.ndarray, start: np.ndarray, depart: np.ndarray, ends: list[np.ndarray]) -> list[list[np.ndarray]]:
        """Arrival, km and seconds of the legs of offers ``of`` to each of the ends; equal departures are searched once."""
        keys = np.stack([row[of].astype(np.float64), start.astype(np.float64), depart])
        order = np.lexsort(keys[::-1])
        new = np.append(True, np.any(np.diff(keys[:, order], axis=1) != 0, axis=0)) if len(order) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        out = [[np.empty(len(of)) for _ in range(3)] for _ in ends]
        for a in range(0, len(one), step):
            chosen = one[a: a + step]
            found = net.search(row[of][chosen], start[chosen], depart[chosen], scenario, clock)
            here = np.flatnonzero((which >= a) & (which < a + step))
            for end, got in zip(ends, out):
                for table, values in zip(found, got):
                    values[here] = table[which[here] - a, end[here]]
        return out

    direct, pick = legs(live, place["v_o_node"][live], offers["_at"][live], [place["v_d_node"][live], place["r_o_node"][live]])
    ok = np.isfinite(direct[0]) & np.isfinite(pick[0])
    live, direct, pick = live[ok], [x[ok] for x in direct], [x[ok] for x in pick]
    (ride,) = legs(live, place["r_o_node"][live], pick[0], [place["r_d_node"][live]])
    ok = np.isfinite(ride[0])
    live, direct, pick, ride = live[ok], *([x[ok] for x in leg] for leg in (direct, pick, ride))
    (last,) = legs(live, place["r_d_node"][live], ride[0], [place["v_d_node"][live]])
    ok = np.isfinite(last[0])
    live, direct, pick, ride, last = live[ok], *([x[ok] for x in leg] for leg in (direct, pick, ride, last))
    at = offers["_at"][live]
    total[0][live] = pick[1] + ride[1] + last[1] - direct[1]
    total[1][live] = (last[0] - at) - (direct[0] - at)
    total[2][live] = pick[2] + ride[2] + last[2] - direct[2]
    return total
