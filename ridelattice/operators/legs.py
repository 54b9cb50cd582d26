"""Legs under incidents: many departures from one place searched together, numpy over the rows that Spark hands to a Python worker.

Spark finds the part of the network that a place can reach in time, lists it beside the place, and deals the departures to rows;
a row holds the departures of one place and one block of time, or a share of them where they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.functions.congestion import INCIDENT_DELAY
from ridelattice.operators.network import DEPARTURE_BLOCK_S, od_costs
from ridelattice.session import cut_lineage

#: Legs asked for in a row, about; those of one departure lie in one row.
MOST_LEGS = 512
#: Labels that are computed together (those of one departure at least).
MOST_LABELS = 4_000_000
_FOUND = "src bigint, depart_s double, dst bigint, arrive_s double, km double"
_FOUND_ARROW = pa.schema([("src", pa.int64()), ("depart_s", pa.float64()), ("dst", pa.int64()), ("arrive_s", pa.float64()), ("km", pa.float64())])


def reach(edges: DataFrame, places: DataFrame, incidents: DataFrame, first_s: float, last_s: float, costs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What can be met from every place ``(node, within_s)``: the edges, and the incidents per block of departures.

    An edge counts if its start can be reached within ``within_s`` at free flow, as no incident makes a road faster. Departures
    lie between ``first_s`` and ``last_s``. ``costs`` are those of all places by seconds (:func:`network.od_costs`), if they are
    known. Both tables are written: ``(src, within_s, edges)`` and ``(src, block, incidents)``.
    """
    c = F.col
    p = cut_lineage(places.filter(c("node").isNotNull()).groupBy("node").agg(F.max("within_s").alias("within_s")))
    longest = p.agg(F.max("within_s")).first()[0]
    if costs is None:
        costs = od_costs(edges.select("u", "v", "km", "secs"), p.select("node"), max_cost=longest + 0.01)
    # costs come with two decimals
    near = costs.select(c("src").alias("node"), c("dst").alias("u"), "s").join(p, "node").filter(c("s") <= c("within_s") + 0.01)
    road = cut_lineage(near.join(edges.select("u", "v", "km", "secs").distinct(), "u").select(c("node").alias("src"), "within_s", "u", "v", "km", "secs"))
    size = DEPARTURE_BLOCK_S
    first, last = F.lit(int(first_s // size)), F.lit(int(last_s // size))
    begin, until = F.greatest(first, F.floor((c("t_start") - longest) / size)), F.least(last, F.floor(c("t_end") / size))
    i = incidents.filter(c("t_start") < c("t_end")).select("u", "v", "t_start", "t_end", "reduction", "closed").distinct()
    i = i.withColumn("block", F.explode(F.filter(F.sequence(begin, F.greatest(begin, until)), lambda x: x <= until)))
    met = road.select("src", "u", "v").distinct().join(i, ["u", "v"])
    # an incident of unknown kind lets nobody pass
    met = met.groupBy("src", "block").agg(F.collect_list(F.struct(
        c("u").cast("bigint").alias("u"), c("v").cast("bigint").alias("v"), c("t_start").cast("double").alias("a"), c("t_end").cast("double").alias("b"),
        F.when(F.coalesce("closed", F.lit(True)), float("inf")).otherwise(F.greatest(F.lit(1.0), 1.0 + INCIDENT_DELAY * F.coalesce("reduction", F.lit(0.0)))).alias("f"))).alias("incidents"))
    road = road.groupBy("src").agg(F.max("within_s").alias("within_s"), F.collect_list(F.struct(
        c("u").cast("bigint").alias("u"), c("v").cast("bigint").alias("v"), c("km").cast("double").alias("km"), c("secs").cast("double").alias("s"))).alias("edges"))
    return cut_lineage(road), cut_lineage(met)


def leg_arrivals(wanted: DataFrame, road: DataFrame, met: DataFrame) -> DataFrame:
    """Earliest arrival of the wanted legs ``(src, depart_s, dst)``: ``(src, depart_s, dst, arrive_s, km)``.

    The same labels as :func:`network.earliest_arrival` has at free flow under the incidents, for the wanted ends only.
    ``road`` and ``met`` as of :func:`reach`; an end that is not reached within the place's time has no row.
    """
    c = F.col
    asked = wanted.select(c("src").cast("bigint").alias("src"), c("depart_s").cast("double").alias("depart_s"), c("dst").cast("bigint").alias("dst")).dropna()
    asked = asked.withColumn("block", F.floor(c("depart_s") / DEPARTURE_BLOCK_S))
    share = asked.groupBy("src", "block").agg(F.ceil(F.count(F.lit(1)) / MOST_LEGS).alias("_shares"))
    rows = asked.join(share, ["src", "block"]).withColumn("_share", F.pmod(F.xxhash64("depart_s"), c("_shares")))
    rows = rows.groupBy("src", "block", "_share").agg(F.collect_set(F.struct("depart_s", "dst")).alias("asked"))
    rows = rows.join(road, "src", "left").join(met, ["src", "block"], "left").select("src", "asked", F.coalesce("within_s", F.lit(0.0)).alias("within_s"), "edges", "incidents")
    return rows.mapInArrow(_search, _FOUND)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for src, within, asked, edges, incidents in zip(*(batch[n] for n in ("src", "within_s", "asked", "edges", "incidents"))):
            yield _row(src.as_py(), within.as_py(), *_fields(asked), _fields(edges), _fields(incidents))


def _fields(rows: pa.Scalar) -> list[np.ndarray] | None:
    return None if rows.values is None or not len(rows.values) else [x.to_numpy(zero_copy_only=False) for x in rows.values.flatten()]


def _row(src: int, within: float, depart: np.ndarray, dst: np.ndarray, edges: list[np.ndarray] | None, incidents: list[np.ndarray] | None) -> pa.RecordBatch:
    """The legs asked for in a row."""
    u, v, km, s = edges if edges is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    nodes = np.unique(np.concatenate([[src], u, v]))
    departs, row = np.unique(depart, return_inverse=True)
    place = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    at, far = np.empty(len(row)), np.empty(len(row))
    step = max(1, MOST_LABELS // (len(u) + len(nodes)))
    start, u_place, v_place, met = np.searchsorted(nodes, src), np.searchsorted(nodes, u), np.searchsorted(nodes, v), _placed(incidents, u, v)
    for i in range(0, len(departs), step):
        here = (row >= i) & (row < i + step)
        arrive, gone = settle(start, len(nodes), departs[i: i + step], within, u_place, v_place, km, s, met)
        at[here], far[here] = arrive[row[here] - i, place[here]], gone[row[here] - i, place[here]]
    found = np.isfinite(at) & (nodes[place] == dst)
    return pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), src, np.int64)), *(pa.array(x[found]) for x in (depart, dst, at, far))], schema=_FOUND_ARROW)


def _placed(incidents: list[np.ndarray] | None, u: np.ndarray, v: np.ndarray) -> list[tuple]:
    """Each incident with the positions of its edges."""
    return [] if incidents is None else [(np.flatnonzero((u == a) & (v == b)), begin, end, factor) for a, b, begin, end, factor in zip(*incidents)]


def settle(start: int, size: int, departs: np.ndarray, within: float, u: np.ndarray, v: np.ndarray, km: np.ndarray, s: np.ndarray, incidents: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Arrival and km per departure and node, infinite where a node is not reached.

    Labels are recomputed from all edges into a node until nothing changes, as leaving later can mean arriving earlier.
    """
    order = np.argsort(v, kind="stable")
    u, v, km, s = u[order], v[order], km[order], s[order]
    back = np.argsort(order, kind="stable")
    incidents = [(back[e], a, b, f) for e, a, b, f in incidents]
    into, first = np.unique(v, return_index=True)
    count = np.diff(np.append(first, len(v)))
    arrive, far = np.full((len(departs), size), np.inf), np.full((len(departs), size), np.inf)
    arrive[:, start], far[:, start] = departs, 0.0
    latest = departs[:, None]
    while len(v):
        entered = arrive[:, u]
        factor = np.ones_like(entered)
        for e, a, b, f in incidents:
            factor[:, e] = np.where((a <= entered[:, e]) & (entered[:, e] < b), np.maximum(factor[:, e], f), factor[:, e])
        then = entered + s * factor
        then = np.where(then - latest <= within, then, np.inf)
        best = np.minimum.reduceat(then, first, axis=1)
        way = np.where(then == np.repeat(best, count, axis=1), far[:, u] + km, np.inf)
        new, gone = np.full_like(arrive, np.inf), np.full_like(far, np.inf)
        new[:, into], gone[:, into] = best, np.minimum.reduceat(way, first, axis=1)
        new[:, start], gone[:, start] = departs, 0.0
        if np.array_equal(new, arrive) and np.array_equal(gone, far):
            break
        arrive, far = new, gone
    return arrive, far
