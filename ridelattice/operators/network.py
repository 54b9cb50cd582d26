"""Road-network jobs: edges, snapping, batch shortest paths, components, detours.

Shortest paths are a batch job over all requested sources at once: a relaxation
loop whose every round is one distributed join and one aggregate. Sources are
deduplicated first, ``max_cost`` prunes labels that no later gate could accept,
and each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.functions import congestion, geo
from ridelattice.operators.pairs import cell_column, cell_columns
from ridelattice.session import cut_lineage

# Fixed values
DEFAULT_SPEED_KMH = 40.0
SNAP_LIMIT_KM = 10.0


def build_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges from links ``(u, v, km?, kmh?, oneway?, name?)``.

    Missing length becomes the straight line, missing speed 40 km/h; links that
    are not one-way get their reverse; non-positive values are dropped.
    """
    at = nodes.select("node", "lat", "lon")
    a = at.select(F.col("node").alias("u"), F.col("lat").alias("_ulat"), F.col("lon").alias("_ulon"))
    b = at.select(F.col("node").alias("v"), F.col("lat").alias("_vlat"), F.col("lon").alias("_vlon"))
    e = links.join(a, "u").join(b, "v")
    e = e.withColumns({
        "km": F.coalesce(F.col("km"), geo.haversine_km(F.col("_ulat"), F.col("_ulon"), F.col("_vlat"), F.col("_vlon"))),
        "kmh": F.coalesce(F.col("kmh"), F.lit(DEFAULT_SPEED_KMH)),
    }).filter((F.col("km") > 0) & (F.col("kmh") > 0))
    forward = F.struct(F.col("u").alias("u"), F.col("v").alias("v"))
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    ways = F.when(F.coalesce(F.col("oneway"), F.lit(False)), F.array(forward)).otherwise(F.array(forward, back))
    return e.select(F.inline(ways), "km", "kmh", (F.col("km") / F.col("kmh") * 3600.0).alias("secs"))


def near_nodes(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str, limit_km: float) -> DataFrame:
    """All (``key``, ``node``, ``km``) within the limit: a grid-cell equi-join."""
    cell = limit_km / geo.KM_PER_DEGREE * (1 + 1e-9)
    p = points.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    p = p.withColumn("_row", F.floor(F.col("_lat") / cell))
    p = p.withColumn("_col", cell_column(F.col("_lon"), F.col("_row"), cell, limit_km))
    mine = F.floor(F.col("lat") / cell)
    n = nodes.select("node", "lat", "lon").withColumn("_row", F.explode(F.sequence(mine - 1, mine + 1)))
    n = n.withColumn("_col", F.explode(cell_columns(F.col("lon"), F.col("_row"), cell, limit_km)))
    near = p.join(n, ["_row", "_col"]).withColumn("km", geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    return near.filter(F.col("km") <= limit_km).select(key, "node", "km")


def snap(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str, limit_km: float = SNAP_LIMIT_KM) -> DataFrame:
    """Nearest node within the limit: the near nodes, then a map-side combined minimum per point."""
    best = near_nodes(points, nodes, key, lat, lon, limit_km).groupBy(key).agg(F.min(F.struct("km", "node")).alias("b"))
    return best.select(key, F.col("b.node").alias("node"), F.col("b.km").alias("snap_km"))


def od_costs(
    edges: DataFrame, sources: DataFrame, weight: str = "secs", max_cost: float | None = None, max_rounds: int = 500, variant: str | None = None,
    hops_per_round: int = 3,
) -> DataFrame:
    """Cheapest route from every source: ``(src, dst, km, s, hops, pred)``.

    ``variant`` names a column of both inputs (a scenario or time slot): one run
    then solves all variants side by side and the result carries the column.

    Only labels that changed in the last round form the next frontier. A round walks
    a few edges ahead before labels are shuffled and reduced with ``min(struct)``;
    the labels of its last step that survive are the next frontier, all others have
    been expanded already.
    """
    vs = [variant] if variant else []
    e = edges.select(*vs, F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("km").alias("_km"), F.col("secs").alias("_s"), F.col(weight).alias("_w"))
    e = cut_lineage(e)  # read in every round
    label = F.struct("cost", "km", "s", "hops", "pred", "round")
    labels = sources.select(*vs, F.col("node").alias("src"), F.col("node").alias("dst")).distinct().withColumns({
        "cost": F.lit(0.0), "km": F.lit(0.0), "s": F.lit(0.0), "hops": F.lit(0), "pred": F.lit(None).cast("bigint"), "round": F.lit(0),
    })
    frontier = labels
    for i in range(1, max_rounds + 1):
        found, step = labels, frontier
        for j in range(hops_per_round):
            last = i * hops_per_round + j
            step = step.withColumnRenamed("dst", "_u").join(e, [*vs, "_u"]).filter(~F.equal_null(F.col("pred"), F.col("_v")))
            step = step.select(
                *vs, "src", F.col("_v").alias("dst"), (F.col("cost") + F.col("_w")).alias("cost"), (F.col("km") + F.col("_km")).alias("km"),
                (F.col("s") + F.col("_s")).alias("s"), (F.col("hops") + 1).alias("hops"), F.col("_u").cast("bigint").alias("pred"), F.lit(last).alias("round"))
            if max_cost is not None:
                step = step.filter(F.col("cost") <= max_cost)
            found = found.unionByName(step)
        labels = cut_lineage(found.groupBy(*vs, "src", "dst").agg(F.min(label).alias("l")).select(*vs, "src", "dst", "l.*"))
        frontier = labels.filter(F.col("round") == last)
        if frontier.isEmpty():
            return labels.select(*vs, "src", "dst", F.round("km", 4).alias("km"), F.round("s", 2).alias("s"), "hops", "pred")
    raise RuntimeError("relaxation did not settle; raise max_rounds")


def od_paths(od: DataFrame) -> DataFrame:
    """Node list per OD pair from the predecessors, by doubling (log of the hop count rounds)."""
    part = od.select("src", "dst", F.coalesce("pred", "dst").cast("bigint").alias("head"), F.when(F.col("pred").isNull(), F.array(F.col("dst").cast("bigint")))
                     .otherwise(F.array(F.col("dst").cast("bigint"))).alias("path"), F.col("pred").isNull().alias("done"))
    while True:
        part = cut_lineage(part)
        if part.filter(~F.col("done")).isEmpty():
            return part.select("src", "dst", "path")
        up = part.select("src", F.col("dst").alias("head"), F.col("path").alias("_p"), F.col("head").alias("_h"), F.col("done").alias("_d"))
        todo = part.filter(~F.col("done")).join(up, ["src", "head"])
        part = part.filter("done").unionByName(todo.select(
            "src", "dst", F.col("_h").alias("head"), F.concat("_p", "path").alias("path"), F.col("_d").alias("done")))


def path_edges(wanted: DataFrame, od: DataFrame) -> DataFrame:
    """Edges of the cheapest routes of the wanted ``(src, dst)`` pairs only: ``(src, dst, seq, u, v)``, seq from 1.

    Predecessors are followed from all ends at once, one edge a round; a pair leaves at its start. Pairs without a
    route and pairs of one node have no edges.
    """
    back = cut_lineage(od.filter(F.col("pred").isNotNull()).select("src", F.col("dst").alias("v"), F.col("pred").alias("u"), F.col("hops").alias("seq")))
    at = wanted.select("src", "dst").distinct().withColumn("v", F.col("dst"))
    out = None
    while True:
        found = cut_lineage(at.join(back, ["src", "v"]).select("src", "dst", "seq", "u", "v"))
        out = found if out is None else out.unionByName(found)
        at = found.filter(F.col("u") != F.col("src")).select("src", "dst", F.col("u").alias("v"))
        if at.isEmpty():
            return out


def route_via(stops: DataFrame, od: DataFrame, trip: str = "trip_id", order: str = "stop_no", node: str = "node") -> DataFrame:
    """Sum of legs through ordered stops per trip; a trip with an unreachable leg is absent."""
    w = Window.partitionBy(trip).orderBy(order)
    legs = stops.select(trip, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).filter(F.col("dst").isNotNull())
    costed = legs.join(od.select("src", "dst", "km", "s"), ["src", "dst"], "left")
    total = costed.groupBy(trip).agg(
        F.round(F.sum("km"), 4).alias("km"), F.round(F.sum("s"), 2).alias("s"), F.count_if(F.col("km").isNull()).alias("_missing"))
    return total.filter("_missing = 0").drop("_missing")


def with_leg(df: DataFrame, od: DataFrame, src: str, dst: str, tag: str, costs: Sequence[str] = ("km", "s")) -> DataFrame:
    """Left join one leg; ``{tag}_km`` and ``{tag}_s`` are null when unreachable."""
    leg = od.select(F.col("src").alias(src), F.col("dst").alias(dst), *[F.col(c).alias(f"{tag}_{c}") for c in costs])
    return df.join(leg, [src, dst], "left")


def side_by_side(free: DataFrame, table: DataFrame, variant: str, values: Sequence) -> DataFrame:
    """Costs of :func:`od_costs` at free flow and under every variant in one row per (src, dst).

    ``kms`` and ``ss`` hold the variants in the order of ``values``; a cost without a route is null.
    """
    each = lambda cost: F.array(*[F.max(F.when(F.col(variant) == v, F.col(cost))) for v in values])
    wide = table.groupBy("src", "dst").agg(each("km").alias("kms"), each("s").alias("ss"))
    return cut_lineage(free.select("src", "dst", "km", "s").join(wide, ["src", "dst"], "full"))


def with_road_detour(df: DataFrame, od: DataFrame, v_o: str, v_d: str, r_o: str, r_d: str) -> DataFrame:
    """Pooled minus direct cost, floored at zero; null when a leg is unreachable."""
    for src, dst, tag in ((v_o, v_d, "direct"), (v_o, r_o, "pick"), (r_o, r_d, "ride"), (r_d, v_d, "last")):
        df = with_leg(df, od, src, dst, tag)
    return with_leg_detour(df)


def with_leg_detour(df: DataFrame, km: str = "km", s: str = "s", out: str = "") -> DataFrame:
    """The detour over the legs ``{leg}_{km}`` and ``{leg}_{s}``; new columns begin with ``out``."""
    c = F.col
    df = df.withColumns({
        f"{out}pooled_km": F.round(c(f"pick_{km}") + c(f"ride_{km}") + c(f"last_{km}"), 4),
        f"{out}pooled_s": F.round(c(f"pick_{s}") + c(f"ride_{s}") + c(f"last_{s}"), 2),
    })
    pooled_km, pooled_s, direct_km, direct_s = c(f"{out}pooled_km"), c(f"{out}pooled_s"), c(f"direct_{km}"), c(f"direct_{s}")
    known = pooled_km.isNotNull() & direct_km.isNotNull()
    return df.withColumns({
        f"{out}detour_km": F.when(known, F.round(F.greatest(F.lit(0.0), pooled_km - direct_km), 4)),
        f"{out}detour_s": F.when(known, F.round(F.greatest(F.lit(0.0), pooled_s - direct_s), 2)),
        f"{out}duration_ratio": F.when(known, F.when(direct_s > 0, F.round(pooled_s / direct_s, 3)).otherwise(1.0)),
    })


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Weakly connected components: smallest node id reachable.

    Each round takes the smallest neighbouring label and then jumps to that
    label's own label, so chains shrink quickly.
    """
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        offered = both.join(labels, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "component")
        small = labels.unionByName(offered).groupBy("node").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        nxt = small.join(jump, "component", "left").select("node", F.least("component", F.coalesce("_up", "component")).alias("component"))
        nxt = cut_lineage(nxt)
        changed = nxt.join(labels.withColumnRenamed("component", "_old"), "node").filter(F.col("component") != F.col("_old"))
        labels = nxt
        if changed.isEmpty():
            return labels
    raise RuntimeError("labels did not settle; raise max_rounds")


def ranked_element(df: DataFrame, keys: list[str], value: str, fraction: float, width: float, out: str, times: Column | None = None) -> DataFrame:
    """Element ``int(n * fraction)`` of the sorted values per key, without sorting a key in one task.

    A histogram of buckets finds the bucket that holds the element; only that
    bucket's distinct values are ordered. A row counts ``times``, else once.
    """
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_n")).withColumn("_b", F.floor(F.col("_v") / width))
    hist = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    over = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    hist = hist.withColumns({"_end": F.sum("_bn").over(over), "_total": F.sum("_bn").over(whole)})
    hist = hist.withColumn("_k", F.least(F.floor(F.col("_total") * fraction), F.col("_total") - 1))
    at = hist.filter((F.col("_k") < F.col("_end")) & (F.col("_k") >= F.col("_end") - F.col("_bn"))).select(
        *keys, "_b", "_k", (F.col("_end") - F.col("_bn")).alias("_start"), "_total")
    inside = counted.join(at, [*keys, "_b"])
    pos = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    inside = inside.withColumn("_pos", pos).filter((F.col("_k") < F.col("_pos")) & (F.col("_k") >= F.col("_pos") - F.col("_n")))
    return inside.select(*keys, F.col("_v").alias(out), F.col("_total").alias("n"))


INCIDENT_BUCKET_S = 900
DEPARTURE_BLOCK_S = 6 * 3600


def incident_effect(df: DataFrame, incidents: DataFrame, ids: list[str], u: str, v: str, at: str) -> DataFrame:
    """Closure flag and delay factor of edge (u, v) at the moment ``at`` per row.

    Interval join: incidents are repeated into the time buckets they cover, so the
    join has edge and bucket as keys and no edge's whole history meets in one task.
    """
    size = INCIDENT_BUCKET_S
    i = incidents.withColumn("_tb", F.explode(F.sequence(F.floor(F.col("t_start") / size), F.floor(F.col("t_end") / size))))
    i = i.select(F.col("u").alias(u), F.col("v").alias(v), "_tb", "t_start", "t_end", "reduction", F.col("closed").alias("_is_closed"))
    live = df.select(*ids, F.col(at).alias("_at")).withColumn("_tb", F.floor(F.col("_at") / size)).join(i, [u, v, "_tb"])
    live = live.filter((F.col("t_start") <= F.col("_at")) & (F.col("_at") < F.col("t_end")))
    effect = live.groupBy(*ids).agg(
        F.bool_or("_is_closed").alias("_closed"),
        F.max(F.when(~F.col("_is_closed"), 1.0 + congestion.INCIDENT_DELAY * F.col("reduction"))).alias("_factor"))
    out = df.join(effect, ids, "left")
    return out.withColumns({
        "closed_now": F.coalesce("_closed", F.lit(False)),
        "delay_factor": F.greatest(F.lit(1.0), F.coalesce("_factor", F.lit(1.0))),
    }).drop("_closed", "_factor")


def active_edges(edges: DataFrame, incidents: DataFrame, at_s: Column) -> DataFrame:
    """Edges under the incidents active at a moment: closed edges dropped, delay factor attached."""
    t = incident_effect(edges.withColumn("_t", at_s), incidents, ["u", "v"], "u", "v", "_t")
    return t.filter(~F.col("closed_now")).drop("closed_now", "_t").withColumn("secs_now", F.col("secs") * F.col("delay_factor"))


def earliest_arrival(
    edges: DataFrame, starts: DataFrame, scenario: str = "no_congestion", incidents: DataFrame | None = None,
    clock_start_hour: float = 8.0, max_s: float | None = None, max_rounds: int = 200, hops_per_round: int = 4,
) -> DataFrame:
    """Time-dependent arrival per (start node, departure): ``(src, depart_s, dst, arrive_s, km, ff_s)``.

    Costs depend on the moment an edge is entered and may fall with time, so a
    label is recomputed from its predecessors every hop instead of kept as a
    minimum. Costs are positive, so the n earliest labels are final after n hops;
    labels that a round of hops leaves as they were are therefore final, and the loop ends.
    Edges lie by start node and block of departures, each with the incidents that a departure of the block can meet (within
    ``max_s``, which bounds the list), and labels are dealt to tasks the same way.
    """
    c = F.col
    size = DEPARTURE_BLOCK_S
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = starts.select(c("node").alias("src"), c("depart_s").cast("double").alias("depart_s"), F.floor(c("depart_s") / size).alias("_block")).distinct()
    base = cut_lineage(base.select("src", "depart_s", "_block", c("src").alias("dst"), c("depart_s").alias("arrive_s"), F.lit(0.0).alias("km"), F.lit(0.0).alias("ff_s")))
    first, last = base.agg(F.min("_block"), F.max("_block")).first()
    e = edges.select("u", "v", c("km").alias("_km"), c("secs").alias("_s"), congestion.edge_direction(c("u_name"), c("v_name")).alias("_dir"))
    e = e.withColumn("_block", F.explode(F.sequence(F.lit(first or 0), F.lit(last or 0))))
    if incidents is not None:
        # the blocks whose departures are on the road before the end of an incident and, within the limit, after its start
        begin = F.lit(first or 0) if max_s is None else F.greatest(F.lit(first or 0), F.floor((c("t_start") - max_s) / size))
        until = F.least(F.lit(last or 0), F.floor(c("t_end") / size))
        i = incidents.withColumn("_block", F.explode(F.filter(F.sequence(begin, F.greatest(begin, until)), lambda x: x <= until)))
        listed = i.groupBy("u", "v", "_block").agg(F.collect_list(F.struct("t_start", "t_end", "reduction", "closed")).alias("_inc"))
        e = e.join(listed, ["u", "v", "_block"], "left")
    e = cut_lineage(e.repartition(parts, "u", "_block"))

    def hop_once(labels: DataFrame) -> DataFrame:
        hop = labels.join(e.withColumnRenamed("_block", "_eblock"), (c("dst") == c("u")) & (c("_block") == c("_eblock")))
        hour = F.lit(clock_start_hour) + c("arrive_s") / 3600.0
        cost = congestion.link_seconds(c("_s"), F.pmod(hour, F.lit(24.0)), c("_dir"), scenario)
        if incidents is not None:
            now = F.filter(F.coalesce("_inc", F.array()), lambda x: (x["t_start"] <= c("arrive_s")) & (c("arrive_s") < x["t_end"]))
            hop = hop.withColumn("_now", now).filter(~F.exists("_now", lambda x: x["closed"]))
            cost = cost * F.aggregate("_now", F.lit(1.0), lambda m, x: F.greatest(m, 1.0 + congestion.INCIDENT_DELAY * x["reduction"]))
        hop = hop.select("src", "depart_s", "_block", c("v").alias("dst"), (c("arrive_s") + cost).alias("arrive_s"),
                         (c("km") + c("_km")).alias("km"), (c("ff_s") + c("_s")).alias("ff_s")).filter(c("dst") != c("src"))
        if max_s is not None:
            hop = hop.filter(c("arrive_s") - c("depart_s") <= max_s)
        spread = base.unionByName(hop).repartition(parts, "dst", "_block")
        return spread.groupBy("src", "depart_s", "_block", "dst").agg(F.min(F.struct("arrive_s", "km", "ff_s")).alias("l")).select("src", "depart_s", "_block", "dst", "l.*")

    labels, seen = base, None
    for _ in range(max_rounds):
        for _ in range(hops_per_round):
            labels = hop_once(labels)
        labels = cut_lineage(labels)
        mark = tuple(labels.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("src", "depart_s", "dst", "arrive_s").cast("decimal(38,0)"))).first())
        if mark == seen:
            return labels.drop("_block")
        seen = mark
    raise RuntimeError("arrival times did not settle; raise max_rounds")
