"""Evaluation queries over matching results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.operators import evaluate, gates, network, pairs, pruning, rank
from ridelattice.plans import sqltext as q
from ridelattice.plans.matching import standard_scored
from ridelattice.plans.network import (
    _KEPT_SQL, _ROADS, _SCORES_SQL, CONGESTED_SQL, THRESHOLDS, _cong_score, _direction_sql, _report_sql, _roads, _vc_sql, bellman_ford, congested_pairs, kept, once, report,
    od, report_scores, road_batch, road_pairs,
)
from ridelattice.functions import congestion
from ridelattice.plans.registry import query
from ridelattice.session import cut_lineage
from ridelattice.sources.fixtures import fixture, with_clause
from ridelattice.sources.readers import written

_REL = "((driver_id*driver_id + rider_id*31) % 10007) % 100 < 35"


def labelled(spark, sf) -> DataFrame:
    """Scored pairs with labels, written once and shared by the evaluation jobs."""
    keep = ["rider_id", "driver_id", "r_seats", "v_capacity", "eligible", "score", *gates.WEIGHTS]
    return once(spark, sf, "labelled", lambda: cut_lineage(standard_scored(spark, sf).select(*keep, F.expr(_REL).alias("relevant"))))


def kept_batch(spark, sf) -> DataFrame:
    cols = ["rider_id", "driver_id", "feasible", "score", *[f"keep_{m}" for m in pruning.METHODS]]
    return once(spark, sf, "kept", lambda: written(kept(spark, sf).select(*cols), "kept"))


def scores_batch(spark, sf) -> DataFrame:
    cols = ["rider_id", "driver_id", "reachable", "relevance", "detour_km", "detour_s", "road_pickup_km", *pruning.SCORERS]
    return once(spark, sf, "scores", lambda: written(report_scores(spark, sf).select(*cols), "scores"))


def two_scores(spark, sf) -> DataFrame:
    """The geometry and the network score alone, for the jobs that compare them."""
    return once(spark, sf, "two_scores", lambda: written(report_scores(spark, sf).select("rider_id", "driver_id", "a_geometric", "c_network"), "scores"))


_LAB = q.scored() + f", lab AS MATERIALIZED (SELECT *, {_REL} AS relevant FROM scored)"
_IDEAL3 = "(CASE WHEN relevant >= 1 THEN 1e0 ELSE 0e0 END + CASE WHEN relevant >= 2 THEN 1e0/log2(3e0) ELSE 0e0 END + CASE WHEN relevant >= 3 THEN 0.5e0 ELSE 0e0 END)"
_METRIC_COLS = f"""hits/3e0 AS precision_at_k, CASE WHEN relevant > 0 THEN hits/CAST(relevant AS DOUBLE) END AS recall_at_k,
  CASE WHEN relevant > 0 THEN dcg/{_IDEAL3} END AS ndcg_at_k, eligible/CAST(candidates AS DOUBLE) AS coverage"""


def _metrics_sql(src: str, keys: str, order: str) -> str:
    return f"""SELECT {keys}, count(*) AS candidates, count(*) FILTER (eligible) AS eligible, count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant AND NOT eligible) AS lost_to_filter,
    count(*) FILTER (eligible AND relevant AND rk <= 3) AS hits, coalesce(sum(CASE WHEN eligible AND relevant AND rk <= 3 THEN 1e0/log2(rk + 1e0) END), 0e0) AS dcg
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY eligible DESC, {order}) AS rk FROM {src}) r GROUP BY {keys}"""


_ROUNDED = ("precision_at_k", "recall_at_k", "ndcg_at_k", "coverage")


@query("e1_query_metrics", _LAB + f""", m AS ({_metrics_sql('lab', 'rider_id', 'score DESC, driver_id')}) SELECT rider_id, candidates, eligible, relevant, lost_to_filter,
  {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}, relevant = 0 AS zero_relevant FROM (SELECT *, {_METRIC_COLS} FROM m) t""")
def e1(spark, sf):
    m = evaluate.query_metrics(labelled(spark, sf), ["rider_id"], [F.desc("score"), F.col("driver_id")])
    return m.select("rider_id", "candidates", "eligible", "relevant", "lost_to_filter", *[F.round(c, 6).alias(c) for c in _ROUNDED], "zero_relevant")


def _methods(df: DataFrame) -> DataFrame:
    """Candidates repeated per deterministic ranking method with its sort key."""
    c = F.col
    keys = F.array(
        F.struct(F.lit("nearest_neighbour").alias("method"), c("pickup_km").alias("key")),
        F.struct(F.lit("distance_destination").alias("method"), (c("pickup_km") + c("dest_km")).alias("key")),
        F.struct(F.lit("route_time").alias("method"), (-c("score")).alias("key")))
    return df.select("*", F.inline(keys))


_BY_METHOD = """ml AS MATERIALIZED (SELECT *, 'nearest_neighbour' AS method, pickup_km AS key FROM lab UNION ALL SELECT *, 'distance_destination', pickup_km + dest_km FROM lab
  UNION ALL SELECT *, 'route_time', -score FROM lab)"""


@query("e9_means_by_scenario", _LAB + ", " + _BY_METHOD + f""", m AS ({_metrics_sql('ml', 'method, rider_id', 'key, driver_id')}) SELECT scenario, method, count(*) AS queries,
  {', '.join(f'round(avg({c}), 6) AS {c}_mean, count(*) FILTER ({c} IS NULL) AS {c}_excluded' for c in _ROUNDED)} FROM (SELECT *, {_METRIC_COLS},
  CASE WHEN candidates <= 2 THEN 'thin' WHEN candidates <= 4 THEN 'balanced' ELSE 'dense' END AS scenario FROM m) t GROUP BY scenario, method""")
def e9(spark, sf):
    m = evaluate.query_metrics(_methods(labelled(spark, sf)), ["method", "rider_id"], [F.col("key"), F.col("driver_id")])
    n = F.col("candidates")
    m = m.withColumn("scenario", F.when(n <= 2, "thin").when(n <= 4, "balanced").otherwise("dense"))
    return evaluate.mean_by(m, ["scenario", "method"], _ROUNDED)


def _graded_sql() -> str:
    cols, agg = [], []
    for k in (1, 3, 5):
        cols.append(f"count(*) FILTER (rk <= {k} AND score > 0 AND relevance >= 1) AS hits{k}, coalesce(sum(CASE WHEN rk <= {k} AND score > 0 THEN (pow(2e0, relevance) - 1e0)/log2(rk + 1e0) END), 0e0) AS dcg{k}, "
                    f"coalesce(sum(CASE WHEN ik <= {k} THEN (pow(2e0, relevance) - 1e0)/log2(ik + 1e0) END), 0e0) AS idcg{k}")
        agg.append(f"round(avg(hits{k}/{k}e0), 3) AS p{k}, round(avg(CASE WHEN relevant > 0 THEN hits{k}/CAST(relevant AS DOUBLE) ELSE 0e0 END), 3) AS r{k}, round(avg(CASE WHEN idcg{k} > 0 THEN dcg{k}/idcg{k} ELSE 0e0 END), 3) AS ndcg{k}")
    cap = lambda col, lim: f"max(CASE WHEN rk = 1 AND score > 0 THEN CASE WHEN reachable THEN least({lim}e0, coalesce({col}, {lim}e0)) ELSE {lim}e0 END END)"
    union = " UNION ALL ".join(f"SELECT rider_id, driver_id, relevance, reachable, detour_km, detour_s, road_pickup_km, '{m}' AS method, {m} AS score FROM scores" for m in pruning.SCORERS)
    return f""", long AS MATERIALIZED ({union}), per AS (SELECT method, rider_id, count(*) FILTER (relevance >= 1) AS relevant, {', '.join(cols)}, sum(score) AS ss, count(*) AS n,
    min(CASE WHEN score > 0 AND relevance >= 1 THEN rk END) AS fr, count(*) FILTER (score > 0) AS rec, {cap('detour_km', 10)} AS sk, {cap('detour_s', 600)} AS sse, {cap('road_pickup_km', 5)} AS sp FROM (
    SELECT *, row_number() OVER (PARTITION BY method, rider_id ORDER BY score DESC, driver_id) AS rk, row_number() OVER (PARTITION BY method, rider_id ORDER BY relevance DESC) AS ik FROM long) t GROUP BY 1, 2)
  SELECT method, {', '.join(agg)}, round(avg(coalesce(1e0/fr, 0e0)), 3) AS mrr, round(avg(CASE WHEN rec > 0 THEN 100e0 ELSE 0e0 END), 1) AS coverage_pct, round(sum(ss)/sum(n), 2) AS mean_score,
    round(avg(sk), 3) AS mean_selected_detour_km, round(avg(sse), 1) AS mean_selected_detour_s, round(avg(sp), 3) AS mean_selected_pickup_km FROM per GROUP BY method"""


@query("e2_graded_metrics", _SCORES_SQL + _graded_sql())
def e2(spark, sf):
    return evaluate.graded_metrics(scores_batch(spark, sf), pruning.SCORERS)


def _top3_sql(score: str, src: str, where: str = "true") -> str:
    return f"SELECT rider_id, driver_id, rk FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY {score} DESC, driver_id) AS rk FROM {src} WHERE {score} > 0 AND {where}) t WHERE rk <= 3"


@query("e3_ranking_agreement", _SCORES_SQL + f""", ta AS ({_top3_sql('a_geometric', 'scores')}), tb AS ({_top3_sql('c_network', 'scores')}),
  u AS (SELECT rider_id, count(*) AS u, count(*) FILTER (a.rk IS NOT NULL AND b.rk IS NOT NULL) AS i, count(*) FILTER (a.rk = 1 AND b.rk = 1) AS s FROM ta a FULL JOIN tb b USING (rider_id, driver_id) GROUP BY rider_id)
  SELECT r.rider_id, coalesce(s > 0, true) AS same_top1, round(coalesce(i/CAST(u AS DOUBLE), 1e0), 6) AS jaccard FROM (SELECT DISTINCT rider_id FROM scores) r LEFT JOIN u USING (rider_id)""")
def e3(spark, sf):
    s = two_scores(spark, sf)
    top = lambda m: rank.top_k(s.filter(F.col(m) > 0), 3, ["rider_id"], [F.desc(m), F.col("driver_id")])
    a = evaluate.agreement(top("a_geometric"), top("c_network"), s.select("rider_id").distinct())
    return a.select("rider_id", "same_top1", F.round("jaccard", 6).alias("jaccard"))


@query("e4_spearman", _SCORES_SQL + """, rk AS (SELECT rider_id, row_number() OVER (PARTITION BY rider_id ORDER BY a_geometric DESC, driver_id) AS a,
  row_number() OVER (PARTITION BY rider_id ORDER BY c_network DESC, driver_id) AS b FROM scores)
  SELECT rider_id, round(1e0 - 6e0*sum((a-b)*(a-b))/(CAST(count(*) AS DOUBLE)*(CAST(count(*) AS DOUBLE)*count(*) - 1)), 6) AS rho FROM rk GROUP BY rider_id HAVING count(*) > 1""")
def e4(spark, sf):
    return evaluate.spearman(two_scores(spark, sf), "rider_id", "a_geometric", "c_network").select("rider_id", F.round("rho", 6).alias("rho"))


@query("e4_pairwise_inversions", _SCORES_SQL + """ SELECT x.rider_id, count(*) FILTER ((x.a_geometric > y.a_geometric) <> (x.c_network > y.c_network)) AS inverted, count(*) AS comparable
  FROM scores x JOIN scores y ON x.rider_id = y.rider_id AND x.driver_id < y.driver_id WHERE x.a_geometric <> y.a_geometric AND x.c_network <> y.c_network GROUP BY x.rider_id""")
def e4_inversions(spark, sf):
    out = evaluate.inversions(two_scores(spark, sf), "rider_id", "a_geometric", "c_network").filter(F.col("comparable") > 0)
    return out.select("rider_id", "inverted", "comparable")


@query("e5_gate_confusion", _ROADS + ", " + _report_sql() + """ SELECT town, count(*) AS pairs, count(*) FILTER (geometric_eligible AND NOT network_eligible) AS false_positives,
  count(*) FILTER (NOT geometric_eligible AND network_eligible) AS false_negatives, round(count(*) FILTER (geometric_eligible <> network_eligible)/CAST(count(*) AS DOUBLE), 3) AS disagreement_rate,
  count(*) FILTER (NOT reachable) AS unreachable FROM rep GROUP BY town""")
def e5(spark, sf):
    return evaluate.confusion(report(spark, sf), "geometric_eligible", "network_eligible", ["r_town"]).withColumnRenamed("r_town", "town")


def _pruning_sql() -> str:
    union = " UNION ALL ".join(f"SELECT rider_id, driver_id, feasible, score, '{m}' AS method, keep_{m} AS keep FROM kept" for m in pruning.METHODS)
    return f""", pl AS MATERIALIZED ({union}), cn AS (SELECT method, count(*) AS pairs, count(*) FILTER (keep) AS routed, count(*) FILTER (feasible) AS feasible, count(*) FILTER (feasible AND NOT keep) AS false_negatives,
    count(*) FILTER (keep AND NOT feasible) AS false_positives FROM pl GROUP BY method),
  fr AS (SELECT method, rider_id, driver_id, feasible, row_number() OVER (PARTITION BY method, rider_id ORDER BY score DESC, driver_id) AS rk FROM pl WHERE score > 0 QUALIFY rk <= 3),
  mr AS (SELECT method, rider_id, driver_id, feasible, row_number() OVER (PARTITION BY method, rider_id ORDER BY score DESC, driver_id) AS rk FROM pl WHERE score > 0 AND keep QUALIFY rk <= 3),
  ag AS (SELECT method, rider_id, count(*) AS u, count(*) FILTER (f.rk IS NOT NULL AND m.rk IS NOT NULL) AS i, count(*) FILTER (f.rk = 1 AND m.rk = 1) AS s FROM fr f FULL JOIN mr m USING (method, rider_id, driver_id) GROUP BY 1, 2),
  ht AS (SELECT method, rider_id, count(*) FILTER (rk = 1) AS h1, count(*) AS h3, sum(1e0/log2(rk + 1e0)) AS dcg, min(rk) AS fst FROM mr WHERE feasible GROUP BY 1, 2),
  rd AS (SELECT method, rider_id, count(*) FILTER (feasible) AS relevant FROM pl GROUP BY 1, 2),
  rs AS (SELECT method, round(avg(CASE WHEN u IS NULL OR s > 0 THEN 1e0 ELSE 0e0 END), 3) AS top1_agreement, round(avg(coalesce(i/CAST(u AS DOUBLE), 1e0)), 3) AS top3_jaccard, round(avg(coalesce(h1, 0)), 3) AS p1,
    round(avg(coalesce(h3, 0)/3e0), 3) AS p3, round(avg(CASE WHEN relevant > 0 THEN coalesce(h3, 0)/CAST(relevant AS DOUBLE) ELSE 0e0 END), 3) AS r3,
    round(avg(CASE WHEN relevant > 0 THEN coalesce(dcg, 0e0)/{_IDEAL3} ELSE 0e0 END), 3) AS ndcg3, round(avg(coalesce(1e0/fst, 0e0)), 3) AS mrr FROM rd LEFT JOIN ag USING (method, rider_id) LEFT JOIN ht USING (method, rider_id) GROUP BY method)
  SELECT cn.*, round((1e0 - routed/CAST(pairs AS DOUBLE))*100e0, 2) AS pruned_pct, CASE WHEN feasible > 0 THEN round((feasible - false_negatives)/CAST(feasible AS DOUBLE), 3) ELSE 1e0 END AS recall,
    top1_agreement, top3_jaccard, p1, p3, r3, ndcg3, mrr FROM cn JOIN rs USING (method)"""


@query("e6_pruning_report", _KEPT_SQL + _pruning_sql())
def e6(spark, sf):
    return evaluate.pruning_report(kept_batch(spark, sf), pruning.METHODS)


_SWEEP = (("loose", 11.5, 11.5, 40.0, 25.0), ("moderate", 11.5, 11.5, 30.0, 20.0), ("tight", 10.0, 10.0, 20.0, 15.0), ("very_tight", 1.0, 10.0, 10.0, 10.0))


@query("e7_aggressiveness_sweep", _KEPT_SQL + f""" SELECT level, count(*) AS pairs, count(*) FILTER (keep) AS routed, count(*) FILTER (feasible AND NOT keep) AS false_negatives,
  round(100e0*count(*) FILTER (NOT keep)/count(*), 2) AS pruned_pct FROM (SELECT level, feasible, dep_diff_min <= tm AND pickup_km <= pk AND dest_km <= ds
  AND greatest(0e0, pickup_km + shared_km + dest_km - driver_road_km) <= dt AS keep FROM kept CROSS JOIN (VALUES {', '.join(f"('{n}', {a}e0, {b}e0, {c}e0, {d}e0)" for n, a, b, c, d in _SWEEP)}) s(level, pk, ds, dt, tm)) t GROUP BY level""")
def e7(spark, sf):
    p = pruning.tier2(road_batch(spark, sf), THRESHOLDS)
    flags = F.array(*[
        F.struct(F.lit(n).alias("level"), pruning.pruner("admissible_bound", {"pickup_km": a, "dest_km": b, "detour_km": c, "time_diff_min": d}).alias("keep"))
        for n, a, b, c, d in _SWEEP])
    long = p.select("feasible", F.inline(flags))
    c = F.col
    return long.groupBy("level").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("keep").alias("routed"), F.count_if(c("feasible") & ~c("keep")).alias("false_negatives"),
        F.round(100.0 * F.count_if(~c("keep")) / F.count(F.lit(1)), 2).alias("pruned_pct"))


@query("e7_congestion_summary", CONGESTED_SQL + f""", st AS ({_top3_sql('static_score', 'congested')}), dt AS ({_top3_sql('dynamic_score', 'congested')}),
  ch AS (SELECT rider_id, coalesce(a.driver_id <> b.driver_id, a.driver_id IS NOT NULL OR b.driver_id IS NOT NULL) AS changed FROM (SELECT DISTINCT rider_id FROM congested) r LEFT JOIN (SELECT * FROM st WHERE rk = 1) a USING (rider_id) LEFT JOIN (SELECT * FROM dt WHERE rk = 1) b USING (rider_id))
  SELECT (SELECT count(*) FILTER (static_feasible) FROM congested) AS static_feasible, (SELECT count(*) FILTER (dynamic_feasible) FROM congested) AS dynamic_feasible,
  (SELECT round(avg(abs(dynamic_s - static_s)), 1) FROM congested WHERE dynamic_s IS NOT NULL) AS mean_eta_error_s, round(avg(CASE WHEN changed THEN 1e0 ELSE 0e0 END), 3) AS top1_change_rate FROM ch""")
def e7_congestion(spark, sf):
    p = congested_pairs(spark, sf)
    best = lambda t: F.max(F.when(F.col(f"{t}_score") > 0, F.struct(f"{t}_score", (-F.col("driver_id")).alias("d"))))["d"]
    error = F.abs(F.col("dynamic_detour_s") - F.col("static_detour_s"))
    # one pass over the pairs: what is counted over all of them is summed up over the riders
    per = p.groupBy("rider_id").agg(
        best("static").alias("_s"), best("dynamic").alias("_d"), F.count_if("static_feasible").alias("_sf"), F.count_if("dynamic_feasible").alias("_df"),
        F.sum(error).alias("_error"), F.count(error).alias("_n"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        count("_sf").alias("static_feasible"), count("_df").alias("dynamic_feasible"), F.round(F.try_divide(F.sum("_error"), F.sum("_n")), 1).alias("mean_eta_error_s"),
        F.round(F.avg(F.when(F.equal_null("_s", "_d"), 0.0).otherwise(1.0)), 3).alias("top1_change_rate"))


_SCENARIOS = tuple(congestion.SCENARIO_SCALE)


def scenario_pairs(spark, sf) -> DataFrame:
    """Road pairs under every congestion scenario at 08:30, with both scores."""
    each = F.explode(F.array(*[F.lit(n) for n in _SCENARIOS])).alias("scenario")
    e = fixture(spark, sf, "edges").withColumn("_dir", congestion.edge_direction(F.col("u_name"), F.col("v_name"))).select("*", each)
    e = e.withColumn("secs", congestion.link_seconds(F.col("secs"), F.lit(8.5), F.col("_dir"), F.col("scenario")))
    table = network.od_costs(e, fixture(spark, sf, "nodes").select("node", each), variant="scenario")
    p = road_pairs(spark, sf, network.side_by_side(od(spark, sf), table, "scenario", _SCENARIOS), ("km", "s", "kms", "ss"))
    p = p.withColumnsRenamed({"detour_km": "static_detour_km", "detour_s": "static_detour_s", "pick_s": "static_pick_s"})
    p = in_variants(pruning.congested_scores(p, THRESHOLDS, "static"), "scenario", _SCENARIOS, [
        "rider_id", "driver_id", "road_pickup_km", "dep_diff_min", "direction_sim", "static_score", "static_detour_s", "static_pick_s"])
    return p.select("scenario", "rider_id", "driver_id", "static_score", "dynamic_feasible", "dynamic_score",
                    "static_detour_s", "dynamic_detour_s", "static_pick_s", "pick_s", "direct_s")


def in_variants(p: DataFrame, variant: str, values: tuple, keep: list[str]) -> DataFrame:
    """A row per pair and variant with the variant's legs (from ``{leg}_kms`` and ``{leg}_ss``), detour and score; nothing is joined."""
    legs = lambda i: [F.get(f"{leg}_{many}", F.lit(i)).alias(f"{leg}_{one}") for leg in ("direct", "pick", "ride", "last") for one, many in (("km", "kms"), ("s", "ss"))]
    long = p.select(*keep, F.inline(F.array(*[F.struct(F.lit(v).alias(variant), *legs(i)) for i, v in enumerate(values)])))
    return pruning.congested_scores(network.with_leg_detour(long, out="dynamic_"), THRESHOLDS, "dynamic")


def _scenarios_sql() -> str:
    """Costs by relaxation per scenario, ranks by window, gains summed place by place."""
    parts, union = [], []
    for i, (name, scale) in enumerate(congestion.SCENARIO_SCALE.items()):
        parts.append(f"ed{i} AS (SELECT u, v, km, secs*least(5e0, greatest(1e0, 1e0 + 0.15e0*pow(({_vc_sql('8.5e0', 'direction')})*{scale}e0, 4e0))) AS secs "
                     f"FROM (SELECT *, {_direction_sql()} AS direction FROM edges) x)")
        parts += [bellman_ford(f"ed{i}", 12, f"od{i}", f"w{i}_"), _roads(f"od{i}", "feat0", f"rd{i}_")]
        union.append(f"SELECT '{name}' AS scenario, a.*, a.detour_km AS static_km, a.detour_s AS static_s, b.detour_km AS dynamic_km, b.detour_s AS dynamic_s, "
                     f"a.pick_s AS free_pick, b.pick_s AS busy_pick, b.direct_s AS busy_direct FROM roads a JOIN rd{i}_ b USING (driver_id, rider_id)")
    rk = lambda t: f"CASE WHEN {t}_score > 0 THEN row_number() OVER (PARTITION BY scenario, rider_id ORDER BY {t}_score DESC, driver_id) END AS {t}_rk"
    return _ROADS + ", " + ", ".join(parts) + f""", allof AS (SELECT *, {_cong_score('static')}, {_cong_score('dynamic')} FROM ({' UNION ALL '.join(union)}) t),
  ranked AS MATERIALIZED (SELECT *, {rk('static')}, {rk('dynamic')}, static_s + dynamic_s + busy_pick + busy_direct IS NOT NULL AS reached FROM allof),
  sec AS (SELECT scenario, count(*) AS pairs, count(*) FILTER (dynamic_feasible) AS feasible_pairs, coalesce(round(avg(round(busy_direct, 1)) FILTER (reached), 1), 0e0) AS mean_travel_s,
    coalesce(round(avg(round(busy_pick - free_pick, 1)) FILTER (reached), 1), 0e0) AS mean_delay_s,
    coalesce(round(avg(abs(round(dynamic_s, 1) - round(static_s, 1))) FILTER (reached), 1), 0e0) AS mean_eta_error_s FROM ranked GROUP BY scenario),
  per AS (SELECT scenario, rider_id, max(driver_id) FILTER (static_rk = 1) AS s1, max(driver_id) FILTER (dynamic_rk = 1) AS d1, max(dynamic_s) FILTER (dynamic_rk = 1) AS sel,
    count(*) FILTER (dynamic_rk = 1) AS h1, count(*) FILTER (dynamic_rk <= 3) AS h3, coalesce(sum(1e0/log2(dynamic_rk + 1e0)) FILTER (dynamic_rk <= 3), 0e0) AS dcg,
    count(*) FILTER (dynamic_feasible) AS rel FROM ranked GROUP BY scenario, rider_id),
  agg AS (SELECT scenario, round(avg(CASE WHEN s1 IS DISTINCT FROM d1 THEN 1e0 ELSE 0e0 END), 3) AS top1_change_rate, round(avg(h1), 3) AS p1, round(avg(h3/3e0), 3) AS p3,
    round(avg(CASE WHEN rel = 0 THEN 0e0 WHEN rel = 1 THEN dcg WHEN rel = 2 THEN dcg/(1e0 + 1e0/log2(3e0)) ELSE dcg/(1.5e0 + 1e0/log2(3e0)) END), 3) AS ndcg3,
    coalesce(round(avg(round(sel, 1)), 1), 0e0) AS mean_selected_detour_s FROM per GROUP BY scenario)
  SELECT * FROM sec JOIN agg USING (scenario)"""


@query("e7_congestion_scenarios", _scenarios_sql())
def e7_scenarios(spark, sf):
    return evaluate.congestion_report(scenario_pairs(spark, sf))


OFFSETS = (-30, -15, -10, -5, 0, 5, 10, 15, 30)


@query("e8_departure_sensitivity")
def e8(spark, sf):
    """Feasibility flips and shifts when every departure moves by an offset (moderate congestion, 08:30)."""
    e = fixture(spark, sf, "edges").withColumn("_dir", congestion.edge_direction(F.col("u_name"), F.col("v_name")))
    e = e.withColumn("variant", F.explode(F.array(*[F.lit(o) for o in OFFSETS])))
    e = e.withColumn("secs", congestion.link_seconds(F.col("secs"), 8.5 + F.col("variant") / 60.0, F.col("_dir"), "moderate_congestion"))
    s = fixture(spark, sf, "nodes").select("node", F.explode(F.array(*[F.lit(o) for o in OFFSETS])).alias("variant"))
    table = network.od_costs(e, s, variant="variant")
    p = road_pairs(spark, sf, network.side_by_side(od(spark, sf), table, "variant", OFFSETS), ("km", "s", "kms", "ss"), copies=True)
    # the pair as it is, beside its variants; a pair found in several rows is compared with each of them
    now = OFFSETS.index(0)
    p = p.drop("pooled_km", "pooled_s", "detour_km", "detour_s", "duration_ratio").withColumns({f"{leg}_{one}": F.get(f"{leg}_{many}", F.lit(now)) for leg in ("direct", "pick", "ride", "last") for one, many in (("km", "kms"), ("s", "ss"))})
    p = pruning.congested_scores(network.with_leg_detour(p, out="zero_"), THRESHOLDS, "zero")
    p = p.withColumn("_times", F.col("r_copies") * F.col("v_copies")).withColumnsRenamed({"direct_s": "_ds", "pick_s": "_ps"})
    p = in_variants(p, "variant", OFFSETS, ["rider_id", "driver_id", "road_pickup_km", "dep_diff_min", "direction_sim", "zero_feasible", "zero_score", "_ds", "_ps", "_times"])
    times = lambda cond: F.sum(F.when(cond, F.col("_times")).otherwise(0))
    travel, pickup = F.abs(F.col("direct_s") - F.col("_ds")), F.abs(F.col("pick_s") - F.col("_ps"))
    first = lambda tag: F.max(F.when(F.col(f"{tag}_score") > 0, F.struct(f"{tag}_score", (-F.col("driver_id")).alias("d"))))["d"]
    per = p.groupBy("variant", "rider_id").agg(
        first("dynamic").alias("_t"), first("zero").alias("_t0"),
        times(F.col("dynamic_feasible")).alias("feasible"), times(F.col("dynamic_feasible") != F.col("zero_feasible")).alias("flips"),
        F.sum(travel * F.col("_times")).alias("travel"), times(travel.isNotNull()).alias("travels"),
        F.sum(pickup * F.col("_times")).alias("pickup"), times(pickup.isNotNull()).alias("pickups"))
    mean = lambda total, n: F.round(F.try_divide(F.sum(total), F.sum(n)), 1)
    return per.groupBy(F.col("variant").alias("offset_min")).agg(
        F.sum("feasible").alias("feasible"), F.sum("flips").alias("flips"), mean("travel", "travels").alias("mean_travel_shift_s"),
        mean("pickup", "pickups").alias("mean_pickup_shift_s"), F.round(F.avg(F.when(F.equal_null("_t", "_t0"), 0.0).otherwise(1.0)), 3).alias("top1_change_rate"))


_SHIFT = "((driver_id*7919) % 601 - 300)"
_AVAILABLE = "((driver_id*driver_id + 17) % 10007) % 100 >= 25"


def _perturbable(spark, sf) -> DataFrame:
    """Candidates with five minutes of slack on the time limit, so that shifted departures can enter."""
    p = pairs.radius_pairs(fixture(spark, sf, "riders"), fixture(spark, sf, "drivers"), 2.0, 3.0, 35.0)
    return cut_lineage(pairs.pair_features(p).withColumn("relevant", F.expr(_REL)))


def _gated(df: DataFrame) -> DataFrame:
    return gates.with_score(gates.with_gates(df)).select("rider_id", "driver_id", "eligible", "score", "reasons", "relevant")


_PERT_SQL = (
    with_clause("riders", "drivers") + ", " + q.journeys_join(2, 3, 35) + ", " + q.FEATURES + ", " + q.similarity()
    + f""", feat AS (SELECT feat0.*, route_sim, {_REL} AS relevant FROM feat0 JOIN sim USING (driver_id, rider_id)),
  ctl0 AS (SELECT *, dep_diff_min AS dd FROM feat), shifted AS (SELECT f.* REPLACE (abs(v.dep_s + {_SHIFT.replace('driver_id', 'f.driver_id')} - r.dep_s)/60e0 AS dep_diff_min) FROM feat f JOIN drivers v USING (driver_id) JOIN riders r USING (rider_id)),
  """ + q.GATED.replace("gated AS", "cg AS").format(src="feat") + ", " + q.GATED.replace("gated AS", "pg AS").format(src="shifted") + """,
  cs AS (SELECT rider_id, driver_id, relevant, eligible, concat_ws(';', ok_direction, ok_pickup, ok_dest, ok_departure, ok_detour, ok_identity, ok_vehicle, ok_capacity, ok_safety) AS why, """ + f"CAST(round(CAST({q.RAW} AS DECIMAL(20,8)), 2) AS DOUBLE)" + """ AS score FROM cg),
  ps0 AS (SELECT rider_id, driver_id, relevant, eligible, concat_ws(';', ok_direction, ok_pickup, ok_dest, ok_departure, ok_detour, ok_identity, ok_vehicle, ok_capacity, ok_safety) AS why, """ + f"CAST(round(CAST({q.RAW} AS DECIMAL(20,8)), 2) AS DOUBLE)" + """ AS score FROM pg)""")


def _robust_sql(perturbed: str) -> str:
    return _PERT_SQL + f""", ps AS ({perturbed}), tp AS (SELECT rider_id, driver_id FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY score DESC, driver_id) AS rk FROM ps WHERE eligible) t WHERE rk <= 3),
  ov AS (SELECT rider_id, count(*) AS n FROM tp JOIN cs USING (rider_id, driver_id) WHERE cs.eligible GROUP BY 1),
  b AS (SELECT c.rider_id, count(*) AS pool, count(p.driver_id) AS available, count(*) FILTER (c.eligible) AS control_eligible, count(*) FILTER (p.eligible) AS eligible,
    count(*) FILTER (c.eligible AND p.eligible) AS both_ok, count(*) FILTER (p.eligible AND NOT c.eligible) AS newly_eligible, count(*) FILTER (c.relevant AND p.driver_id IS NULL) AS lost_availability,
    count(*) FILTER (c.relevant AND p.driver_id IS NOT NULL AND NOT p.eligible) AS lost_hard_filter, count(*) FILTER (p.why <> c.why) AS reason_changes FROM cs c LEFT JOIN ps p USING (rider_id, driver_id) GROUP BY c.rider_id)
  SELECT rider_id, pool, available, control_eligible, eligible, newly_eligible, lost_availability, lost_hard_filter, reason_changes,
    round(CASE WHEN control_eligible > 0 THEN both_ok/CAST(control_eligible AS DOUBLE) END, 6) AS retention, round(CASE WHEN control_eligible > 0 THEN coalesce(n, 0)/CAST(control_eligible AS DOUBLE) END, 6) AS top_overlap,
    round(eligible/CAST(pool AS DOUBLE), 6) AS coverage_original, round(CASE WHEN available > 0 THEN eligible/CAST(available AS DOUBLE) END, 6) AS coverage_available FROM b LEFT JOIN ov USING (rider_id)"""


def _rounded(df: DataFrame) -> DataFrame:
    names = ("retention", "top_overlap", "coverage_original", "coverage_available")
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("e10_robustness_departure", _robust_sql("SELECT * FROM ps0"))
def e10(spark, sf):
    f = _perturbable(spark, sf)
    moved = f.withColumn("dep_diff_min", F.abs(F.col("v_dep_s") + F.expr(_SHIFT) - F.col("r_dep_s")) / 60.0)
    return _rounded(evaluate.robustness(_gated(f), _gated(moved)))


@query("e11_availability", _robust_sql(f"SELECT cs.* FROM cs WHERE {_AVAILABLE}"))
def e11(spark, sf):
    f = _gated(_perturbable(spark, sf))
    return _rounded(evaluate.robustness(f, f.filter(F.expr(_AVAILABLE))))


_TOL = "(2e0 + 3e0*((rider_id*131 + 7) % 997)/997e0)"
_SHAPE = "(0.48e0 + 0.44e0*((rider_id*57 + 3) % 991)/991e0)"
_RELIABLE = "(0.35e0 + 0.63e0*((driver_id*71 + 11) % 983)/983e0)"
_DRAW = "(((rider_id*31 + driver_id*17) % 977)/977e0)"
_HELD_SQL = q.scored() + f""", ut AS (SELECT *, {_DRAW} AS draw, 0.27e0*pow(greatest(0e0, 1e0 - detour_km/{_TOL}), 2e0) + 0.20e0*pow(greatest(0e0, 1e0 - dest_km/3e0), 1.5e0) + 0.18e0*pow(direction_sim, 3e0)
    + 0.13e0*pow(greatest(0e0, 1e0 - dep_diff_min/30e0), 2e0) + 0.12e0*(greatest(0, capacity - seats)/(greatest(0, capacity - seats) + 2e0)) + 0.10e0*{_RELIABLE} AS utility FROM scored),
  held AS (SELECT *, greatest(0.01e0, least(0.97e0, (0.02e0 + 0.94e0/(1e0 + exp(-greatest(-30e0, least(30e0, 1.65e0*(utility - 0.45e0))))))*greatest(0e0, least(1e0, route_sim/{_SHAPE})))) AS probability FROM ut)"""


def held_out(spark, sf) -> DataFrame:
    return evaluate.heldout_labels(standard_scored(spark, sf), F.expr(_TOL), F.expr(_SHAPE), F.expr(_RELIABLE), F.expr(_DRAW))


@query("e12_heldout_labels", _HELD_SQL + " SELECT rider_id, driver_id, round(utility, 6) AS utility, round(probability, 6) AS probability, draw < probability AS relevant FROM held")
def e12(spark, sf):
    return held_out(spark, sf).select("rider_id", "driver_id", F.round("utility", 6).alias("utility"), F.round("probability", 6).alias("probability"), "relevant")


@query("e12_top3_utility", _HELD_SQL + """ SELECT rider_id, round(sum(utility)/3e0, 6) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY score DESC, driver_id) AS rk FROM held WHERE eligible) t
  WHERE rk <= 3 GROUP BY rider_id""")
def e12_quality(spark, sf):
    top = rank.rank_eligible(held_out(spark, sf), 3)
    return top.groupBy("rider_id").agg(F.round(F.sum("utility") / 3.0, 6).alias("quality"))
