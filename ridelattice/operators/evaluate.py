"""Ranking quality, agreement, confusion and sensitivity jobs.

Per-query counts come from aggregates with map-side combine; only the top rows
per query are ranked (window group limit), so a query with very many candidates
never sorts in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.operators.rank import top_k
from ridelattice.operators.running import running_row_number
from ridelattice.session import cut_lineage


def _log2_discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def _ideal(counts: Column, k: int) -> Column:
    """Best possible discounted gain of ``counts`` relevant items in k places."""
    total = F.lit(0.0)
    for i in range(1, k + 1):
        total = total + F.when(counts >= i, _log2_discount(F.lit(float(i)))).otherwise(0.0)
    return total


def query_metrics(pairs: DataFrame, query: Sequence[str], order: Sequence[Column], k: int = 3) -> DataFrame:
    """Precision@k (fixed k), recall@k, binary NDCG@k (null without relevant), coverage, losses.

    ``pairs`` holds every candidate with booleans ``eligible`` and ``relevant``.
    """
    base = pairs.groupBy(*query).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"), F.count_if("relevant").alias("relevant"),
        F.count_if(F.col("relevant") & ~F.col("eligible")).alias("lost_to_filter"))
    top = top_k(pairs.filter("eligible"), k, query, order)
    hits = top.groupBy(*query).agg(
        F.count_if("relevant").alias("hits"), F.sum(F.when(F.col("relevant"), _log2_discount(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    j = base.join(hits, list(query), "left").fillna({"hits": 0, "dcg": 0.0})
    some = F.col("relevant") > 0
    return j.withColumns({
        "precision_at_k": F.col("hits") / float(k),
        "recall_at_k": F.when(some, F.col("hits") / F.col("relevant")),
        "ndcg_at_k": F.when(some, F.col("dcg") / _ideal(F.col("relevant"), k)),
        "coverage": F.col("eligible") / F.col("candidates"),
        "zero_relevant": ~some,
    }).drop("hits", "dcg")


def mean_by(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means that skip nulls, with the number of excluded rows per metric."""
    aggs = [F.count(F.lit(1)).alias("queries")]
    for m in metrics:
        aggs += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.count_if(F.col(m).isNull()).alias(f"{m}_excluded")]
    return rows.groupBy(*keys).agg(*aggs)


#: Rows of a query up to which its candidates are ranked by windows over the query, and distinct scores up to which they are compared
#: pair by pair. Larger queries take the ways that never hold one query in a task.
WINDOW_ROWS, PLAIN_ROWS = 20_000, 128


def split_by_size(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that have at most ``most`` of them, and rows of the others, if there are any."""
    large = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(key))
    if large.isEmpty():
        return df, None
    return df.join(large, key, "left_anti"), df.join(large, key, "left_semi")


def graded_metrics(scored: DataFrame, methods: Sequence[str], cuts: Sequence[int] = (1, 3, 5), most: int = WINDOW_ROWS) -> DataFrame:
    """Per method: P/R@k, graded NDCG@k (gain 2^grade - 1), MRR, coverage, capped averages of the first choice.

    ``scored``: rider_id, driver_id, relevance, reachable, detour_km, detour_s, road_pickup_km and one score column per method.
    Only positive scores are recommended. Pairs are shuffled once, to their rider; all methods are ranked there.
    """
    small, large = split_by_size(scored, "rider_id", most)
    per = _graded_in_windows(small, methods, cuts)
    if large is not None:
        long = large.select("rider_id", "driver_id", "relevance", "reachable", "detour_km", "detour_s", "road_pickup_km",
                            F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])))
        per = per.unionByName(_graded_by_aggregates(long, cuts).select(*per.columns))
    return _graded_means(per, cuts)


_CAPS = {"sel_km": ("detour_km", 10.0), "sel_s": ("detour_s", 600.0), "sel_pick": ("road_pickup_km", 5.0)}


def _capped(col: str, cap: float, first: Column) -> Column:
    return F.max(F.when(first, F.when(F.col("reachable"), F.least(F.lit(cap), F.coalesce(F.col(col), F.lit(cap)))).otherwise(cap)))


def _graded_in_windows(scored: DataFrame, methods: Sequence[str], cuts: Sequence[int]) -> DataFrame:
    """A row per method and query; every window is over the query, so they share one shuffle."""
    c = F.col
    rank = lambda m: c(f"_rank_{m}")
    ranked = scored
    for m in methods:
        ranked = ranked.withColumn(f"_rank_{m}", F.row_number().over(Window.partitionBy("rider_id").orderBy(F.desc(m), "driver_id")))
    aggs = [F.count_if(c("relevance") >= 1).alias("relevant"), *[F.count_if(c("relevance") == g).alias(f"g{g}") for g in (1, 2, 3)], F.count(F.lit(1)).alias("n")]
    for m in methods:
        shown = c(m) > 0
        hit = shown & (c("relevance") >= 1)
        gain = (F.pow(F.lit(2.0), c("relevance")) - 1.0) * _log2_discount(rank(m))
        part = {"score_sum": F.sum(m), "recommended": F.count_if(shown), "ahead": F.min(F.when(hit, rank(m))) - 1}
        for k in cuts:
            part |= {f"hits{k}": F.count_if(hit & (rank(m) <= k)), f"dcg{k}": F.sum(F.when(shown & (rank(m) <= k), gain).otherwise(0.0))}
        part |= {out: _capped(*of, shown & (rank(m) == 1)) for out, of in _CAPS.items()}
        aggs.append(F.struct(F.lit(m).alias("method"), *[x.alias(n) for n, x in part.items()]).alias(f"_{m}"))
    per = ranked.groupBy("rider_id").agg(*aggs)
    return per.select("rider_id", "relevant", "g1", "g2", "g3", "n", F.inline(F.array(*[c(f"_{m}") for m in methods])))


def _graded_by_aggregates(scored: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """The same rows from long pairs (``method``, ``score``) by map-side combined aggregates and cuts, for queries of any size."""
    c = F.col
    key = ["method", "rider_id"]
    base = scored.groupBy(*key).agg(
        F.count_if(c("relevance") >= 1).alias("relevant"), *[F.count_if(c("relevance") == g).alias(f"g{g}") for g in (1, 2, 3)],
        F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n"),
        F.max(F.when((c("score") > 0) & (c("relevance") >= 1), F.struct("score", (-c("driver_id")).alias("d")))).alias("best"))
    top = top_k(scored.filter(c("score") > 0), max(cuts), key, [F.desc("score"), c("driver_id")])
    gain = (F.pow(F.lit(2.0), c("relevance")) - 1.0) * _log2_discount(c("rank"))
    aggs = [F.count(F.lit(1)).alias("recommended")]
    for k in cuts:
        aggs += [F.count_if((c("rank") <= k) & (c("relevance") >= 1)).alias(f"hits{k}"), F.sum(F.when(c("rank") <= k, gain).otherwise(0.0)).alias(f"dcg{k}")]
    aggs += [_capped(*of, c("rank") == 1).alias(out) for out, of in _CAPS.items()]
    per = base.join(top.groupBy(*key).agg(*aggs), key, "left")
    # reciprocal rank of the first relevant recommendation: how many positive scores precede it
    at = base.filter(c("best").isNotNull()).select(*key, c("best.score").alias("_bs"), (-c("best.d")).alias("_bd"))
    ahead = scored.filter(c("score") > 0).join(at, key).groupBy(*key).agg(
        F.count_if((c("score") > c("_bs")) | ((c("score") == c("_bs")) & (c("driver_id") < c("_bd")))).alias("ahead"))
    return per.join(ahead, key, "left")


def _graded_means(per: DataFrame, cuts: Sequence[int]) -> DataFrame:
    c = F.col
    grade_at = lambda i: F.when(c("g3") >= i, 7.0).when(c("g3") + c("g2") >= i, 3.0).when(c("g3") + c("g2") + c("g1") >= i, 1.0).otherwise(0.0)
    cols = {}
    for k in cuts:
        ideal = F.lit(0.0)
        for i in range(1, k + 1):
            ideal = ideal + grade_at(i) * _log2_discount(F.lit(float(i)))
        cols[f"p{k}"] = F.coalesce(c(f"hits{k}"), F.lit(0)) / float(k)
        cols[f"r{k}"] = F.when(c("relevant") > 0, F.coalesce(c(f"hits{k}"), F.lit(0)) / c("relevant")).otherwise(0.0)
        cols[f"ndcg{k}"] = F.when(ideal > 0, F.coalesce(c(f"dcg{k}"), F.lit(0.0)) / ideal).otherwise(0.0)
    cols["rr"] = F.coalesce(1.0 / (c("ahead") + 1), F.lit(0.0))
    per = per.withColumns(cols)
    out = [F.round(F.avg(n), 3).alias(n) for n in cols if n != "rr"]
    return per.groupBy("method").agg(
        *out, F.round(F.avg("rr"), 3).alias("mrr"), F.round(F.avg(F.when(c("recommended") > 0, 100.0).otherwise(0.0)), 1).alias("coverage_pct"),
        F.round(F.sum("score_sum") / F.sum("n"), 2).alias("mean_score"), F.round(F.avg("sel_km"), 3).alias("mean_selected_detour_km"),
        F.round(F.avg("sel_s"), 1).alias("mean_selected_detour_s"), F.round(F.avg("sel_pick"), 3).alias("mean_selected_pickup_km"))


def agreement(a: DataFrame, b: DataFrame, riders: DataFrame, keys: Sequence[str] = ("rider_id",), k: int = 3) -> DataFrame:
    """Per query: same first choice, and Jaccard of the top-k sets (1.0 when both are empty).

    ``a`` and ``b`` are ranked top lists ``(keys, driver_id, rank)``.
    """
    keys = list(keys)
    both = (
        a.select(*keys, "driver_id", F.col("rank").alias("_ra")).join(b.select(*keys, "driver_id", F.col("rank").alias("_rb")), [*keys, "driver_id"], "full")
        .groupBy(*keys).agg(
            F.count_if(F.col("_ra").isNotNull() & F.col("_rb").isNotNull()).alias("_i"), F.count(F.lit(1)).alias("_u"),
            F.count_if((F.col("_ra") == 1) & (F.col("_rb") == 1)).alias("_same")))
    j = riders.join(both, keys, "left")
    return j.select(*keys, F.when(F.col("_u").isNull(), True).otherwise(F.col("_same") > 0).alias("same_top1"),
                    F.when(F.col("_u").isNull(), 1.0).otherwise(F.col("_i") / F.col("_u")).alias("jaccard"))


def spearman(pairs: DataFrame, query: str, a: str, b: str, item: str = "driver_id", most: int = WINDOW_ROWS) -> DataFrame:
    """Rank correlation per query; ranks by score, ties in item order. Queries of more than ``most`` rows are ranked in buckets."""

    def ranked(df: DataFrame, score: str, out: str) -> DataFrame:
        bucket = F.struct((-F.round(F.col(score) * 100)).alias("s"), F.floor(F.col(item) / 256).alias("d"))
        return running_row_number(df, [query], bucket, [F.desc(score), F.col(item)], out)

    pairs = pairs.select(query, item, a, b)
    small, large = split_by_size(pairs, query, most)
    # both ranks of a query from one shuffle
    by = Window.partitionBy(query)
    r = small.withColumn("_ra", F.row_number().over(by.orderBy(F.desc(a), item))).withColumn("_rb", F.row_number().over(by.orderBy(F.desc(b), item, "_ra")))
    if large is not None:
        r = r.unionByName(ranked(ranked(large, a, "_ra"), b, "_rb").select(*r.columns))
    d = (F.col("_ra") - F.col("_rb")).cast("double")
    g = r.groupBy(query).agg(F.sum(d * d).alias("_d2"), F.count(F.lit(1)).cast("double").alias("_n")).filter(F.col("_n") > 1)
    return g.select(query, (1.0 - 6.0 * F.col("_d2") / (F.col("_n") * (F.col("_n") * F.col("_n") - 1))).alias("rho"))


def inversions(pairs: DataFrame, query: str, a: str, b: str, most: int = PLAIN_ROWS) -> DataFrame:
    """Pairs of candidates that the two scores order differently; a query of more than ``most`` rows never forms them.

    Scores have two decimals, so each is an integer below 4**7. Two values first
    differ in exactly one base-4 digit; grouping by the shared digits above it, for
    both scores at once, turns pair counting into products of small digit counts.
    """
    ints = pairs.select(query, F.round(F.col(a) * 100).cast("int").alias("_g"), F.round(F.col(b) * 100).cast("int").alias("_n"))
    small, large = split_by_size(ints, query, most)
    out = _inversions_pair_by_pair(small, query)
    return out if large is None else out.unionByName(_inversions_by_digits(large, query))


def _inversions_pair_by_pair(ints: DataFrame, query: str) -> DataFrame:
    """A query with n different pairs of scores compares n * n of them where they are, after one shuffle."""
    c = F.col
    one = ints.repartition(query).groupBy(query, "_g", "_n").agg(F.count(F.lit(1)).alias("_c"))
    other = one.select(query, c("_g").alias("_g2"), c("_n").alias("_n2"), c("_c").alias("_c2"))
    compared = (c("_g") < c("_g2")) & (c("_n") != c("_n2"))
    product = c("_c") * c("_c2")
    return one.join(other, query).groupBy(query).agg(
        F.sum(F.when(compared & (c("_n") > c("_n2")), product).otherwise(0)).alias("inverted"), F.sum(F.when(compared, product).otherwise(0)).alias("comparable"))


def _inversions_by_digits(ints: DataFrame, query: str) -> DataFrame:
    levels = range(7)
    ints = ints.groupBy(query, "_g", "_n").agg(F.count(F.lit(1)).alias("_c"))

    def digits(v: str) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("l"), F.shiftright(v, 2 * i + 2).alias("p"), F.shiftright(v, 2 * i).bitwiseAND(3).alias("d")) for i in levels])

    long = ints.select(query, "_c", "_n", F.explode(digits("_g")).alias("x")).select(query, "_c", "x", F.explode(digits("_n")).alias("y"))
    cells = [(g, n) for g in range(4) for n in range(4)]
    grouped = long.groupBy(query, F.col("x.l").alias("xl"), F.col("x.p").alias("xp"), F.col("y.l").alias("yl"), F.col("y.p").alias("yp")).agg(*[
        F.sum(F.when((F.col("x.d") == g) & (F.col("y.d") == n), F.col("_c")).otherwise(0)).alias(f"c{g}{n}") for g, n in cells])
    against, compared = F.lit(0), F.lit(0)
    for g1, n1 in cells:
        for g2, n2 in cells:
            if g1 < g2 and n1 != n2:
                product = F.col(f"c{g1}{n1}") * F.col(f"c{g2}{n2}")
                compared = compared + product
                if n1 > n2:
                    against = against + product
    return grouped.groupBy(query).agg(F.sum(against).alias("inverted"), F.sum(compared).alias("comparable"))


def confusion(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Gate ``a`` against gate ``b``: false positives, false negatives, disagreement rate, unreachable."""
    c = F.col
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(c(a) & ~c(b)).alias("false_positives"), F.count_if(~c(a) & c(b)).alias("false_negatives"),
        F.round(F.count_if(c(a) != c(b)) / F.count(F.lit(1)), 3).alias("disagreement_rate"), F.count_if(~c("reachable")).alias("unreachable"))


def pruning_report(kept: DataFrame, methods: Sequence[str], most: int = WINDOW_ROWS) -> DataFrame:
    """Pruned share, losses, and ranking agreement of every pruner with the full routing result.

    Counts are one aggregate over all pairs with a column per method. Pairs with a score are shuffled once, to their rider, and
    ranked there for all methods; a rider's lists are compared in one row.
    """
    c = F.col
    keep = lambda m: c(f"keep_{m}")
    sums = kept.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("feasible").alias("feasible"), *[
        n.alias(f"{kind}_{m}") for m in methods for kind, n in (
            ("routed", F.count_if(keep(m))), ("fn", F.count_if(~keep(m) & c("feasible"))), ("fp", F.count_if(keep(m) & ~c("feasible"))))])
    counts = sums.select(F.inline(F.array(*[F.struct(
        F.lit(m).alias("method"), c("pairs"), c(f"routed_{m}").alias("routed"), c("feasible"), c(f"fn_{m}").alias("false_negatives"), c(f"fp_{m}").alias("false_positives"))
        for m in methods])))
    cols = ["rider_id", "driver_id", "feasible", "score", *[f"keep_{m}" for m in methods]]
    small, large = split_by_size(kept.filter(c("score") > 0).select(*cols), "rider_id", most)
    shown = lambda m: (c(f"_rank_{m}") <= 3) & keep(m)
    some = reduce(lambda x, y: x | y, [shown(m) for m in methods], c("_rank") <= 3)

    def ranked(df: DataFrame, *by: str) -> DataFrame:
        """Rows among the first three of all or of a method; every window is over the same key, so they share one shuffle."""
        order = [F.desc("score"), c("driver_id")]
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        for m in methods:
            df = df.withColumn(f"_rank_{m}", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(f"keep_{m}"), *order)))
        return df.filter(some)

    if large is not None:
        # a large query is cut part by part first
        small = small.unionByName(ranked(large.withColumn("_part", F.pmod(F.xxhash64("driver_id"), F.lit(256))), "rider_id", "_part").select(*cols))
    parts = {}
    for m in methods:
        hit = shown(m) & c("feasible")
        at = c(f"_rank_{m}")
        parts |= {f"n_{m}": F.count_if(shown(m)), f"n1_{m}": F.count_if(shown(m) & (at == 1)), f"h1_{m}": F.count_if(hit & (at == 1)), f"h3_{m}": F.count_if(hit),
                  f"dcg_{m}": F.sum(F.when(hit, _log2_discount(at)).otherwise(0.0)), f"first_{m}": F.min(F.when(hit, at))}
    each = ranked(small, "rider_id").groupBy("rider_id", "driver_id").agg(
        F.count_if(c("_rank") <= 3).alias("f"), F.count_if(c("_rank") == 1).alias("f1"), *[x.alias(n) for n, x in parts.items()])
    mine = []
    for m in methods:
        both, first = c("f") * c(f"n_{m}"), c("f1") * c(f"n1_{m}")
        mine.append(F.struct(
            F.lit(m).alias("method"), F.sum(both).alias("_i"), F.sum(F.when(both > 0, both).otherwise(c("f") + c(f"n_{m}"))).alias("_u"), F.sum(first).alias("_same"),
            F.sum(f"h1_{m}").alias("h1"), F.sum(f"h3_{m}").alias("h3"), F.sum(f"dcg_{m}").alias("dcg"), F.min(f"first_{m}").alias("first")).alias(m))
    good = each.groupBy("rider_id").agg(*mine)
    riders = kept.groupBy("rider_id").agg(F.count_if("feasible").alias("relevant"))
    per = riders.join(good, "rider_id", "left").select("rider_id", "relevant", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), *[c(f"{m}.{n}").alias(n) for n in ("_i", "_u", "_same", "h1", "h3", "dcg", "first")]) for m in methods])))
    per = per.fillna({"h1": 0, "h3": 0, "dcg": 0.0}).withColumns({
        "same_top1": F.coalesce(c("_same") > 0, F.lit(True)), "jaccard": F.coalesce(F.try_divide("_i", "_u"), F.lit(1.0))})
    ideal = _ideal(c("relevant"), 3)
    ranks = per.groupBy("method").agg(
        F.round(F.avg(c("same_top1").cast("double")), 3).alias("top1_agreement"), F.round(F.avg("jaccard"), 3).alias("top3_jaccard"),
        F.round(F.avg("h1"), 3).alias("p1"), F.round(F.avg(c("h3") / 3.0), 3).alias("p3"),
        F.round(F.avg(F.when(c("relevant") > 0, c("h3") / c("relevant")).otherwise(0.0)), 3).alias("r3"),
        F.round(F.avg(F.when(ideal > 0, c("dcg") / ideal).otherwise(0.0)), 3).alias("ndcg3"), F.round(F.avg(F.coalesce(1.0 / c("first"), F.lit(0.0))), 3).alias("mrr"))
    recall = F.when(c("feasible") > 0, F.round((c("feasible") - c("false_negatives")) / c("feasible"), 3)).otherwise(1.0)
    return counts.withColumns({"pruned_pct": F.round((1.0 - c("routed") / c("pairs")) * 100.0, 2), "recall": recall}).join(ranks, "method")


def robustness(control: DataFrame, perturbed: DataFrame, k: int = 3) -> DataFrame:
    """Perturbed against control per query.

    Both hold ``rider_id, driver_id, eligible, score, reasons, relevant``; a driver
    missing from ``perturbed`` was unavailable. Labels are those of the control.
    """
    c = F.col
    order = [F.desc("score"), c("driver_id")]
    b = perturbed.select("rider_id", "driver_id", c("eligible").alias("p_eligible"), c("reasons").alias("p_reasons"))
    j = control.join(b, ["rider_id", "driver_id"], "left")
    here = c("p_eligible").isNotNull()
    now = F.coalesce(c("p_eligible"), F.lit(False))
    base = j.groupBy("rider_id").agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(here).alias("available"), F.count_if("eligible").alias("control_eligible"), F.count_if(now).alias("eligible"),
        F.count_if(c("eligible") & now).alias("kept"), F.count_if(now & ~c("eligible")).alias("newly_eligible"),
        F.count_if(c("relevant") & ~here).alias("lost_availability"), F.count_if(c("relevant") & here & ~now).alias("lost_hard_filter"),
        F.count_if(here & (c("reasons") != c("p_reasons"))).alias("reason_changes"))
    mine = top_k(perturbed.filter("eligible"), k, ["rider_id"], order).select("rider_id", "driver_id", F.lit(1).alias("_in"))
    # overlap is divided by the control's whole ranking, so every control-eligible driver counts
    both = control.filter("eligible").select("rider_id", "driver_id").join(mine, ["rider_id", "driver_id"]).groupBy("rider_id").agg(F.count(F.lit(1)).alias("_both"))
    out = base.join(both, "rider_id", "left")
    return out.withColumns({
        "retention": F.when(c("control_eligible") > 0, c("kept") / c("control_eligible")),
        "top_overlap": F.when(c("control_eligible") > 0, F.coalesce(c("_both"), F.lit(0)) / c("control_eligible")),
        "coverage_original": c("eligible") / c("pool"),
        "coverage_available": F.when(c("available") > 0, c("eligible") / c("available")),
    }).drop("_both", "kept")


# Fixed values of the held-out label model
UTILITY_WEIGHTS = {"detour": 0.27, "dest": 0.20, "direction": 0.18, "time": 0.13, "slack": 0.12, "reliability": 0.10}


def heldout_labels(pairs: DataFrame, detour_tol: Column, shape_tol: Column, reliability: Column, draw: Column) -> DataFrame:
    """Utility, acceptance probability and label from given tolerances and uniforms."""
    c = F.col
    w = UTILITY_WEIGHTS
    fit = lambda v, lim: F.greatest(F.lit(0.0), 1.0 - v / lim)
    slack = F.greatest(F.lit(0), c("v_capacity") - c("r_seats"))
    utility = (
        w["detour"] * F.pow(fit(c("detour_km"), detour_tol), F.lit(2.0)) + w["dest"] * F.pow(fit(c("dest_km"), F.lit(3.0)), F.lit(1.5))
        + w["direction"] * F.pow(c("direction_sim"), F.lit(3.0)) + w["time"] * F.pow(fit(c("dep_diff_min"), F.lit(30.0)), F.lit(2.0))
        + w["slack"] * (slack / (slack + 2.0)) + w["reliability"] * reliability)
    pairs = pairs.withColumn("utility", utility)
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 1.65 * (c("utility") - 0.45)))
    shape = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("route_sim") / shape_tol))
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.97), (0.02 + 0.94 / (1.0 + F.exp(-logit))) * shape))
    return pairs.withColumn("probability", p).withColumn("relevant", draw < c("probability"))


def congestion_report(pairs: DataFrame, by: str = "scenario", k: int = 3) -> DataFrame:
    """One row per congestion scenario: travel time, delay, feasibility, and how rankings move against free flow.

    ``pairs``: rider_id, driver_id, static and dynamic ``score``, ``dynamic_feasible``, ``static_detour_s``, ``dynamic_detour_s``,
    ``static_pick_s``, ``pick_s``, ``direct_s``. A pair with a null cost is unreachable and left out of the means of seconds,
    which are over values of one decimal; the delay is that of the pickup leg against the fastest route at free flow. A rider without a choice has precision 0. A mean over nothing is 0.
    """
    c = F.col
    tenth = lambda x: F.round(x, 1)
    reached = c("static_detour_s").isNotNull() & c("dynamic_detour_s").isNotNull() & c("direct_s").isNotNull() & c("pick_s").isNotNull()
    mean = lambda x: F.coalesce(F.round(F.avg(x), 1), F.lit(0.0))
    parts = {
        "mean_travel_s": F.when(reached, tenth(c("direct_s"))), "mean_delay_s": F.when(reached, tenth(c("pick_s") - c("static_pick_s"))),
        "mean_eta_error_s": F.when(reached, F.abs(tenth(c("dynamic_detour_s")) - tenth(c("static_detour_s"))))}
    first = lambda t: F.max(F.when(c(f"{t}_score") > 0, F.struct(f"{t}_score", (-c("driver_id")).alias("d"), "dynamic_detour_s")))
    # one pass over the pairs: what is counted over all of them is summed up over the riders
    riders = pairs.groupBy(by, "rider_id").agg(
        F.count(F.lit(1)).alias("_pairs"), F.count_if("dynamic_feasible").alias("_relevant"), F.count_if(c("dynamic_score") > 0).alias("_ranked"),
        first("static").alias("_s"), first("dynamic").alias("_d"), *[f(x).alias(f"{n}_{t}") for n, x in parts.items() for t, f in (("sum", F.sum), ("n", F.count))])
    # all ranked drivers are feasible, so the first min(k, ranked) places are hits
    shown = F.least(c("_ranked"), F.lit(k))
    ideal = _ideal(c("_relevant"), k)
    return riders.groupBy(by).agg(
        F.sum("_pairs").alias("pairs"), F.sum("_relevant").alias("feasible_pairs"),
        *[F.coalesce(F.round(F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_n")), 1), F.lit(0.0)).alias(n) for n in parts],
        F.round(F.avg(F.when(F.equal_null(c("_s.d"), c("_d.d")), 0.0).otherwise(1.0)), 3).alias("top1_change_rate"),
        F.round(F.avg((c("_ranked") > 0).cast("double")), 3).alias("p1"), F.round(F.avg(shown / float(k)), 3).alias("p3"),
        F.round(F.avg(F.when(ideal > 0, _ideal(shown, k) / ideal).otherwise(0.0)), 3).alias("ndcg3"),
        mean(tenth(c("_d.dynamic_detour_s"))).alias("mean_selected_detour_s"))
