"""Learning to rank: feature vectors, scaling, logistic fit, scoring with an artefact."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.operators.rank import top_k

# Fixed values
FEATURES = ("pickup_km", "dest_km", "route_sim", "direction_sim", "detour_km", "dep_diff_min", "capacity_slack")
ARTEFACT_VERSION = "ridelattice-logistic-v1"


def with_slack(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("capacity_slack", F.greatest(F.lit(0), F.col("v_capacity") - F.col("r_seats")).cast("double"))


def scaling(train: DataFrame) -> DataFrame:
    """One row with mean and population deviation per feature; a zero deviation becomes one."""
    aggs = []
    for f in FEATURES:
        sd = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"{f}_mean"), F.when(sd > 0, sd).otherwise(1.0).alias(f"{f}_scale")]
    return train.agg(*aggs)


def fit(train: DataFrame, label: str, l2: float = 1.0, max_iter: int = 200) -> dict:
    """L2 logistic regression on standardised features; the intercept is not penalised.

    Training is the distributed optimiser of Spark ML; only the per-feature
    statistics and the final weights reach the driver.
    """
    s = scaling(train).first()
    if s is None:
        raise ValueError("no training rows")
    means, scales = [s[f"{f}_mean"] for f in FEATURES], [s[f"{f}_scale"] for f in FEATURES]
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("pos")).first()
    artefact = {"artefact_version": ARTEFACT_VERSION, "features": list(FEATURES), "means": means, "scales": scales,
                "weights": [0.0] * len(FEATURES), "intercept": 0.0, "fallback": None}
    if counts.pos in (0, counts.n):
        artefact["fallback"] = int(counts.pos > 0)
        return artefact
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    z = train.select(F.col(label).cast("double").alias("label"), *[((F.col(f) - m) / sc).alias(f) for f, m, sc in zip(FEATURES, means, scales)])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(z).select("label", "features")
    model = LogisticRegression(regParam=l2 / counts.n, standardization=False, maxIter=max_iter, tol=1e-10).fit(data)
    artefact["weights"], artefact["intercept"] = [float(w) for w in model.coefficients], float(model.intercept)
    return artefact


def check_artefact(artefact: dict) -> dict:
    if artefact.get("artefact_version") != ARTEFACT_VERSION:
        raise ValueError("unsupported artefact version")
    if artefact.get("features") != list(FEATURES):
        raise ValueError("feature order differs")
    for name in ("means", "scales", "weights"):
        v = artefact.get(name)
        if not isinstance(v, list) or len(v) != len(FEATURES) or not all(math.isfinite(float(x)) for x in v):
            raise ValueError(f"bad {name}")
    if not math.isfinite(float(artefact["intercept"])) or any(float(x) <= 0 for x in artefact["scales"]):
        raise ValueError("bad intercept or scale")
    if artefact.get("fallback") not in (None, 0, 1):
        raise ValueError("bad fallback")
    return artefact


def save(artefact: dict) -> str:
    return json.dumps(artefact, sort_keys=True)


def load(text: str) -> dict:
    return check_artefact(json.loads(text))


def probability(artefact: dict) -> Column:
    """Match probability as a plain expression over the feature columns."""
    a = check_artefact(artefact)
    if a["fallback"] is not None:
        return F.lit(float(a["fallback"]))
    x = F.lit(float(a["intercept"]))
    for f, w, m, s in zip(FEATURES, a["weights"], a["means"], a["scales"]):
        x = x + F.lit(float(w)) * ((F.col(f) - float(m)) / float(s))
    return F.when(x < -35, 0.0).when(x > 35, 1.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def rank_learned(pairs: DataFrame, artefact: dict, k: int = 3) -> DataFrame:
    scored = pairs.withColumn("probability", F.round(probability(artefact), 9))
    return top_k(scored, k, ["rider_id"], [F.desc("probability"), F.col("driver_id")])
