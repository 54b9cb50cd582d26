"""Running totals per key that do not put a whole key into one task.

Rows of a key are cut into ordered buckets. Bucket totals are small and get a
prefix sum; inside a bucket an ordinary window runs. The sum of both is the
running value over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], values: dict[str, Column]) -> DataFrame:
    """Add ``{name: running sum of value}``; ``bucket`` must not contradict ``order``."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, "_bucket", *[F.sum(f"_t_{n}").over(before).alias(f"_p_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_w_{n}": F.sum(v).over(inside) for n, v in values.items()})
    out = out.join(prefix, [*keys, "_bucket"], "left")
    out = out.withColumns({n: F.coalesce(F.col(f"_p_{n}"), F.lit(0)) + F.col(f"_w_{n}") for n in values})
    return out.drop("_bucket", *[f"_{t}_{n}" for n in values for t in ("p", "w")])


def running_row_number(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], out: str = "rn") -> DataFrame:
    return running_sum(df, keys, bucket, order, {out: F.lit(1).cast("bigint")})


def trailing_count(df: DataFrame, keys: Sequence[str], ts_us: Column, span_us: int, bucket_us: int, out: str = "n") -> DataFrame:
    """Rows of the key in the trailing ``span`` (inclusive) at each row.

    Each row is repeated into the next bucket when it is still inside the span
    there, so a window partitioned by (key, bucket) sees all it needs.
    """
    if bucket_us < span_us:
        raise ValueError("bucket must not be shorter than the span")
    df = df.withColumn("_us", ts_us)
    own = F.floor(F.col("_us") / bucket_us)
    reach = F.floor((F.col("_us") + span_us) / bucket_us)
    copies = df.withColumn("_b", F.explode(F.sequence(own, reach))).withColumn("_own", F.col("_b") == own)
    w = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-span_us, 0)
    return copies.withColumn(out, F.count(F.lit(1)).over(w)).filter("_own").drop("_us", "_b", "_own")
