"""Messages drawn towards a target's word distribution: hashed n-gram counts of both, log ratios, Gumbel noise, the best scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelattice.llm.text import packed, text_of
from ridelattice.session import cut_lineage

#: Longest run of words that is a feature, and the number of buckets that features are hashed to.
ORDER, BUCKETS = 1, 10_000
#: Messages with fewer words are not drawn; of the others this many of a hundred are.
MIN_WORDS, PERCENT = 20, 10
SEED = 2024

#: Capitals lower-cased, every ASCII byte but letters and digits a blank; bytes of other characters stay.
_TABLE = bytes(c if c > 127 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, capitals lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def features(text: str, order: int) -> tuple[list[int], int]:
    """CRC-32 of every run of 1 to ``order`` words joined by blanks, repeats included, and the number of words.

    The checksum of a longer run goes on from that of the run without its last word.
    """
    w = words(text)
    seeds = list(map(crc32, w))
    found, follow = seeds, [b" " + x for x in w] if order > 1 else []
    for k in range(1, order):
        seeds = list(map(crc32, follow[k:], seeds))
        found = found + seeds
    return found, len(w)


def _counter(order: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, np.ndarray] = {}
        for b in batches:
            for target, text in zip(b["target"].to_pylist(), b["content"].to_pylist(), strict=True):
                total = sums.setdefault(target, np.zeros(buckets, np.int64))
                seen = Counter(features(text, order)[0])
                np.add.at(total, np.fromiter(seen, np.int64, len(seen)) % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
        for target, total in sums.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([target] * len(hit), pa.bool_()), pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["target", "bucket", "n"])

    return count


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Floored thousandfold log ratio of the target's smoothed share of every bucket to that of the messages."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((raw.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def _weigher(order: int, gains: list[int]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = np.array(gains, np.int64), len(gains)
        for b in batches:
            n, n_words, weight = [], [], []
            for text in b["content"].to_pylist():
                found, size = features(text, order)
                n.append(len(found))
                n_words.append(size)
                weight.append(int(gain[np.array(found, np.int64) % buckets].sum()) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(n_words, pa.int64()), pa.array(weight, pa.int64())], names=["id", "n_features", "n_words", "weight"])

    return weigh


def noise(key: Column, seed: int) -> Column:
    """Floored thousandfold Gumbel draw, from the first 32 bits of the SHA-256 of seed and key; a null key is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for b in batches:
        place = pa.array(np.arange(at + 1, at + 1 + b.num_rows))
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, place], names=[*b.schema.names, "inside"])


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, their place (1, 2, ...) in the whole order; rows that are equal in it are told apart by nothing.

    Rows are dealt to ranges, counted per range and numbered inside; equal keys may fall in several ranges.
    """
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row").withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = dealt.mapInArrow(_number, T.StructType([*dealt.schema, T.StructField("inside", T.LongType())]))
    return inside.join(F.broadcast(starts), "_part").withColumn("rank", F.col("before") + F.col("inside")).drop("_part", "before", "inside")


def resampled_messages(
    messages: DataFrame, targets: DataFrame, order: int = ORDER, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """Which booking messages to draw so that their words resemble those of ``targets``, by importance resampling without replacement.

    ``messages``: rows with ``id`` and ``content``; ``targets``: rows with ``content``, messages of the wanted kind; further columns
    are ignored, whatever their names. One row per message: ``id``, ``n_features``, ``weight`` (floored mean of its features' gains),
    ``score`` (weight and Gumbel noise of ``seed`` and ``id``) and ``rank``: 1, 2, ... for the ``percent`` of a hundred messages of
    ``min_words`` words or more with the highest scores (rounded down; ties to the smaller id), else null. Features are all runs of 1
    to ``order`` words, hashed to ``buckets``; their counts cover both tables whole. Counts per bucket are the only thing that comes to
    the driver, ``buckets`` numbers of each table.

    A null or empty content has no features and weight 0 and is never drawn; a null id has the noise of an empty one and comes
    first among ties; repeated rows count and are drawn each for itself, in no particular order. Empty targets are smoothed
    counts of nothing; an empty table gives no rows.
    """
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content"))
    both = rows.select(F.lit(False).alias("target"), "content").union(packed(targets, "content").select(F.lit(True), text_of(F.col("content"))))
    counts: dict[bool, dict[int, int]] = {False: {}, True: {}}
    for r in both.mapInArrow(_counter(order, buckets), "target boolean, bucket int, n bigint").groupBy("target", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["target"]][r["bucket"]] = r["n"]
    gains = bucket_gains(counts[False], counts[True], buckets)
    weighed = rows.mapInArrow(_weigher(order, gains), f"id {dict(messages.dtypes)['id']}, n_features bigint, n_words bigint, weight bigint")
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = percent * enough.count() // 100
    ranked = numbered(enough, F.desc("score"), F.asc_nulls_first("id")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.union(rest).select("id", "n_features", "weight", "score", "rank")
