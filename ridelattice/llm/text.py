"""Expressions and row helpers that the text operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts are runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: The two alphabets of ASCII lower-casing.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(content: Column) -> Column:
    """The text itself; a null counts as empty."""
    return F.coalesce(content.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def pinned(c: Column) -> Column:
    """The same value, which the optimiser will neither copy into filters nor merge into lambdas above it.

    Without this a filter on a result is pushed down with the whole expression inlined, and a lambda that reads an
    array evaluates the expression behind that array once per element.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def window_hashes(h: Column, k: int) -> Column:
    """A 64-bit hash of every run of ``k`` entries of an array of longs; empty when there are fewer."""
    at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
    none = F.array().cast("array<bigint>")
    return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), at)).otherwise(none)


_LANES = (1 << 32) | 1


def votes(x: Column) -> list[Column]:
    """Sums over a group that count the set bits of a long: 32 longs of two 32-bit lanes, for bits j and j + 32."""
    return [F.sum(F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_LANES))).alias(f"v{j}") for j in range(32)]


def majority(n: Column) -> Column:
    """Long whose bit is 1 where more than half of ``n`` votes (columns of :func:`votes`) set it; 0 where there are none."""
    def bit(j: int) -> Column:
        lane = F.col(f"v{j % 32}")
        count = F.shiftrightunsigned(lane, 32) if j >= 32 else lane.bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(j) for j in range(64)])


def hex64(x: Column) -> Column:
    """16 lower-case hex digits of a long, unsigned."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The row as one struct ``row`` beside the named columns, so that added columns never clash with it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`").alias(c) for c in names])


def unpacked(df: DataFrame) -> DataFrame:
    """The rows that :func:`packed` wrapped."""
    return df.select("row.*")


def carried(df: DataFrame) -> DataFrame:
    """``id`` and ``content`` (null as empty) beside the struct ``rest`` of all other columns."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("id", "content")] or [F.lit(0).alias("none")]
    return df.select(F.struct(*rest).alias("rest"), "id", text_of(F.col("content")).alias("content"))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order, from a frame that :func:`carried` wrapped."""
    return df.select(*[F.col(c) if c in ("id", "content") else F.col(f"rest.`{c}`") for c in like.columns])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
