"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    turned = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(turned).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to its smallest neighbour, or to itself where it is smaller."""
    both = _both(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = low.select("u", F.col("m").alias("v"))
    rest = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node of the undirected edges (``u``, ``v``).

    Each round is two star operations, each a map-side combined minimum and a join, so a node of any degree is spread
    over tasks; rounds go on until the edges no longer change. Edges from a node to itself and repeated edges count once;
    an empty table gives no rows.
    """
    down = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut_lineage(edges.where("u <> v").select(down.alias("e")).select("e.*").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
