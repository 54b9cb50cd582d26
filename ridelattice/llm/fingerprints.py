"""SimHash fingerprints of message texts, and the search for all of them within a Hamming radius."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.llm.text import majority, packed, pinned, text_of, votes, window_hashes, words
from ridelattice.session import cut_lineage

#: Words in a term.
SHINGLE = 5
RADIUS = 3


def term_hashes(text: Column) -> Column:
    """64-bit hashes of the five-word terms of a text; a shorter text is one term, a text without words has none.

    A term counts as often as it occurs, which is its weight in the vote.
    """
    one = F.array(F.xxhash64(F.array_join("w", " ")))
    return F.when(F.size("w") >= SHINGLE, window_hashes(F.col("wh"), SHINGLE)).when(F.size("w") > 0, one).otherwise(F.array().cast("array<bigint>"))


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint (long) of ``text`` per group of equal keys, which must tell rows apart.

    Every term votes for or against each of 64 bits; the votes are sums of a hash aggregate, combined before the shuffle.
    """
    rows = rows.withColumn("w", words(pinned(F.col(text)))).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    # explode_outer: the plain form would infer a filter on the array and evaluate all of it twice
    x = rows.withColumn("h", term_hashes(F.col(text))).select(*keys, F.explode_outer("h").alias("h"))
    return x.groupBy(*keys).agg(F.count("h").alias("n_terms"), *votes(F.col("h"))).select(
        *keys, F.when(F.col("n_terms") > 0, majority(F.col("n_terms"))).otherwise(F.lit(0).cast("long")).alias("fingerprint"))


def message_fingerprints(messages: DataFrame) -> DataFrame:
    """The 64-bit SimHash of every booking message.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. One row per input
    row: ``id`` and ``fingerprint`` (long). Equal texts get equal fingerprints. A null, empty or wordless ``content`` has
    fingerprint 0; a null ``id`` stays null; repeated rows come out as often as they went in; no rows give no rows.
    """
    rows = packed(messages, "id", "content").select(F.monotonically_increasing_id().alias("rid"), "id", text_of(F.col("content")).alias("content"))
    return fingerprint_rows(rows, ["rid", "id"], "content").drop("rid")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def _blocks(n: int) -> list[int]:
    """Masks (signed longs) of ``n`` nearly equal blocks of 64 bits, from the lowest."""
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of different fingerprints at most ``radius`` bits apart, each once, as ``fingerprint_a`` < ``fingerprint_b``.

    ``fingerprints``: rows with ``fingerprint`` (long). Equal values are one; nulls are left out; an empty table gives no
    pairs. Bits are cut into radius + 2 blocks, and one permuted table is kept for every choice of two blocks: two
    fingerprints within the radius agree on at least two whole blocks, so they meet in a table under an equal key of
    some 128 / (radius + 2) bits. A pair is taken from the table of its two lowest equal blocks only.
    """
    masks = _blocks(radius + 2)
    chosen = list(combinations(range(len(masks)), 2))
    tables = [F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(masks[i] | masks[j])).alias("key")) for t, (i, j) in enumerate(chosen)]
    classes = packed(fingerprints, "fingerprint").select(F.col("fingerprint").alias("fp")).where("fp IS NOT NULL").distinct()
    rows = classes.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.table", "t.key")
    a, b = rows.alias("a"), rows.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # blocks below the table's upper one, other than its lower one, that agree too
    lower = [(F.col("a.table") == t) & (diff.bitwiseAND(F.lit(masks[k])) == 0) for t, (i, j) in enumerate(chosen) for k in range(j) if k != i]
    first = ~reduce(lambda x, y: x | y, lower, F.lit(False))
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= radius) & first
    met = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key"))
    return a.join(b, met & near).select(F.col("a.fp").alias("fingerprint_a"), F.col("b.fp").alias("fingerprint_b"))


def next_messages(messages: DataFrame) -> DataFrame:
    """``id``, ``n_chars``, ``next_id``: each message id's successor in ascending order; the last one's is the first.

    Ids are range-partitioned once (and kept, so that later reads see the same partitions); successors are found inside
    partitions, and across their edges from one row per partition. Null ids have no successor and are none's.
    """
    ids = packed(messages, "id", "content").where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.length(text_of(F.col("content")))).cast("long").alias("n_chars"))
    part = cut_lineage(ids.repartitionByRange("id").select("id", "n_chars", F.spark_partition_id().alias("part")))
    edges = part.groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    w = Window.orderBy("part")  # one row per partition
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(F.col("high").alias("id"), F.coalesce(F.lead("low").over(w), F.first("low").over(whole)).alias("after"))
    inside = part.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return inside.join(edges, "id", "left").select("id", "n_chars", F.coalesce("next_id", "after").alias("next_id"))


def spliced_messages(messages: DataFrame) -> DataFrame:
    """``id``, ``next_id``, ``content`` and ``edited``: the last quarter of every content gives way to the next one's opening.

    As many code points come in as go out, or all of the next message where it is shorter. Where several rows share the
    next id, the smallest opening is taken. A null content is empty; a row with a null id only loses its last quarter.
    """
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content"))
    after = next_messages(messages)
    before = after.select(F.col("next_id").alias("id"), F.col("id").alias("prev_id"), F.floor(F.col("n_chars") / 4).cast("int").alias("need"))
    links = after.select("id", "next_id").join(before, "id", "full")
    # both uses read one shuffle of the texts: pinned, so that neither gets a filter of its own
    opening = rows.join(links, "id", "left").select(pinned(F.col("prev_id")).alias("id"), F.expr("substring(content, 1, need)").alias("opening"))
    opening = opening.groupBy("id").agg(F.min("opening").alias("opening"))
    rows = rows.join(links.select("id", "next_id"), "id", "left").join(opening, "id", "left").withColumn("cut", F.floor(F.length("content") / 4).cast("int"))
    edited = F.concat(F.expr("substring(content, 1, length(content) - cut)"), F.expr("substring(coalesce(opening, ''), 1, cut)"))
    return rows.select("id", "next_id", "content", edited.alias("edited"))
