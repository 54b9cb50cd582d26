"""Near-duplicate messages by SimHash, linked through deletion-variant signatures of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.llm.components import components
from ridelattice.llm.text import packed, text_of
from ridelattice.session import cut_lineage

#: Words in a shingle, seed of the hash, and the most bits by which linked fingerprints differ.
SHINGLE, SEED, RADIUS = 4, 42, 4
_CHUNK = 1 << 16


def simhash(text: str) -> int:
    """64-bit SimHash: a bit is set where more than half of the shingle hashes set it; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    n = len(words) - SHINGLE + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    digest, set_ = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + SHINGLE - 1 : to + SHINGLE - 1], strict=True)], np.uint64)
        set_ += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([simhash(x) for x in b["content"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp)], names=["id", "fingerprint"])


def message_simhashes(messages: DataFrame) -> DataFrame:
    """``id`` and ``fingerprint`` (long) of every row of ``messages``; a null content is empty."""
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content"))
    kind = dict(messages.dtypes)["id"]
    return rows.mapInArrow(_fingerprints, f"id {kind}, fingerprint bigint")


def _segments(radius: int) -> list[tuple[int, int]]:
    """Bit ranges of the fewest segments of which one differs by at most one bit: more than half the radius."""
    m = radius // 2 + 1
    return [(64 * i // m, 64 * (i + 1) // m) for i in range(m)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``u`` < ``v`` of different fingerprints that differ in at most ``radius`` bits, each pair once.

    The 64 bits are cut into radius // 2 + 1 segments, so one of them differs by at most one bit. Each fingerprint is
    indexed under 64 signatures: for every bit, its segment with that bit left out. Two segments that differ by at most
    one bit share a signature, so an equality join finds every pair, and the exact distance is part of the join. A pair
    is taken under its first shared signature only. Equal values are one fingerprint; nulls are left out.

    Both sides are always shuffled: Spark takes the signatures for as large as the fingerprints that they are exploded from,
    a 64th of their size, and would send them to every executor through the driver.
    """
    signatures, spans = [], _segments(radius)
    for s, (a, b) in enumerate(spans):
        segment = ((1 << b) - 1) ^ ((1 << a) - 1)
        for p in range(a, b):
            rest = F.shiftrightunsigned(F.col("fingerprint").bitwiseAND(F.lit(_signed(segment & ~(1 << p)))), a)
            signatures.append(F.struct(F.lit(p).alias("bit"), F.lit(s).alias("segment"), rest.cast("int").alias("rest")))
    classes = packed(fingerprints, "fingerprint").select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    rows = classes.select("fingerprint", F.explode(F.array(*signatures)).alias("s")).select("fingerprint", "s.*")
    a = rows.select(F.col("fingerprint").alias("u"), "bit", "segment", "rest")
    b = rows.select(F.col("fingerprint").alias("v"), F.col("bit").alias("bit_v"), F.col("rest").alias("rest_v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius) & _first_shared(spans)
    return a.hint("merge").join(b.hint("merge"), (F.col("bit") == F.col("bit_v")) & (F.col("rest") == F.col("rest_v")) & near).select("u", "v")


def _first_shared(spans: list[tuple[int, int]]) -> Column:
    """Whether no signature before this one is shared: earlier segments differ twice, and this one in the bit left out or nowhere."""
    diff, taken, earlier = F.col("u").bitwiseXOR(F.col("v")), F.lit(False), F.lit(True)
    for s, (a, b) in enumerate(spans):
        here = diff.bitwiseAND(F.lit(_signed(((1 << b) - 1) ^ ((1 << a) - 1))))
        lowest = (here != 0) | (F.col("bit") == a)  # a shared signature leaves no other bit to differ
        taken = taken | ((F.col("segment") == s) & lowest & earlier)
        earlier = earlier & (F.bit_count(here) >= 2)
    return taken


def near_groups(messages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Near-duplicate group of every booking message: ``id``, ``fingerprint`` (long), ``component_id``, ``n_links``.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. Messages link when
    their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id reachable over links, its own
    included; ``n_links`` counts the other fingerprints that its fingerprint links to. Copies share a fingerprint and are
    never paired: links run between distinct fingerprints.

    A null, empty or wordless content has fingerprint 0 and is linked like any other. A null id takes part with its text,
    but no group is named after it (a group of null ids only has a null ``component_id``). Repeated rows come out as often
    as they went in; an empty table gives no rows.
    """
    rows = cut_lineage(message_simhashes(messages))
    classes = cut_lineage(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    links = cut_lineage(near_links(classes, radius))
    roots = components(links).withColumnRenamed("node", "fingerprint")
    degree = links.select(F.explode(F.array("u", "v")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    of = classes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    # both are written, so that the joins read plain shuffles on either side, of which Spark splits a large group's
    named = cut_lineage(of.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of = cut_lineage(of.join(named, "root").join(degree, "fingerprint", "left").select("fingerprint", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return rows.join(of, "fingerprint").select("id", "fingerprint", "component_id", "n_links")


def one_of_each(messages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``messages`` that stay when one of each near-duplicate group does: the one with the smallest id.

    All columns stay as they are. Of repeated rows with that id one stays. Rows with a null id cannot be named and all stay.
    """
    stay = near_groups(messages, radius).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("stay")).distinct()
    rows = packed(messages, "id")
    kept = rows.join(stay, rows["id"] == stay["stay"])
    # the join has put equal ids together and in order; only repeated rows share one
    first = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    named = kept.where(F.col("id").isNotNull()).withColumn("copy", first).where("copy = 1").select("row.*")
    return named.union(rows.where(F.col("id").isNull()).select("row.*"))
