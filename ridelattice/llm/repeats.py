"""Repeated passages across messages: lines and sentences are hashed, the earliest occurrence stays, the rest goes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelattice.llm.text import carried, packed, restored, text_of
from ridelattice.session import cut_lineage

#: A run of repeated units goes when it has this many words together; single short phrases and licence lines stay.
MIN_WORDS = 20
#: A longer word is unspaced text, and counts as one word for each UNSPACED of its code points.
LONG_WORD, UNSPACED = 30, 6
#: Occurrences of a unit that are joined together, and units that are salted at most, the most frequent first (bounds the broadcast).
HOT, SALTED = 10_000, 1 << 16
#: What tells one text from another: rows that share an id, or have none, may differ.
KEY = ["id", "hash"]
#: A unit ends after a line feed, and inside a line after a sentence's full stop.
_CUT = re.compile(r"(?<=\n)|(?<=[.!?])(?=[ \t])")


def units(text: str) -> list[str]:
    """The text in units, whose concatenation it is."""
    return [u for u in _CUT.split(text) if u]


def _normal(unit: str) -> list[str]:
    """Words of a unit, in lower case; white space does not count."""
    return unit.lower().split()


def _size(words: list[str]) -> int:
    """Number of words, where long ones count by their length."""
    return sum(len(w) // UNSPACED if len(w) > LONG_WORD else 1 for w in words)


def _digest(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "replace")).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, pos, digest = [], [], []
        for k, text in enumerate(b["content"].to_pylist()):
            for i, u in enumerate(units(text)):
                if w := _normal(u):
                    at.append(k)
                    pos.append(i)
                    digest.append(_digest(w))
            if len(at) > 200_000 or (at and k + 1 == b.num_rows):
                of = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([b["id"].take(of), b["hash"].take(of), pa.array(pos, pa.int32()), pa.array(digest, pa.binary())], names=[*KEY, "pos", "digest"])
                at, pos, digest = [], [], []


def _removed(text: str, again: set[bytes], min_words: int) -> list[tuple[int, int]]:
    """Code point spans of the runs that go. A unit without words joins the run that it stands in."""
    spans, start, n_words, offset, end = [], None, 0, 0, 0
    for i, u in enumerate(units(text)):
        w = _normal(u)
        if w and i.to_bytes(4, "big") + _digest(w) in again:
            start = offset if start is None else start
            n_words += _size(w)
            end = offset + len(u)
        elif w and start is not None:
            if n_words >= min_words:
                spans.append((start, end))
            start, n_words = None, 0
        offset += len(u)
    if start is not None and n_words >= min_words:
        spans.append((start, end))
    # a passage that begins inside a line leaves that line its end
    return [(s, e - 1) if s and text[s - 1] != "\n" and text[e - 1] == "\n" else (s, e) for s, e in spans]


def _cleaner(min_words: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = b["content"].to_pylist(), []
            for k, again in enumerate(b["again"].to_pylist()):
                spans = _removed(texts[k], set(again), min_words) if again else []
                gone.append([{"start": s, "length": e - s} for s, e in spans])
                for s, e in reversed(spans):
                    texts[k] = texts[k][:s] + texts[k][e:]
            removed = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b["rest"], b["id"], pa.array(texts, pa.string()), removed], names=["rest", "id", "content", "removed"])

    return clean


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


def repeated_units(messages: DataFrame) -> DataFrame:
    """``id``, ``hash`` (XXH64 of the text) and ``again``, the units of a text that occur earlier, in it or in another one: a unit's
    place in four bytes, then its digest.

    Earlier means a smaller (``id``, ``hash``, place); a null id comes first. Digests are counted with a map-side combined
    minimum, and only those found twice are joined back; one found more than HOT times is joined in as many salts as it takes, so
    a unit in a third of all messages is spread over tasks. Equal
    rows have one set of units, which is never larger than their text has.
    """
    rows = packed(messages, "id", "content").select("id", text_of(F.col("content")).alias("content")).withColumn("hash", F.xxhash64("content"))
    found = rows.mapInArrow(_digests, f"id {dict(messages.dtypes)['id']}, hash bigint, pos int, digest binary")
    first = cut_lineage(found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "pos")).alias("first")).where("n > 1").withColumn("salts", F.ceil(F.col("n") / HOT).cast("int")))
    hot = F.broadcast(first.where("salts > 1").orderBy(F.desc("n")).limit(SALTED).select("digest", "salts"))
    salted = found.join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64(*KEY, "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    ranked = first.select("digest", "first").join(hot, "digest", "left").select("digest", "first", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    again = salted.join(ranked, ["digest", "salt"]).where(~F.struct(*KEY, "pos").eqNullSafe(F.col("first")))
    unit = F.concat(F.unhex(F.lpad(F.hex("pos"), 8, "0")), "digest")
    return again.groupBy(*KEY).agg(F.collect_set(unit).alias("again"))


def _cleaned(messages: DataFrame, min_words: int) -> DataFrame:
    rows = carried(messages).withColumn("hash", F.xxhash64("content"))
    again = repeated_units(messages).withColumnsRenamed({"id": "of", "hash": "text"})
    joined = rows.join(again, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("text")), "left").select("rest", "id", "content", "again")
    return joined.mapInArrow(_cleaner(min_words), T.StructType([*joined.drop("again").schema, T.StructField("removed", SPANS)]))


def without_repeats(messages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Booking messages without passages that an earlier message, or an earlier place of the same one, has already.

    ``messages``: rows with ``id`` and ``content``; further columns are ignored, whatever their names. One row per input
    row: ``id``, ``content`` (what stays) and ``removed`` (``start`` and ``length`` of every passage taken out, in code
    points of the original). Units are lines, cut at sentence ends, compared in lower case with white space normalised;
    the occurrence with the smallest (``id``, XXH64 of the text, place) stays. A unit that occurs earlier goes if the run of such units around
    it has ``min_words`` words or more, where a word of more than 30 code points (unspaced text) counts as one for each six.

    A null content is empty and loses nothing; a null id ranks before all others. Rows with equal id and text
    keep the same text; different texts under one id, or without an id, are ranked by their hash. A text may become empty, its row stays. An empty table gives no rows.
    """
    return _cleaned(messages, min_words).select("id", "content", "removed")


def drop_repeats(messages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``messages`` with all their columns, ``content`` as :func:`without_repeats` leaves it."""
    return restored(_cleaned(messages, min_words), messages)
