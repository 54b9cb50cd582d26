"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelattice.llm.text import packed, pinned, text_of, unpacked, window_hashes, words

# Frequent words of the four languages of the messages.
STOP_WORDS = (
    "the of and to in a is that it for with on this was are be by or an from as at "
    "der die das und ist nicht von mit den ein eine zu sich auf für im dem des "
    "le la les de et un une est que qui dans pour en du au sur pas "
    "el los las y con del se no es al lo por").split()


class Rule(NamedTuple):
    """A message fails when ``metric`` lies outside [low, high]; it is asked only from ``min_words`` words on."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 1


#: The threshold table. Ratios are per word, per line or per code point as their names say.
RULES = (
    Rule("too_short", "n_words", 10, None, 0),
    Rule("word_length", "mean_word_chars", 2.0, 15.0, 10),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None, 100),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5, 10),
    Rule("repeated_words", "repeat_word_ratio", None, 0.2),
)
WINDOW = 5


def _covered(marks: Column) -> Column:
    """Words that windows starting at the given ascending positions cover, each once."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
    return F.aggregate(marks, zero, step, lambda a: a["n"])


def _measured(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds counts, ratios and the verdict to a frame with ``content``; three projections, no shuffle, no user function."""
    text = text_of(F.col("content"))
    df = df.withColumn("content", pinned(text)).withColumn("w", words(F.col("content")))
    lines = F.filter(F.split("content", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.lower(F.array_join("w", "\n"))
    df = df.withColumns({
        "lines": lines, "hashes": F.transform("w", lambda x: F.xxhash64(x)),
        "n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count("content", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_stop": F.size(F.filter(F.split(bare, "\n"), lambda x: x.isin(STOP_WORDS))).cast("long")})
    df = df.withColumn("win", window_hashes(F.col("hashes"), WINDOW)).withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    # only messages that repeat a window sort theirs
    sorted_ = F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn("runs", F.when(F.size("win") > F.size(F.array_distinct("win")), sorted_))
    again = lambda x, i: (F.get("runs", i - 1)["h"] == x["h"]) | (F.get("runs", i + 1)["h"] == x["h"])
    marks = F.array_sort(F.transform(F.filter("runs", again), lambda x: x["p"]))
    df = df.withColumn("n_repeat_words", F.coalesce(_covered(marks), F.lit(0)).cast("long"))
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    df = df.withColumns({
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_word_ratio": per("n_repeat_words", "n_words")})
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(_fails(r), r.name) for r in rules]), lambda x: x.isNotNull())
    return df.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", pinned(~F.col("base_failed") & (F.size("failed_rules") == 0)))


def _fails(r: Rule) -> Column:
    m = F.col(r.metric)
    bounds = ([m < r.low] if r.low is not None else []) + ([m > r.high] if r.high is not None else [])
    return (F.col("n_words") >= r.min_words) & reduce(lambda a, b: a | b, bounds, F.lit(False))


def message_quality(messages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios and verdict of every booking message.

    ``messages``: rows with ``id`` and ``content`` (further columns are ignored, whatever their names). One row per
    input row: ``id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words inside
    five-word windows found twice or more), ``n_stop``, the ratios, ``failed_rules``, ``base_failed``, ``kept``.

    A null or empty ``content`` has no words: every count is 0, every ratio 0.0, and it fails on length. Repeated rows
    are judged alone, each like the other; a null ``id`` stays null; an empty table gives no rows. A value on a bound
    passes. A text is one row and is held by one task.
    """
    df = _measured(packed(messages, "id", "content").drop("row"), rules)
    return df.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop", "mean_word_chars",
        "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_word_ratio", "failed_rules")


def good_messages(messages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``messages`` that pass, unchanged and with all their columns; see :func:`message_quality`."""
    return unpacked(_measured(packed(messages, "content"), rules).where("kept"))
