"""Message threads of bookings as training conversations: reply trees, ranked branches, one formatted text per chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.llm.text import packed, text_of
from ridelattice.session import cut_lineage

#: The template: a turn is START, role, SAYS, text, END. Every control string begins with a character of ``[<\``.
START, SAYS, END = "<s>", "[SAYS]", "</s>"


def escaped(text: Column) -> Column:
    """The text with a backslash after every ``<``, ``[`` and backslash, so that no control string can stand in it."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given."""
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _same(a: DataFrame, b: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Join within a booking (nulls are one booking) on ``left`` = ``right``; columns of ``b`` replace none of ``a``."""
    b = b.withColumnsRenamed({"booking_id": "_booking", right: "_key"})
    return a.join(b, a["booking_id"].eqNullSafe(b["_booking"]) & (a[left] == b["_key"]), how).drop("_booking", "_key")


def _pointers(far: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Every message with its root, the pointers of each round of doubling, and the messages that never reach a root, if any.

    A round brings at least the messages of the next depths to their roots, so what is open when a round brings none is in a
    loop or answers one.
    """
    jumps, before = [], None
    while n := far.where("above IS NOT NULL").count():
        if n == before:
            return far, jumps, far.where("above IS NOT NULL").select("booking_id", "id")
        before = n
        jumps.append(far.where("above IS NOT NULL").select("booking_id", "id", "above"))
        on = far.select("booking_id", "id", F.col("above").alias("next"), F.col("score").alias("more"), F.col("depth").alias("deeper"), F.col("root").alias("top"))
        # only pointers that have not reached their root are joined
        moved = _same(far.where("above IS NOT NULL"), on, "above", "id").select(
            "booking_id", "id", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("deeper")).alias("depth"), F.col("top").alias("root"))
        far = cut_lineage(far.where("above IS NULL").union(moved))
    return far, jumps, None


def _loop_starts(edges: DataFrame) -> DataFrame:
    """``booking_id`` and ``id`` of the smallest message on every loop. ``edges``: messages that are in a loop or answer one.

    After as many steps as a booking has messages every pointer stands on a loop, and the smallest id on the way is known.
    """
    size = edges.groupBy("booking_id").count().agg(F.max("count")).first()[0]
    far = cut_lineage(edges.select("booking_id", "id", "above", F.col("id").alias("low")))
    for _ in range((size - 1).bit_length()):
        on = far.select("booking_id", "id", F.col("above").alias("next"), F.col("low").alias("lower"))
        far = cut_lineage(_same(far, on, "above", "id").select("booking_id", "id", F.col("next").alias("above"), F.least("low", "lower").alias("low")))
    return _same(far.where("id = low"), far.select("booking_id", "above").distinct(), "id", "above").select("booking_id", "id")


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of the reply trees: ``booking_id``, ``root``, ``leaf``, ``rank``, ``score``, ``position``, ``id``.

    ``messages``: ``booking_id``, ``id`` (unique in a booking), ``reply_to``, ``rating``. Ids need no order.
    A message whose ``reply_to`` is null, its own id, or not in the booking begins a tree; where replies form a loop, the message
    with the smallest id on the loop does. A path's score is the sum of
    its ratings (null: 0); paths of a tree are ranked by score, then by leaf, and the first ``branches`` are taken, or all.

    Self-joins double the reach of every message's pointer to an ancestor, so a tree of depth d takes log d rounds and
    no message carries its path. Chosen paths are then unrolled from their leaves through the pointers of all rounds.
    """
    nodes = packed(messages, "booking_id", "id", "reply_to", "rating").select("booking_id", "id", F.when(F.col("reply_to") != F.col("id"), F.col("reply_to")).alias("reply_to"), F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("score"))
    there = nodes.select("booking_id", "id", F.col("id").alias("above"))
    nodes = _same(nodes, there, "reply_to", "id", "left")
    start = cut_lineage(nodes.select("booking_id", "id", "above", "score", F.lit(1).cast("long").alias("depth"), F.coalesce("above", "id").alias("root")))
    far, jumps, loops = _pointers(start)
    if loops is not None:
        begins = _loop_starts(_same(start, loops, "id", "id").select("booking_id", "id", "above")).withColumn("begins", F.lit(True))
        kept = F.col("begins").isNull()
        start = cut_lineage(_same(start, begins, "id", "id", "left").select(
            "booking_id", "id", F.when(kept, F.col("above")).alias("above"), "score", "depth", F.when(kept, F.col("root")).otherwise(F.col("id")).alias("root")))
        far, jumps, _ = _pointers(start)
    parents = jumps[0].select("booking_id", F.col("above").alias("parent")).distinct().withColumn("p", F.lit(True)) if jumps else None
    leaves = far if parents is None else _same(far, parents, "id", "parent", "left").where("p IS NULL")
    by = Window.partitionBy("booking_id", "root").orderBy(F.col("score").desc(), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(by))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)
    paths = cut_lineage(leaves.select("booking_id", "root", F.col("id").alias("leaf"), "rank", "score", F.col("depth").alias("position"), "id"))
    for k, jump in enumerate(jumps):
        # ids only, written every round: a plan that keeps its union would double with each of them
        up = _same(paths, jump, "id", "id").select("booking_id", "root", "leaf", "rank", "score", (F.col("position") - (1 << k)).alias("position"), F.col("above").alias("id"))
        paths = cut_lineage(paths.union(up))
    return paths


def _formatted(turns: Column) -> list[Column]:
    """Text and loss mask of an array of turns in order."""
    head = lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(SAYS))
    text = F.array_join(F.transform(turns, lambda t: F.concat(head(t), escaped(t["content"]), F.lit(END))), "")
    sizes = F.transform(turns, lambda t: F.struct(
        F.length(head(t)).alias("head"), F.length(escaped(t["content"])).alias("body"), (t["role"] == "assistant").alias("loss")))
    at = lambda a: a["at"]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, s: F.struct(
        (at(a) + s["head"] + s["body"] + len(END)).alias("at"),
        F.when(s["loss"], F.concat(a["spans"], F.array(F.struct((at(a) + s["head"]).alias("start"), (at(a) + s["head"] + s["body"]).alias("end"))))).otherwise(a["spans"]).alias("spans"))
    return [text.alias("formatted"), F.aggregate(sizes, zero, step, lambda a: a["spans"]).alias("loss")]


def format_threads(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One training conversation per chosen path of a booking's reply trees.

    ``messages``: ``booking_id``, ``id``, ``reply_to`` (the message it answers; the project's messages are chains, where it is the one
    before), ``sender_role``, ``content`` and ``rating``; further columns are ignored, whatever their names. One row per
    path: ``booking_id``, ``root``, ``leaf``, ``rank``, ``score``, ``formatted`` and ``loss``, the code point spans (``start``,
    ``end`` exclusive) of the assistant's texts in it. Paths and ranks are those of :func:`reply_paths`; ``branches`` per
    tree are taken, all if it is None. Control strings inside texts and roles are escaped and read back unchanged.

    A null content or role is empty, a null ``booking_id`` is a booking of its own. A message with a null ``id`` cannot be
    answered and is a conversation alone (null ``root`` and ``leaf``). Rows with equal ``booking_id`` and ``id`` are one message: the
    smallest by reply, role, content and rating. An empty table gives no rows. A conversation is one row, in one task.
    """
    rows = packed(messages, "booking_id", "id", "reply_to", "sender_role", "content", "rating").select(
        "booking_id", "id", F.struct("reply_to", text_of(F.col("sender_role")).alias("role"), text_of(F.col("content")).alias("content"), "rating").alias("m"))
    known = rows.where(F.col("id").isNotNull()).groupBy("booking_id", "id").agg(F.min("m").alias("m")).select("booking_id", "id", "m.*")
    paths = reply_paths(known, branches)
    said = known.select("booking_id", "id", "role", "content")
    turns = F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("turns")
    whole = _same(paths, said, "id", "id").groupBy("booking_id", "root", "leaf", "rank", "score").agg(turns)
    none = F.lit(None).cast(dict(messages.dtypes)["id"])
    alone = rows.where(F.col("id").isNull()).select(
        "booking_id", none.alias("root"), none.alias("leaf"), F.lit(1).alias("rank"), F.coalesce(F.col("m.rating").cast("double"), F.lit(0.0)).alias("score"),
        F.array(F.struct(F.lit(1).cast("long").alias("position"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))).alias("turns"))
    return whole.union(alone).select("booking_id", "root", "leaf", "rank", "score", *_formatted(F.col("turns")))


def read_back(formatted: Column) -> Column:
    """The turns (``role``, ``content``) of a formatted conversation, unescaped."""
    parts = F.slice(F.split(formatted, F.lit(END)), 1, F.size(F.split(formatted, F.lit(END))) - 1)
    role = lambda x: F.substring_index(x, SAYS, 1)
    return F.transform(parts, lambda x: F.struct(
        unescaped(F.substr(role(x), F.lit(len(START) + 1))).alias("role"), unescaped(F.substr(x, F.length(role(x)) + len(SAYS) + 1)).alias("content")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
