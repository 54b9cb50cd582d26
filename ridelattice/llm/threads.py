"""Booking messages as threads: what the chat operators take, derived from the project's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.llm.text import packed


def booking_threads(messages: DataFrame, bookings: DataFrame, ratings: DataFrame) -> DataFrame:
    """``booking_id``, ``id``, ``turn``, ``reply_to``, ``sender_role``, ``content`` and ``rating`` of every message.

    ``messages``: id, booking_id, sender_id, content, is_automated, created_at; ``bookings``: booking_id, rider_id, driver_id;
    ``ratings``: booking_id, stars; further columns are ignored, whatever their names. Roles: ``system`` for automated messages,
    ``user`` for the booking's rider, ``assistant`` for its driver, else ``other``. ``turn`` counts a booking's messages from 1 by
    created_at (nulls first), then id; ``reply_to`` is the message before; ``rating`` the mean of the booking's stars.

    A null content stays null. Messages of a null or unknown booking have role ``other`` unless automated, and no rating; those of a
    null booking are one thread. Of repeated bookings the smallest rider and driver count; repeated messages have turns of their
    own. Empty tables give no rows or no roles. A thread is numbered in one task, its texts spill.
    """
    who = packed(bookings, "booking_id", "rider_id", "driver_id").where(F.col("booking_id").isNotNull()).groupBy(F.col("booking_id").alias("_of")).agg(F.min("rider_id").alias("rider"), F.min("driver_id").alias("driver"))
    stars = packed(ratings, "booking_id", "stars").groupBy(F.col("booking_id").alias("_rated")).agg(F.avg("stars").alias("rating"))
    rows = packed(messages, "id", "booking_id", "sender_id", "content", "is_automated", "created_at").drop("row")
    rows = rows.join(who, rows["booking_id"] == F.col("_of"), "left").join(stars, rows["booking_id"] == F.col("_rated"), "left")
    sender = F.col("sender_id").cast("string")
    role = F.when(F.coalesce(F.col("is_automated").cast("boolean"), F.lit(False)), "system").when(sender == F.col("rider").cast("string"), "user").when(sender == F.col("driver").cast("string"), "assistant").otherwise("other")
    by = Window.partitionBy("booking_id").orderBy(F.col("created_at").asc_nulls_first(), F.col("id").asc_nulls_first())
    return rows.select("booking_id", "id", F.row_number().over(by).cast("bigint").alias("turn"), F.lag("id").over(by).alias("reply_to"), role.alias("sender_role"), "content", "rating")
