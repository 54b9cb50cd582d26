"""Marketplace jobs: bookings, promos, ratings, wallets, pools, receipts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelattice.functions.money import MONEY, money
from ridelattice.operators.running import running_row_number, running_sum

# Fixed values
POOL_SIZE = 4
POOL_DISCOUNT_PCT = 15.0
NO_RATING_AVERAGE = 5.0
FUNNEL = ("REQUESTED", "ASSIGNED", "ARRIVING", "IN_PROGRESS", "COMPLETED", "CANCELLED")


def check_promos(bookings: DataFrame, promos: DataFrame, amount: Column, dates: bool = False) -> DataFrame:
    """Outcome of a promo code per booking: message, discount, final amount.

    The use limit is not decided here because it depends on earlier bookings;
    :func:`apply_promos` does that. ``dates=True`` also checks validity dates.
    """
    p = promos.select(*[F.col(c).alias(f"p_{c}") for c in promos.columns])
    # the promo list is a small reference table: AQE broadcasts it when it measures small
    j = bookings.withColumn("amount", amount).filter(F.col("promo_code").isNotNull()).join(p, F.col("promo_code") == F.col("p_code"), "left")
    c = F.col
    reason = (
        F.when(c("p_code").isNull(), "unknown")
        .when(~c("p_is_active"), "inactive")
        .when(c("amount") < c("p_min_amount"), "below minimum")
    )
    if dates:
        reason = reason.when((c("created_at") < c("p_valid_from")) | (c("created_at") > c("p_valid_until")), "out of date")
    raw = money(c("amount") * c("p_discount_value") / F.lit(Decimal("100")))
    off = F.when(c("p_discount_type") == "FLAT", F.least(c("p_discount_value"), c("amount"))).otherwise(F.least(raw, c("p_max_discount")))
    discount = F.when(reason.isNull(), money(off)).otherwise(F.lit(Decimal("0"))).cast(MONEY)
    return j.withColumns({"reason": F.coalesce(reason, F.lit("ok")), "discount": discount}).withColumn(
        "final_amount", F.greatest(c("amount") - c("discount"), F.lit(Decimal("0"))).cast(MONEY))


def apply_promos(checked: DataFrame) -> DataFrame:
    """First code per booking, in time order, until the code's use limit.

    A popular code may cover a large part of all bookings, so its running count
    is built from day totals.
    """
    once = Window.partitionBy("booking_id").orderBy("created_at", "promo_code")
    valid = checked.filter(F.col("reason") == "ok").withColumn("_first", F.row_number().over(once)).filter("_first = 1").drop("_first")
    used = running_row_number(valid, ["promo_code"], F.to_date("created_at"), ["created_at", "booking_id"], "use_no")
    return used.filter(F.col("use_no") <= F.col("p_max_uses"))


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """One rating per (booking, rater, ratee): the highest sequence number wins, then the higher stars."""
    keys = ["booking_id", "rater_id", "ratee_id"]
    last = F.max_by(F.struct(*[c for c in ratings.columns if c not in keys]), F.struct("seq", "stars"))
    return ratings.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def driver_ratings(drivers: DataFrame, ratings: DataFrame) -> DataFrame:
    """Average with one decimal (5.0 when unrated), count, and star histogram."""
    agg = latest_ratings(ratings).groupBy(F.col("ratee_id").alias("driver_id")).agg(
        F.round(F.avg("stars"), 1).alias("avg_rating"),
        F.count(F.lit(1)).alias("reviews"),
        *[F.count_if(F.col("stars") == s).alias(f"stars_{s}") for s in range(1, 6)],
    )
    out = drivers.select("driver_id").join(agg, "driver_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["reviews", *[f"stars_{s}" for s in range(1, 6)]]}
    return out.withColumns({"avg_rating": F.coalesce("avg_rating", F.lit(NO_RATING_AVERAGE)), **zero})


def newest(df: DataFrame, key: str, order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """Newest n rows per key (window group limit keeps n per task before the shuffle)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(out) <= n)


def wallet_ledger(tx: DataFrame) -> DataFrame:
    """Running balance, credited and debited per user, and an overdraft flag."""
    credit = F.when(F.col("type") == "CREDIT", F.col("amount")).otherwise(F.lit(Decimal("0")))
    debit = F.when(F.col("type") == "DEBIT", F.col("amount")).otherwise(F.lit(Decimal("0")))
    out = running_sum(tx, ["user_id"], F.to_date("ts"), ["ts", "tx_id"], {"credited": credit, "debited": debit})
    return out.withColumn("balance", F.col("credited") - F.col("debited")).withColumn("overdraft", F.col("balance") < 0)


def route_pools(requests: DataFrame, hash_col: str, order_s: str, id_col: str, bucket_s: int = 300) -> DataFrame:
    """Members of route pools: oldest open pool with room, else a new pool."""
    rn = running_row_number(requests, [hash_col], F.floor(F.col(order_s) / bucket_s), [order_s, id_col])
    seat = F.pmod(F.col("rn") - 1, F.lit(POOL_SIZE))
    return rn.withColumns({
        "pool_no": F.floor((F.col("rn") - 1) / POOL_SIZE),
        "is_primary": seat == 0,
        "discount_pct": F.when(seat == 0, 0.0).otherwise(POOL_DISCOUNT_PCT),
    }).drop("rn")


def pool_status(members: DataFrame, primaries: DataFrame) -> DataFrame:
    """Pool of a booking, as member or as primary, with its size and discount."""
    of = members.select("booking_id", "pool_id").union(primaries.select("booking_id", "pool_id")).distinct()
    size = of.groupBy("pool_id").agg(F.count(F.lit(1)).alias("riders"))
    return of.join(size, "pool_id").withColumn("discount_pct", F.when(F.col("riders") > 1, POOL_DISCOUNT_PCT).otherwise(0.0))


def status_funnel(bookings: DataFrame) -> DataFrame:
    """Count per status with its place in the life cycle."""
    step = F.array_position(F.array(*[F.lit(s) for s in FUNNEL]), F.col("status"))
    return bookings.groupBy("status").agg(F.count(F.lit(1)).alias("bookings")).withColumn("step", step.cast("bigint"))


def search_routes(routes: DataFrame, text: str | None = None, category: str | None = None, group: str | None = None,
                  columns: tuple[str, ...] = ("name", "pickup_name", "dropoff_name", "pickup_address", "dropoff_address")) -> DataFrame:
    """Optional category and group filters, and a case-blind substring search."""
    if category is not None:
        routes = routes.filter(F.col("category") == category)
    if group is not None:
        routes = routes.filter(F.col("group_key") == group)
    if text:
        pattern = "%" + text.replace("\\", "\\\\") + "%"
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
        routes = routes.filter(hit)
    return routes
