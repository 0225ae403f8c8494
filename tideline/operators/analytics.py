"""Reports over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fixed


def top_products(events: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Products with most reviews, and their average rating."""
    return (
        events.where(F.col("event_type") == "review")
        .groupBy("product_id")
        .agg(F.count("*").alias("reviews"), F.round(F.avg("rating"), 3).alias("avg_rating"))
        .orderBy(F.desc("reviews"), "product_id")
        .limit(k)
    )


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per hour (as epoch seconds) and type."""
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("event_ts")))
    return (
        events.groupBy(hour.alias("hour_epoch"), "event_type")
        .agg(F.count("*").alias("n"))
        .orderBy("hour_epoch", "event_type")
    )


def distinct_users_by_shade(events: DataFrame, k: int = fixed.TOP_K, approximate: bool = False) -> DataFrame:
    """Shades with most distinct users. Copies of an event do not matter here, so no dedupe is needed.

    Exact counts reduce (shade, user) pairs on both sides of a shuffle by both columns, so a very popular
    shade is spread.  ``approximate`` trades exactness for one small sketch per shade.
    """
    users = F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id")
    return (
        events.groupBy("shade_id").agg(users.alias("users")).orderBy(F.desc("users"), "shade_id").limit(k)
    )


def recent_events(events: DataFrame, product_id: int, k: int = fixed.TOP_K) -> DataFrame:
    """Latest events of one product. Pass events that are not deduplicated yet with ``where`` of the lake reader."""
    return (
        events.where(F.col("product_id") == product_id)
        .select("event_id", "event_type", "event_ts")
        .orderBy(F.desc("event_ts"), "event_id")
        .limit(k)
    )


def average_rating(rating_sum: Column, review_count: Column) -> Column:
    return F.round(F.try_divide(rating_sum.cast("double"), review_count), 3)


def rollup_one(stored: DataFrame, product_id: int) -> DataFrame:
    """Review count and average rating of one product from the rollup; no row for an unknown product."""
    return stored.where(F.col("product_id") == product_id).select(
        "review_count", average_rating(F.col("rating_sum"), F.col("review_count")).alias("avg_rating")
    )


def recount_one(events: DataFrame, product_id: int) -> DataFrame:
    """The same from the events: always one row, 0 and null for an unknown product."""
    reviews = events.where((F.col("product_id") == product_id) & (F.col("event_type") == "review"))
    return reviews.agg(
        F.count("*").alias("review_count"), F.round(F.avg("rating"), 3).alias("avg_rating")
    )


def channel_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("channel", F.lit("none")).alias("channel")).agg(F.count("*").alias("n"))


def freshness(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Seconds since the latest event, null without events."""
    now = F.current_timestamp() if now is None else now
    age = (F.unix_micros(now) - F.unix_micros(F.max("event_ts"))) / 1e6
    return events.agg(age.alias("freshness_s"))
