"""The per-product rollup: count, add up, check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import count_if
from tideline.tables import COUNTERS

#: buckets of products whose checksums are compared
BUCKETS = 1024


def _counters() -> list[Column]:
    review = F.col("event_type") == "review"
    return [
        count_if(review).alias("review_count"),
        F.coalesce(F.sum(F.when(review, F.col("rating"))), F.lit(0)).cast("bigint").alias("rating_sum"),
        count_if(F.col("event_type") == "search").alias("search_count"),
        count_if(F.col("event_type") == "view").alias("view_count"),
        F.max("event_ts").alias("last_event_ts"),
    ]


def product_stats(events: DataFrame, *more: Column) -> DataFrame:
    """Counters of the given events per product; a delta when they are the new events of a batch."""
    return events.groupBy("product_id").agg(*_counters(), *more)


def delta(events: DataFrame) -> DataFrame:
    """Counters of new events by product (``hour_epoch`` null) and by hour (``product_id`` null), from one pass."""
    hour = F.unix_timestamp(F.date_trunc("hour", "event_ts")).cast("bigint")
    events = events.withColumn("hour_epoch", hour)
    sets = [[F.col("product_id")], [F.col("hour_epoch")]]
    return events.groupingSets(sets, "product_id", "hour_epoch").agg(*_counters())


def add_up(*rollups: DataFrame, by: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Merge rollups: counters are added, the later time stamp stays, unknown products are inserted."""
    everything = reduce(DataFrame.unionByName, rollups)
    return everything.groupBy(*by).agg(
        *[F.sum(name).cast("bigint").alias(name) for name in COUNTERS],
        F.max("last_event_ts").alias("last_event_ts"),
    )


def mismatches(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Products whose stored counters differ from a recount (``last_event_ts`` is not compared)."""
    recount, kept = product_stats(events).alias("r"), stored.alias("p")
    differs = reduce(
        lambda a, b: a | b, [~F.col(f"r.{name}").eqNullSafe(F.col(f"p.{name}")) for name in COUNTERS]
    )
    return (
        recount.join(kept, F.col("r.product_id") == F.col("p.product_id"), "full_outer")
        .where(differs)
        .select(
            F.coalesce("r.product_id", "p.product_id").alias("product_id"),
            *[F.col(f"r.{name}").alias(f"recount_{name}") for name in COUNTERS],
            *[F.col(f"p.{name}").alias(f"stored_{name}") for name in COUNTERS],
        )
    )


def validation_summary(events: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: number of events, total of the rollup, number of products that do not match.

    The events are read and dealt once: their recount also carries how many there are.
    """
    zero = F.lit(0).cast("bigint")
    recount = product_stats(events, F.count("*").alias("n_events")).alias("r")
    differs = reduce(lambda a, b: a | b, [~F.col(f"r.{name}").eqNullSafe(F.col(f"p.{name}")) for name in COUNTERS])
    total = F.col("p.review_count") + F.col("p.search_count") + F.col("p.view_count")
    return recount.join(stored.alias("p"), F.col("r.product_id") == F.col("p.product_id"), "full_outer").agg(
        F.coalesce(F.sum("r.n_events"), zero).alias("events"), F.coalesce(F.sum(total), zero).alias("stats_total"),
        count_if(differs).alias("mismatched_products"),
    )


def bucket(product: str = "product_id") -> Column:
    """The bucket of products that a checksum covers."""
    return F.pmod(F.xxhash64(product), F.lit(BUCKETS)).cast("int")


def checksums(stats: DataFrame) -> DataFrame:
    """``bucket, total, checksum`` of a rollup, or of the parts it is the sum of, in any order and grouping.

    Each counter of each product has a weight of its own, so the checksum of a sum is the sum of checksums: parts need not be
    merged by product to be compared.
    """
    weighted = [F.col(name).cast("decimal(20,0)") * F.pmod(F.xxhash64("product_id", F.lit(name)), F.lit((1 << 31) - 1)).cast("decimal(10,0)") for name in COUNTERS]
    counted = F.col("review_count") + F.col("search_count") + F.col("view_count")
    return stats.groupBy(bucket().alias("bucket")).agg(
        F.sum(counted).alias("total"), F.sum(reduce(lambda a, b: a + b, weighted).cast("decimal(38,0)")).alias("checksum"))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets of products whose rollups are not the same, from one row a bucket."""
    a, b = checksums(left).alias("a"), checksums(right).alias("b")
    same = F.col("a.checksum").eqNullSafe(F.col("b.checksum")) & F.col("a.total").eqNullSafe(F.col("b.total"))
    joined = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full_outer")
    return joined.where(~same).select(F.coalesce("a.bucket", "b.bucket").alias("bucket"))
