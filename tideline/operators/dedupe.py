"""Keep each event once, within a batch, against a store and on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_delivery(events: DataFrame, order: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """One row per event_id: the one with the lowest delivery position.

    An aggregate, not a window: copies of an id are reduced before the shuffle, so an id that makes up
    a large share of the input does not end in one task.
    """
    rest = [name for name in events.columns if name != "event_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return events.groupBy("event_id").agg(first.alias("_first")).select(
        *[F.col("event_id") if name == "event_id" else F.col(f"_first.{name}").alias(name) for name in events.columns]
    )


def unseen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a deduplicated batch whose event_id is not stored yet.

    The stored ids are first reduced to those of the batch; Spark sends the ids of the batch to the store where it measures
    them as small, so that only matches move.
    """
    known = stored.select("event_id").join(batch.select("event_id"), "event_id", "left_semi")
    return batch.join(known, "event_id", "left_anti")


def one_per_event(events: DataFrame, *scope: str) -> DataFrame:
    """Any one row per event_id (and scope, such as the day)."""
    return events.dropDuplicates([*scope, "event_id"])
