"""Inspect and redrive dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fixed


def origin() -> Column:
    """Where a dead letter came from. Letters that do not say share one origin."""
    return F.struct(
        F.coalesce("source_topic", F.lit("")).alias("source_topic"),
        F.coalesce("source_partition", F.lit(-1)).cast("int").alias("source_partition"),
        F.coalesce("source_offset", F.lit(-1)).cast("bigint").alias("source_offset"),
    )


def inspect(letters: DataFrame, position: str = "dlq_offset") -> DataFrame:
    """Messages by reason. A message that was diverted twice counts once, with its last reason."""
    reason = F.coalesce("reason", F.lit(fixed.UNKNOWN_REASON))
    latest = letters.groupBy(origin().alias("origin")).agg(F.max_by(reason, F.col(position)).alias("reason"))
    return latest.groupBy("reason").agg(F.count("*").alias("n"))


def inspect_totals(letters: DataFrame, position: str = "dlq_offset") -> DataFrame:
    """The same in one row: total and a map from reason to count."""
    by_reason = inspect(letters, position)
    entries = F.map_from_entries(F.collect_list(F.struct("reason", "n")))  # one entry per reason
    return by_reason.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), entries.alias("by_reason")
    )


def redrive(letters: DataFrame, position: str = "dlq_offset") -> DataFrame:
    """The first copy of every diverted message, with its original key and value."""
    first = F.min_by(F.struct("key", "value"), F.col(position))
    return (
        letters.groupBy(origin().alias("origin"))
        .agg(first.alias("message"))
        .select("origin.source_topic", "origin.source_partition", "origin.source_offset", "message.key", "message.value")
    )
