"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_key(seed: Column, index: Column) -> Column:
    """Deterministic event id, so that a replay meets the same keys."""
    return F.md5(F.concat_ws(":", seed.cast("string"), index.cast("string")))


def event_day(event_ts: Column) -> Column:
    """UTC day of an event, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(event_ts) / F.lit(86_400)).cast("int"))


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def whole_second(seconds: Column) -> Column:
    """Seconds since a start, cut toward zero."""
    return seconds.cast("bigint")
