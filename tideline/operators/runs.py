"""Time series of test runs: backlog, staleness, rates, recovery, reconciliation.

``runs`` has one row per run (run, t0, produce_end, drain_end, killed_at, sent, ...); samples carry the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fixed
from tideline.operators.ordering import with_next


def _active(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples from a second before the start to a second after the drain, with ``t`` since the start."""
    known = runs.select(
        "run", "t0", "killed_at",
        (F.col("produce_end") - F.col("t0")).alias("produce_s"),
        F.greatest(F.col("drain_end") - F.col("produce_end"), F.lit(0.0)).alias("drain_s"),
    )
    timed = samples.join(known, "run").where(F.col("ts") >= F.col("t0") - 1).withColumn("t", F.col("ts") - F.col("t0"))
    return timed.where(F.col("t") <= F.col("produce_s") + F.col("drain_s") + 1)


def backlog_series(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Produced but not stored, over time."""
    return _active(samples, runs).select("run", "t", (F.col("produced") - F.col("stored")).alias("backlog"))


def backlog(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Peak backlog and length of the drain per run."""
    peaks = backlog_series(samples, runs).groupBy("run").agg(F.max("backlog").alias("peak"))
    drain = F.greatest(F.col("drain_end") - F.col("produce_end"), F.lit(0.0))
    return runs.join(peaks, "run", "left").select(
        "run", F.coalesce("peak", F.lit(0)).cast("bigint").alias("peak_backlog"), drain.alias("drain_s")
    )


def staleness(samples: DataFrame, pods: DataFrame, runs: DataFrame) -> DataFrame:
    """Peaks of staleness (up to the end of the drain), connections and ready pods per run."""
    in_time = F.col("t") <= F.col("produce_s") + F.col("drain_s")
    stale = _active(samples, runs).groupBy("run").agg(
        F.max(F.when(in_time, F.coalesce("freshness_s", F.lit(0.0)))).alias("stale"),
        F.max("pg_connections").alias("connections"),
    )
    since = pods.join(runs.select("run", "t0"), "run").where(F.col("ts") >= F.col("t0") - 1)
    ready = since.groupBy("run").agg(F.max(F.coalesce("ready", F.lit(0))).alias("ready"))
    return runs.join(stale, "run", "left").join(ready, "run", "left").select(
        "run",
        F.coalesce("stale", F.lit(0.0)).alias("peak_staleness_s"),
        F.coalesce("connections", F.lit(0)).cast("bigint").alias("peak_connections"),
        F.coalesce("ready", F.lit(0)).cast("bigint").alias("peak_ready"),
    )


def _pairs(pods: DataFrame, runs: DataFrame, columns: list[str]) -> DataFrame:
    """Every sample with the next one of its run."""
    since = pods.join(runs.select("run", "t0", "drain_end"), "run").where(F.col("ts") >= F.col("t0") - 1)
    return with_next(since.select("run", "ts", "t0", "drain_end", *columns), ["run"], ["ts"], ["ts", *columns]).where(
        F.col("next_ts").isNotNull()
    )


def counter_rates(pods: DataFrame, runs: DataFrame) -> DataFrame:
    """CPU used and throttled between consecutive samples, as a share of wall-clock time.

    A pair without a usage value on either side is skipped. Adding up ``throttled`` gives the total the
    reports show: a sum of rates, not an integral.
    """
    pairs = _pairs(pods, runs, ["pg_usage_usec", "pg_throttled_usec"]).where(
        F.col("pg_usage_usec").isNotNull() & F.col("next_pg_usage_usec").isNotNull()
    )
    dt = F.col("next_ts") - F.col("ts")
    return pairs.select(
        "run", (F.col("next_ts") - F.col("t0")).alias("t"),
        F.try_divide((F.col("next_pg_usage_usec") - F.col("pg_usage_usec")) / 1e6, dt).alias("used"),
        F.try_divide((F.col("next_pg_throttled_usec") - F.col("pg_throttled_usec")) / 1e6, dt).alias("throttled"),
    )


def throttled_total(rates: DataFrame) -> DataFrame:
    return rates.groupBy("run").agg(F.coalesce(F.sum("throttled"), F.lit(0.0)).alias("throttled_s"))


def pod_seconds(pods: DataFrame, runs: DataFrame) -> DataFrame:
    """Ready pods integrated over time as steps, up to the end of the drain."""
    pairs = _pairs(pods, runs, ["ready"]).where(F.col("ts") <= F.col("drain_end"))
    area = (F.col("next_ts") - F.col("ts")) * F.coalesce("ready", F.lit(0))
    sums = pairs.groupBy("run").agg(F.sum(area).alias("area"))
    return runs.join(sums, "run", "left").select("run", F.coalesce("area", F.lit(0.0)).alias("pod_seconds"))


def recovery_time(samples: DataFrame, runs: DataFrame, recovered: int = fixed.RECOVERED_BACKLOG) -> DataFrame:
    """Seconds from a kill until the backlog is small again, after its peak; null if that never happened."""
    series = (
        _active(samples, runs).where(F.col("killed_at").isNotNull())
        .select("run", "t", (F.col("killed_at") - F.col("t0")).alias("kill_t"),
                (F.col("produced") - F.col("stored")).alias("backlog"))
        .where(F.col("t") >= F.col("kill_t"))
    )
    # the peak at or after the kill, and the first sample later than the kill that shows it
    peak = series.groupBy("run").agg(F.max("backlog").alias("peak"))
    first_peak = (
        series.join(peak, "run")
        .where((F.col("t") > F.col("kill_t")) & (F.col("backlog") == F.col("peak")))
        .groupBy("run").agg(F.min("t").alias("peak_t"))
    )
    back = (
        series.join(first_peak, "run")
        .where((F.col("backlog") < recovered) & (F.col("t") > F.col("kill_t") + 1) & (F.col("t") > F.col("peak_t")))
        .groupBy("run").agg((F.min("t") - F.first("kill_t")).alias("recovery_s"))
    )
    return runs.where(F.col("killed_at").isNotNull()).select("run").join(back, "run", "left").select("run", "recovery_s")


def reconcile(runs: DataFrame) -> DataFrame:
    """Messages sent but neither stored nor dead. Redriven dead letters are stored, so they are not dead."""
    redriven = F.coalesce("redriven", F.lit(0))
    return runs.select(
        "run", "sent", "stored", "dead", redriven.cast("bigint").alias("redriven"),
        (F.col("sent") - (F.col("stored") + F.col("dead") - redriven)).cast("bigint").alias("missing"),
    )


def compare_runs(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Runs of two result sets side by side. A run that only one has is marked as not run in the other."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("run", F.lit(True).alias(f"{name}_run"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    joined = side(left, "a").join(side(right, "b"), "run", "full_outer")

    def outcome(name: str) -> Column:
        return F.when(F.col(f"{name}_run"), "run").otherwise("not run")

    return joined.select(
        "run", outcome("a").alias("a_outcome"), *[f"a_{c}" for c in columns],
        outcome("b").alias("b_outcome"), *[f"b_{c}" for c in columns],
    )
