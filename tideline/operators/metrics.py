"""Metrics of consumers: latency, lag, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import whole_second
from tideline.operators.ordering import nearest_rank


def latency_percentiles(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact p50 and p99 per group by nearest rank."""
    return nearest_rank(samples, group, value, {"p50": 0.50, "p99": 0.99})


def ingest_windows(stored: DataFrame, bad: DataFrame, calls: DataFrame, seconds: int = 1) -> DataFrame:
    """Metrics per window of ``seconds``.

    ``stored`` has one row per stored event (``at``, ``event_ts``), ``bad`` one per rejected message
    (``at``), ``calls`` one per write (``at``, ``ms``); ``at`` is when it happened.
    """
    step = F.lit(int(seconds))
    second = (F.floor(F.unix_seconds("at") / step) * step).cast("bigint")
    latency = (F.unix_micros("at") - F.unix_micros("event_ts")) / 1000.0
    good = stored.select(second.alias("window_s"), latency.alias("e2e_ms"))
    timed = calls.select(second.alias("window_s"), F.col("ms").cast("double").alias("ms"))
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)

    counts = (
        good.select("window_s", F.lit(1).alias("processed"), F.lit(0).alias("dlq"), F.lit(0).alias("calls"),
                    none.alias("ms"))
        .unionByName(bad.select(second.alias("window_s"), F.lit(0).alias("processed"), F.lit(1).alias("dlq"),
                                F.lit(0).alias("calls"), none.alias("ms")))
        .unionByName(timed.select("window_s", F.lit(0).alias("processed"), F.lit(0).alias("dlq"),
                                  F.lit(1).alias("calls"), "ms"))
        .groupBy("window_s")
        .agg(
            F.sum("processed").cast("bigint").alias("processed"), F.sum("dlq").cast("bigint").alias("dlq"),
            F.sum("calls").cast("bigint").alias("sink_calls"), F.sum("ms").alias("sink_ms_total"),
        )
    )
    values = good.select("window_s", F.lit("e2e").alias("series"), F.col("e2e_ms").alias("ms")).unionByName(
        timed.select("window_s", F.lit("call").alias("series"), "ms")
    )
    ranks = latency_percentiles(values, ["window_s", "series"], "ms")

    def of(series: str, column: str) -> Column:
        return F.max(F.when(F.col("series") == series, F.col(column)))

    per_window = ranks.groupBy("window_s").agg(
        of("e2e", "p50").alias("e2e_p50_ms"), of("e2e", "p99").alias("e2e_p99_ms"),
        of("call", "p50").alias("sink_call_p50_ms"), of("call", "p99").alias("sink_call_p99_ms"),
    )
    joined = counts.join(per_window, "window_s", "left")
    return joined.select(
        "window_s", "processed", "dlq", "sink_calls", "sink_ms_total",
        *[F.coalesce(name, none).alias(name)
          for name in ("e2e_p50_ms", "e2e_p99_ms", "sink_call_p50_ms", "sink_call_p99_ms")],
    )


def lag_by_partition(high: DataFrame, consumed: DataFrame) -> DataFrame:
    """Messages not consumed yet per (topic, partition): ``high`` minus ``next_offset``, never negative.

    A partition nobody has consumed counts from 0; one without a known high watermark counts as 0.
    """
    keys = ["topic", "partition"]
    gap = F.coalesce("high", F.lit(0)) - F.coalesce("next_offset", F.lit(0))
    return high.join(consumed, keys, "full_outer").select(
        *keys, F.greatest(gap, F.lit(0)).cast("bigint").alias("lag")
    )


def run_seconds(windows: DataFrame, starts: DataFrame, run: str = "scenario") -> DataFrame:
    """Per run and second since its start: all consumers together.

    ``starts`` has one row per run (``run``, ``t0``).
    """
    second = whole_second(F.col("ts") - F.col("t0")).alias("second")
    rate = F.col("processed") / F.greatest(F.coalesce("dt", F.lit(1.0)), F.lit(1e-3))
    return (
        windows.join(starts.select(run, "t0"), run)
        .groupBy(run, second)
        .agg(
            F.sum("processed").cast("bigint").alias("processed"),
            F.sum(rate).alias("rate"),
            F.sum("lag").cast("bigint").alias("lag"),
            F.greatest(F.max("e2e_p99_ms"), F.lit(0.0)).alias("p99_ms"),
            F.sum(F.coalesce("sink_ms_total", F.lit(0.0))).alias("sink_ms"),
            F.sum("sink_calls").cast("bigint").alias("sink_calls"),
        )
    )


def run_summary(seconds: DataFrame, runs: DataFrame, refreshes: DataFrame | None = None,
                run: str = "scenario") -> DataFrame:
    """One row per run: throughput while producing, peak lag, drain time, sink cost per event.

    ``seconds`` comes from :func:`run_seconds`, ``runs`` has (run, t0, produce_end), ``refreshes`` one row
    per batch refresh (run, duration_s).
    """
    produce_s = F.col("produce_end") - F.col("t0")
    during = F.when((F.col("second") >= 0) & (F.col("second") <= F.col("produce_s")), F.col("processed"))
    busy = F.max(F.when(F.col("processed") > 0, F.col("second")))
    known = runs.select(run, produce_s.alias("produce_s"))
    per_run = (
        seconds.join(known, run)
        .groupBy(run, "produce_s")
        .agg(
            F.coalesce(F.sum(during), F.lit(0)).alias("_during"),
            F.max("lag").alias("_peak"), busy.alias("_busy"),
            F.sum("sink_ms").alias("_sink"), F.sum("processed").alias("_processed"),
        )
    )
    result = known.join(per_run.drop("produce_s"), run, "left").select(
        run, "produce_s",
        (F.coalesce("_during", F.lit(0)) / F.greatest("produce_s", F.lit(1.0))).alias("throughput"),
        F.coalesce("_peak", F.lit(0)).cast("bigint").alias("peak_lag"),
        F.greatest(F.coalesce("_busy", F.lit(0)) - F.col("produce_s"), F.lit(0.0)).alias("drain_s"),
        F.try_divide("_sink", "_processed").alias("sink_ms_per_event"),
    )
    if refreshes is None:
        return result
    batch = refreshes.groupBy(run).agg(
        F.count("*").alias("batch_refreshes"), F.avg("duration_s").alias("batch_mean_s")
    )
    return result.join(batch, run, "left").withColumn("batch_refreshes", F.coalesce("batch_refreshes", F.lit(0)))


def worst_p99(windows: DataFrame, starts: DataFrame, run: str = "scenario") -> DataFrame:
    """Worst p99 per run and second, in seconds."""
    second = whole_second(F.col("ts") - F.col("t0")).alias("second")
    return (
        windows.join(starts.select(run, "t0"), run)
        .groupBy(run, second)
        .agg((F.greatest(F.max("e2e_p99_ms"), F.lit(0.0)) / 1000).alias("p99_s"))
    )


def peak_p99(windows: DataFrame, starts: DataFrame, run: str = "scenario") -> DataFrame:
    """The worst p99 of each run, in seconds."""
    return worst_p99(windows, starts, run).groupBy(run).agg(F.max("p99_s").alias("peak_p99_s"))


def call_summary(calls: DataFrame, group: str, value: str = "ms", events: str = "events") -> DataFrame:
    """Timed writes per group: number, total, mean, p50, p99 and events per second of sink time."""
    totals = calls.groupBy(group).agg(
        F.count("*").alias("calls"),
        (F.sum(value) / 1000).alias("total_s"),
        F.avg(value).alias("mean_ms"),
        (F.sum(events) / (F.sum(value) / 1000)).alias("events_per_s"),
    )
    return totals.join(latency_percentiles(calls, [group], value), group).select(
        group, "calls", "total_s", "mean_ms", F.col("p50").alias("p50_ms"), F.col("p99").alias("p99_ms"), "events_per_s"
    )


def query_times(samples: DataFrame, group: str, value: str = "ms", order: str = "seq") -> DataFrame:
    """Timed repeats of a query per group: median (mean of the middle two), fastest, first."""
    counted = samples.groupBy(group).agg(
        F.count("*").alias("n"), F.min(value).alias("min_ms"), F.min_by(value, order).alias("first_ms")
    )
    middle = nearest_rank(samples, [group], value, {"upper": 0.5, "lower": lambda n: F.floor((n - 1) / 2)})
    return counted.join(middle, group).select(
        group, "n", ((F.col("upper") + F.col("lower")) / 2).alias("median_ms"), "min_ms", "first_ms"
    )


def completion(windows: DataFrame, samples: DataFrame, runs: DataFrame, run: str = "run") -> DataFrame:
    """Per run: has everything sent been processed, and has the latest sample reached the target?

    ``windows`` (run, processed), ``samples`` (run, ts, stored), ``runs`` (run, sent, target).
    """
    processed = windows.groupBy(run).agg(F.sum("processed").cast("bigint").alias("processed"))
    latest = samples.groupBy(run).agg(F.max_by("stored", "ts").alias("stored"))
    return (
        runs.join(processed, run, "left").join(latest, run, "left")
        .select(
            run,
            F.coalesce("processed", F.lit(0)).alias("processed"),
            F.coalesce("stored", F.lit(0)).alias("stored"),
            (F.coalesce("processed", F.lit(0)) >= F.col("sent")).alias("drained"),
            (F.coalesce("stored", F.lit(-1)) >= F.col("target")).alias("recovered"),
        )
    )
