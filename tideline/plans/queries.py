"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import columns, payload, text
from tideline.operators import agreement, analytics, catalog, deadletters, dedupe, metrics, refresh, rollup, runs
from tideline.plans.fixtures import fixture
from tideline.session import checkpoint_folder, configure, pinned
from tideline.sources import lake
from tideline.tables import EVENT_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PRODUCT = 7
NOW = "2024-02-01 00:00:00"


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def _plain_time(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


# ------------------------------------------------------------------------------------------- inputs
def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "deliveries").select(*EVENT_COLUMNS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.one_per_event(_deliveries(spark, sf_dir))


def _lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deliveries(spark, sf_dir).withColumn("dt", columns.event_day(F.col("event_ts")))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = fixture(spark, sf_dir, "conflicting").withColumnsRenamed({"part_no": "partition", "pos": "offset"})
    return dedupe.first_delivery(renamed)


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.unseen(_batch(spark, sf_dir), fixture(spark, sf_dir, "stored"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "messages").withColumnsRenamed({"part_no": "partition", "pos": "offset"})


# -------------------------------------------------------------------------------- keys and payloads
@query
def event_key(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    return source.select("event_id", columns.event_key(F.lit(7), F.col("event_id")).alias("event_key"))


@query
def encode_v1(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", payload.encode_v1().alias("payload"))


@query
def encode_v2(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", payload.encode_v2().alias("payload"))


@query
def plain_decode(spark, sf_dir):
    """Events from their version 1 text, without validation."""
    texts = _events(spark, sf_dir).select(payload.encode_v1().cast("binary").alias("value"))
    events = texts.select(payload.plain_v1(F.col("value")).alias("e")).select("e.*")
    return events.select("event_id", "event_type", "product_id", "shade_id", "user_id", "rating", _plain_time("event_ts"), "channel")


@query
def decode_status(spark, sf_dir):
    return payload.decode_status(_messages(spark, sf_dir)).select("offset", "status").withColumnRenamed("offset", "pos")


def _decoded(spark, sf_dir, decoder):
    return payload.decode(_messages(spark, sf_dir), decoder).select(
        F.col("offset").alias("pos"), "event_id", "event_type", "product_id", "shade_id", "user_id", "rating",
        _plain_time("event_ts"), "channel", "reason",
    )


@query
def decode_strict(spark, sf_dir):
    return _decoded(spark, sf_dir, "strict-v1")


@query
def decode_versioned(spark, sf_dir):
    return _decoded(spark, sf_dir, "versioned")


@query
def decode_reasons(spark, sf_dir):
    decoded = payload.decode(_messages(spark, sf_dir))
    return decoded.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query
def route_counts(spark, sf_dir):
    """Messages per decoder and per partition that are stored, and that go to the dead letters."""
    decoded = payload.decode(_messages(spark, sf_dir), both=True)
    judged = F.array(*[F.struct(F.lit(decoder).alias("decoder"), F.col(reason).alias("reason"))
                       for decoder, reason in zip(payload.DECODERS, ("strict_reason", "reason"), strict=True)])
    return decoded.select("partition", F.inline(judged)).groupBy("decoder", F.col("partition").alias("part_no")).agg(
        columns.count_if(F.col("reason").isNull()).alias("stored"),
        columns.count_if(F.col("reason").isNotNull()).alias("dead_letters"),
    )


@query
def outcome_counts(spark, sf_dir):
    """Sent, valid, valid for a version 1 reader, version 2 and bad messages."""
    both = payload.decode(_messages(spark, sf_dir), both=True)
    valid, strict = F.col("reason").isNull(), F.col("strict_reason").isNull()
    return both.agg(
        F.count("*").alias("sent"), columns.count_if(valid).alias("valid"), columns.count_if(strict).alias("v1_valid"),
        columns.count_if(valid & ~strict).alias("v2"), columns.count_if(~valid).alias("bad"),
    )


# ------------------------------------------------------------------------- dedupe, rollup and checks
@query
def insert_if_new(spark, sf_dir):
    return _new(spark, sf_dir).select(
        "event_id", "event_type", "product_id", "shade_id", "user_id", "rating", _plain_time("event_ts"), "channel"
    )


def _plain_stats(stats: DataFrame) -> DataFrame:
    return stats.select(
        "product_id", "review_count", "rating_sum", "search_count", "view_count", _plain_time("last_event_ts")
    )


@query
def product_stats_delta(spark, sf_dir):
    return _plain_stats(rollup.product_stats(_new(spark, sf_dir)))


@query
def product_stats_merge(spark, sf_dir):
    current = rollup.product_stats(fixture(spark, sf_dir, "stored"))
    return _plain_stats(rollup.add_up(current, rollup.product_stats(_new(spark, sf_dir))))


@query
def product_stats(spark, sf_dir):
    return _plain_stats(rollup.product_stats(_events(spark, sf_dir)))


@query
def rollup_mismatches(spark, sf_dir):
    """A rollup that counted redelivered copies, against a recount of the stored events."""
    return rollup.mismatches(_events(spark, sf_dir), rollup.product_stats(_deliveries(spark, sf_dir)))


@query
def validation_summary(spark, sf_dir):
    return rollup.validation_summary(_events(spark, sf_dir), rollup.product_stats(_deliveries(spark, sf_dir)))


@query
def replay_check(spark, sf_dir):
    """The summary after one delivery, and after everything was delivered a second time."""
    delivered = fixture(spark, sf_dir, "conflicting")
    kept = fixture(spark, sf_dir, "stored").select(*EVENT_COLUMNS)
    stats = rollup.product_stats(kept)
    states = [delivered.agg(F.count("*").alias("events")).select(
        F.lit("redelivered").alias("state"), "events", F.lit(0).cast("bigint").alias("stats_total"),
        F.lit(0).cast("bigint").alias("mismatched_products"),
    )]
    for state in ("before", "after"):
        # each delivery is a job that leaves its tables behind
        new = pinned(dedupe.unseen(_batch(spark, sf_dir).select(*EVENT_COLUMNS), kept))
        stats = pinned(rollup.add_up(stats, rollup.product_stats(new)))
        kept = kept.unionByName(new)
        states.append(rollup.validation_summary(kept, stats).withColumn("state", F.lit(state)))
    return states[0].unionByName(states[1]).unionByName(states[2])


@query
def events_deduped(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id", "event_type", "product_id", "shade_id", "user_id", "rating", _plain_time("event_ts"), "channel"
    )


@query
def compact_day(spark, sf_dir):
    """A lake of all deliveries, compacted: each day deduplicated on its own and ordered by product and time."""
    root = f"{checkpoint_folder(spark)}/lake-{uuid.uuid4().hex}"
    lake.append_events(_deliveries(spark, sf_dir), root)
    lake.compact(spark, root)
    return lake.read_events(spark, root, compacted=True, dedupe=False).select(
        "dt", "event_id", "event_type", "product_id", "shade_id", "user_id", "rating", _plain_time("event_ts"), "channel")


@query
def compaction_report(spark, sf_dir):
    return lake.compaction_counts(_lake(spark, sf_dir))


@query
def answers_agree(spark, sf_dir):
    """The product report from deduplicated reads against the one from days deduplicated on their own."""
    order = (F.desc("reviews"), F.col("product_id"))
    on_read = agreement.with_rank(analytics.top_products(_events(spark, sf_dir)), *order)
    compacted = agreement.with_rank(
        analytics.top_products(dedupe.one_per_event(_lake(spark, sf_dir), "dt")), *order
    )
    return agreement.agree(on_read, compacted)


# -------------------------------------------------------------------------------------------- reports
@query
def top_products(spark, sf_dir):
    return analytics.top_products(_events(spark, sf_dir))


@query
def hourly_counts(spark, sf_dir):
    return analytics.hourly_counts(_events(spark, sf_dir))


@query
def distinct_users_by_shade(spark, sf_dir):
    return analytics.distinct_users_by_shade(_deliveries(spark, sf_dir))


@query
def recent_events(spark, sf_dir):
    one = _deliveries(spark, sf_dir).where(F.col("product_id") == PRODUCT)
    return analytics.recent_events(dedupe.one_per_event(one), PRODUCT).withColumn(
        "event_ts", F.col("event_ts").cast("timestamp_ntz")
    )


@query
def rollup_one(spark, sf_dir):
    """One product looked up in the rollup and recounted from its events."""
    looked_up = analytics.rollup_one(rollup.product_stats(_events(spark, sf_dir)), PRODUCT)
    one = _deliveries(spark, sf_dir).where(F.col("product_id") == PRODUCT)
    recounted = analytics.recount_one(dedupe.one_per_event(one), PRODUCT)
    return looked_up.withColumn("source", F.lit("rollup")).unionByName(recounted.withColumn("source", F.lit("events")))


@query
def channel_counts(spark, sf_dir):
    return analytics.channel_counts(_events(spark, sf_dir))


@query
def freshness(spark, sf_dir):
    return analytics.freshness(_deliveries(spark, sf_dir), F.lit(NOW).cast("timestamp"))


# --------------------------------------------------------------------------------------- dead letters
def _letters(spark, sf_dir):
    return fixture(spark, sf_dir, "dead_letters")


@query
def dlq_inspect(spark, sf_dir):
    return deadletters.inspect(_letters(spark, sf_dir))


@query
def dlq_redrive(spark, sf_dir):
    return deadletters.redrive(_letters(spark, sf_dir))


@query
def redrive_reconciled(spark, sf_dir):
    """A version 1 reader, its dead letters, and a second pass over them by a reader that knows version 2."""
    messages = _messages(spark, sf_dir)
    # the first pass leaves its result behind, as the store and the dead-letter table would
    first = pinned(payload.decode(messages, "strict-v1"))
    stored = dedupe.first_delivery(
        first.where(F.col("reason").isNull()).select(*EVENT_COLUMNS, "partition", "offset")
    ).select(*EVENT_COLUMNS)
    diverted = first.where(F.col("reason").isNotNull()).select(
        "key", "value", "reason", F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"), F.col("offset").alias("dlq_offset"),
    )
    # a restart before the commit diverts a message twice
    again = diverted.where(F.col("source_partition") == 2).withColumn("dlq_offset", F.col("dlq_offset") + 100000000)
    letters = diverted.unionByName(again)
    redriven = deadletters.redrive(letters).withColumnsRenamed(
        {"source_topic": "topic", "source_partition": "partition", "source_offset": "offset"}
    )
    second = pinned(payload.decode(redriven, "versioned"))
    recovered = dedupe.first_delivery(
        second.where(F.col("reason").isNull()).select(*EVENT_COLUMNS, "partition", "offset")
    ).select(*EVENT_COLUMNS)
    new = dedupe.unseen(recovered, stored)
    kept = stored.unionByName(new)
    stats = rollup.add_up(rollup.product_stats(stored), rollup.product_stats(new))

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    rows = tally(messages, "sent")
    for df, name in ((stored, "stored_first"), (letters, "dead_letters"), (redriven, "redriven"), (kept, "stored"),
                     (second.where(F.col("reason").isNotNull()), "still_bad"), (rollup.mismatches(kept, stats), "mismatched")):
        rows = rows.unionByName(tally(df, name))
    names = ("sent", "stored_first", "dead_letters", "redriven", "stored", "still_bad", "mismatched")
    summary = rows.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])
    return summary.withColumn("missing", F.col("sent") - F.col("stored") - F.col("still_bad"))


# -------------------------------------------------------------------------------------------- catalog
@query
def fold_accents(spark, sf_dir):
    raw = fixture(spark, sf_dir, "shades_raw").select(F.concat(F.lit("s"), "shade_id").alias("id"), F.col("raw_name").alias("text"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return raw.unionByName(docs).select("id", text.fold_accents("text").alias("folded"))


@query
def normalize_shades(spark, sf_dir):
    raw = fixture(spark, sf_dir, "shades_raw")
    return raw.select("shade_id", text.normalize_shade(F.col("raw_name")).alias("canonical_name"))


@query
def normalize_brands(spark, sf_dir):
    raw = fixture(spark, sf_dir, "catalog_raw")
    return raw.select("code", text.normalize_brand(F.col("brands")).alias("brand"))


@query
def product_keys(spark, sf_dir):
    raw = fixture(spark, sf_dir, "products_raw")
    return raw.select("product_id", text.product_key(F.col("brand"), F.col("raw_name")).alias("canonical_key"))


@query
def product_ingredients(spark, sf_dir):
    return refresh.product_ingredients(fixture(spark, sf_dir, "products_raw"))


@query
def extract_shades(spark, sf_dir):
    raw = fixture(spark, sf_dir, "catalog_raw")
    return raw.select("code", text.extract_shade(F.col("product_name")).alias("shade"))


@query
def catalog_filter(spark, sf_dir):
    return catalog.catalog_filter(fixture(spark, sf_dir, "catalog_raw")).select(
        "code", "product_name", "brands", "categories_tags"
    )


@query
def best_category(spark, sf_dir):
    raw = fixture(spark, sf_dir, "catalog_raw")
    return raw.select("code", text.best_category(F.col("categories_tags")).alias("category"))


@query
def catalog_build(spark, sf_dir):
    return catalog.catalog_build(fixture(spark, sf_dir, "catalog_raw"))


@query
def catalog_ids(spark, sf_dir):
    numbered = catalog.catalog_ids(catalog.catalog_build(fixture(spark, sf_dir, "catalog_raw")))
    return numbered.select("product_id", "code", "brand", "raw_name", "category", "shade_id", "shade_name", "hex")


def _at() -> Column:
    return F.lit(NOW).cast("timestamp")


@query
def refresh_shades(spark, sf_dir):
    return refresh.refresh_shades(fixture(spark, sf_dir, "shades_raw"), _at()).select(
        "shade_id", "product_id", "raw_name", "canonical_name", "hex", _plain_time("refreshed_at")
    )


@query
def refresh_products(spark, sf_dir):
    return refresh.refresh_products(fixture(spark, sf_dir, "products_raw"), _at()).select(
        "product_id", "brand", "raw_name", "category", "canonical_key", _plain_time("refreshed_at")
    )


@query
def refresh_report(spark, sf_dir):
    products = fixture(spark, sf_dir, "products_raw")
    return refresh.refresh_report(
        refresh.refresh_shades(fixture(spark, sf_dir, "shades_raw"), _at()),
        refresh.refresh_products(products, _at()),
        refresh.product_ingredients(products),
    )


@query
def duplicate_products(spark, sf_dir):
    raw = fixture(spark, sf_dir, "catalog_raw").select(
        "code", F.col("brands").alias("brand"), F.col("product_name").alias("raw_name")
    )
    return refresh.duplicate_products(refresh.refresh_products(raw, _at()))


# -------------------------------------------------------------------------------------------- metrics
@query
def latency_percentiles(spark, sf_dir):
    return metrics.latency_percentiles(fixture(spark, sf_dir, "metric_windows"), ["scenario", "consumer"], "e2e_p99_ms")


@query
def ingest_windows(spark, sf_dir):
    """Windows of an hour over the messages: stored a little after they were produced, in writes of a product each."""
    delivered = fixture(spark, sf_dir, "deliveries")
    at = F.timestamp_millis(F.col("ms") + F.col("src_id") * 37 % 4000)
    stored = delivered.where(F.col("event_type") != "search").select(at.alias("at"), "event_ts")
    bad = delivered.where(F.col("event_type") == "search").select(at.alias("at"))
    calls = delivered.select(at.alias("at"), (F.col("product_id") / 8.0).alias("ms"))
    return metrics.ingest_windows(stored, bad, calls, seconds=3600)


@query
def lag_by_partition(spark, sf_dir):
    names = {"part_no": "partition"}
    lag = metrics.lag_by_partition(
        fixture(spark, sf_dir, "high_watermarks").withColumnsRenamed(names),
        fixture(spark, sf_dir, "consumed").withColumnsRenamed(names),
    )
    return lag.withColumnRenamed("partition", "part_no")


def _run_seconds(spark, sf_dir):
    return metrics.run_seconds(fixture(spark, sf_dir, "metric_windows"), fixture(spark, sf_dir, "scenarios"))


@query
def run_seconds(spark, sf_dir):
    return _run_seconds(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@query
def run_summary(spark, sf_dir):
    summary = metrics.run_summary(
        _run_seconds(spark, sf_dir), fixture(spark, sf_dir, "scenarios"), fixture(spark, sf_dir, "refreshes")
    )
    return summary.select(
        "scenario", "produce_s", F.round("throughput", 6).alias("throughput"), "peak_lag", "drain_s",
        F.round("sink_ms_per_event", 6).alias("sink_ms_per_event"), "batch_refreshes",
        F.round("batch_mean_s", 6).alias("batch_mean_s"),
    )


def _run_inputs(spark, sf_dir):
    return tuple(fixture(spark, sf_dir, name) for name in ("db_samples", "k8s_samples", "runs"))


@query
def backlog(spark, sf_dir):
    samples, _, table = _run_inputs(spark, sf_dir)
    return runs.backlog(samples, table)


@query
def backlog_series(spark, sf_dir):
    samples, _, table = _run_inputs(spark, sf_dir)
    return runs.backlog_series(samples, table)


@query
def staleness(spark, sf_dir):
    return runs.staleness(*_run_inputs(spark, sf_dir))


@query
def counter_rates(spark, sf_dir):
    _, pods, table = _run_inputs(spark, sf_dir)
    return runs.counter_rates(pods, table).withColumns({"used": F.round("used", 6), "throttled": F.round("throttled", 6)})


@query
def throttled_total(spark, sf_dir):
    _, pods, table = _run_inputs(spark, sf_dir)
    return runs.throttled_total(runs.counter_rates(pods, table)).withColumn("throttled_s", F.round("throttled_s", 6))


@query
def pod_seconds(spark, sf_dir):
    _, pods, table = _run_inputs(spark, sf_dir)
    return runs.pod_seconds(pods, table)


@query
def recovery_time(spark, sf_dir):
    samples, _, table = _run_inputs(spark, sf_dir)
    return runs.recovery_time(samples, table)


@query
def worst_p99(spark, sf_dir):
    return metrics.worst_p99(fixture(spark, sf_dir, "metric_windows"), fixture(spark, sf_dir, "scenarios"))


@query
def peak_p99(spark, sf_dir):
    return metrics.peak_p99(fixture(spark, sf_dir, "metric_windows"), fixture(spark, sf_dir, "scenarios"))


@query
def reconcile(spark, sf_dir):
    return runs.reconcile(fixture(spark, sf_dir, "runs"))


@query
def compare_runs(spark, sf_dir):
    table = fixture(spark, sf_dir, "runs")
    killed = table.where(F.col("killed_at").isNotNull())
    lossy = table.where(F.col("dead") > 500)
    return runs.compare_runs(killed, lossy, ["sent", "stored", "dead"])


@query
def call_summary(spark, sf_dir):
    summary = metrics.call_summary(fixture(spark, sf_dir, "calls"), "sink")
    return summary.withColumns({name: F.round(name, 6) for name in ("total_s", "mean_ms", "events_per_s")})


@query
def query_times(spark, sf_dir):
    return metrics.query_times(fixture(spark, sf_dir, "calls"), "sink")


@query
def completion(spark, sf_dir):
    windows = fixture(spark, sf_dir, "db_samples").select("run", F.col("pg_connections").alias("processed"))
    table = fixture(spark, sf_dir, "runs").select("run", F.lit(400).alias("sent"), F.col("stored").alias("target"))
    return metrics.completion(windows, fixture(spark, sf_dir, "db_samples"), table)
