"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables, default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3).
Queries over the lake are the median of warm runs; writes, the stream and other queries run once after a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tideline.functions import payload  # noqa: E402
from tideline.operators import analytics, dedupe, rollup  # noqa: E402
from tideline.plans.fixtures import fixture  # noqa: E402
from tideline.plans.queries import QUERIES  # noqa: E402
from tideline.session import local_session  # noqa: E402
from tideline.sources import lake, store, topics  # noqa: E402
from tideline.streaming.ingest import Ingest  # noqa: E402
from tideline.tables import EVENT_COLUMNS, MESSAGES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
REGISTERED = (
    "decode_reasons", "route_counts", "insert_if_new", "product_stats_merge", "validation_summary", "dlq_inspect",
    "dlq_redrive", "normalize_shades", "product_keys", "product_ingredients", "catalog_build", "catalog_ids",
    "latency_percentiles", "ingest_windows", "run_summary", "counter_rates", "recovery_time",
)


def once(function) -> float:
    started = time.perf_counter()
    function()
    return time.perf_counter() - started


def median(function, repeat: int = REPEAT) -> float:
    function()
    return statistics.median(once(function) for _ in range(repeat))


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(cores=CPUS, memory="16g", shuffle_partitions=CPUS)
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    root, topic = f"{work}/lake", f"{work}/topic"
    seconds: dict[str, float] = {}

    # the lake as a stream leaves it, in small files with redelivered events, and the topic as it came
    given = fixture(spark, SF_DIR, "deliveries").select(*EVENT_COLUMNS).repartition(CPUS * 4)
    lake.append_events(given, f"{work}/warm")
    seconds["lake_append"] = once(lambda: lake.append_events(given, root))
    messages = fixture(spark, SF_DIR, "messages").select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "topic",
        F.col("part_no").alias("partition"), F.col("pos").alias("offset"),
        F.lit(0).cast("timestamp").alias("timestamp"), F.lit(None).cast(MESSAGES["headers"].dataType).alias("headers"),
    )
    messages.repartition(CPUS).write.parquet(topic)
    report: dict = {}
    lake.compact(spark, f"{work}/warm")
    seconds["lake_compact"] = once(lambda: report.update(lake.compact(spark, root)))

    compacted = lake.read_events(spark, root, compacted=True, dedupe=False)
    on_read = lake.read_events(spark, root)
    stats_folder = f"{work}/stats"
    rollup.product_stats(compacted).coalesce(1).write.parquet(stats_folder)
    stats = spark.read.parquet(stats_folder)
    product = 7
    one = F.col("product_id") == product
    lake_queries = {
        "q1_top_products": lambda: analytics.top_products(compacted).collect(),
        "q2_hourly_counts": lambda: analytics.hourly_counts(compacted).collect(),
        "q3_distinct_users_by_shade": lambda: analytics.distinct_users_by_shade(compacted).collect(),
        "q4_recent_events": lambda: analytics.recent_events(compacted, product).collect(),
        "q5_rollup_one": lambda: analytics.rollup_one(stats, product).collect(),
        "q5_recount_one": lambda: analytics.recount_one(compacted, product).collect(),
        "q1_deduped_on_read": lambda: analytics.top_products(on_read).collect(),
        "q2_deduped_on_read": lambda: analytics.hourly_counts(on_read).collect(),
        "q4_deduped_on_read": lambda: analytics.recent_events(
            lake.read_events(spark, root, where=one), product).collect(),
        "recount": lambda: discard(rollup.product_stats(compacted)),
        "dedupe_on_read": lambda: discard(dedupe.one_per_event(lake.read_events(spark, root, dedupe=False))),
        "decode_topic": lambda: discard(payload.decode(topics.file_snapshot(spark, topic))),
    }
    for name, function in lake_queries.items():
        seconds[name] = median(function)
        print(name, round(seconds[name], 3), file=sys.stderr, flush=True)

    def stream(name: str) -> None:
        job = Ingest(f"{work}/{name}", run="bench")
        job.start(topics.file_stream(spark, topic), f"{work}/{name}-checkpoint").awaitTermination()

    stream("warm-store")
    seconds["stream_ingest"] = once(lambda: stream("store"))
    print("stream_ingest", round(seconds["stream_ingest"], 3), file=sys.stderr, flush=True)
    checked = store.validate(spark, f"{work}/store").first().asDict()
    for name in REGISTERED:
        seconds[name] = median(lambda name=name: discard(QUERIES[name](spark, SF_DIR)), repeat=1)
        print(name, round(seconds[name], 3), file=sys.stderr, flush=True)

    events = report["distinct_before"]
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {name: round(value, 4) for name, value in seconds.items()}, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "events": events, "cpus": CPUS,
        "rates": {
            "decode_messages_per_s": round(events / seconds["decode_topic"]),
            "stream_messages_per_s": round(events / seconds["stream_ingest"]),
            "lake_append_events_per_s": round(report["rows_before"] / seconds["lake_append"]),
        },
        "compaction": {k: v for k, v in report.items() if k != "seconds"}, "stream_check": checked,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
