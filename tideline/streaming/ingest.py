"""The stream: messages to stored events, a rollup and dead letters."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.storagelevel import StorageLevel

from tideline.functions.columns import event_day
from tideline.functions.payload import decode
from tideline.operators import dedupe, rollup
from tideline.session import configure
from tideline.sources import claims, id_index, lake, store
from tideline.sources.logs import or_empty
from tideline.tables import EVENT_COLUMNS

POLICIES = ("dlq", "skip", "fail")
#: a batch with so few ids asks the files of the index for them by name
FEW = 200


class BadEvent(Exception):
    """Raised by the ``fail`` policy. The micro-batch is not committed and its offsets do not advance."""


def totals_of(decoded: DataFrame) -> Row:
    """Counts of a micro-batch, the days of its events and the prefixes of their ids."""
    good = F.col("reason").isNull()
    return decoded.agg(
        F.count_if(good).alias("good"), F.count_if(~good).alias("bad"),
        F.collect_set(F.when(good, event_day(F.col("event_ts")))).alias("days"),
        F.collect_set(F.when(good, id_index.prefix())).alias("prefixes"),
    ).first()


def checkpoint_of(batch: DataFrame) -> str:
    """Id of the stream, as its checkpoint keeps it over restarts, that this batch belongs to."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "no stream"


def stop_at_bad(decoded: DataFrame) -> None:
    """Raise for the first rejected message of a batch."""
    bad = decoded.where(F.col("reason").isNotNull())
    worst = bad.orderBy("topic", "partition", "offset").select("reason", "topic", "partition", "offset").first()
    raise BadEvent(f"{worst['reason']} at {worst['topic']}[{worst['partition']}]@{worst['offset']}")


def write_dead_letters(decoded: DataFrame, folder: str) -> None:
    """Rejected messages with reason, origin and the time they were diverted."""
    decoded.where(F.col("reason").isNotNull()).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "reason",
        F.col("topic").alias("source_topic"), F.col("partition").cast("int").alias("source_partition"),
        F.col("offset").alias("source_offset"), F.current_timestamp().alias("diverted_at"),
    ).write.parquet(folder)


def write_commit(spark: SparkSession, folder: str, totals: Row, inserted: int, started: float) -> None:
    """The counts of a batch; one small file needs no job."""
    claims.create(spark, f"{folder}/counts", {
        "committed_at": datetime.now(timezone.utc).isoformat(), "processed": totals["good"], "inserted": inserted,
        "dlq": totals["bad"], "sink_ms": (time.perf_counter() - started) * 1000.0,
    })


def until_committed(batch: DataFrame, root: str, run: str, batch_id: int, write: Callable[[store.Progress, Callable[[str], str]], None]) -> None:
    """Write a batch in attempts until one counts, or until another process has committed it.

    ``write(now, folder)`` stores the batch as it follows on ``now``; ``folder(table)`` names a folder of this attempt. Each
    attempt that fails means that another one was committed, so writers that meet get on one after the other.
    """
    spark = batch.sparkSession
    run = claims.bound_name(spark, root, run, checkpoint_of(batch))
    now = store.progress(spark, root)
    if now.has(run, batch_id):
        return
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while not now.has(run, batch_id):
            attempt = uuid.uuid4().hex
            write(now, lambda table: f"{store.batch_folder(root, table, run, batch_id)}/attempt=a{attempt}")
            if store.commit(spark, root, now, run, batch_id, f"a{attempt}"):
                return
            now = store.progress(spark, root)
    finally:
        batch.unpersist()


@dataclass(frozen=True)
class Ingest:
    """What to do with a micro-batch.

    ``on_bad``: ``dlq`` keeps rejected messages with reason and origin, ``skip`` only counts them, ``fail`` stops.
    ``dedupe``: ``store`` checks new ids against all stored ones (exact, no limit in time): the batches since the last fold and
    the folders of the id index that the batch has ids of; ``days`` against those of the days that the batch has events of
    (exact while an id keeps its time stamp). No way drops a late event. Runs that write to one store at the same time insert
    each id once. ``run`` is bound to the checkpoint that uses it first; batches of another one go under a name of their own.
    ``fold_every``: merge stored batches when so many have come together; None leaves that to calls of ``store.fold``.
    """

    root: str
    run: str
    decoder: str = "versioned"
    on_bad: str = "dlq"
    dedupe: str = "store"
    fold_every: int | None = 64

    def __post_init__(self) -> None:
        if self.on_bad not in POLICIES:
            raise ValueError(f"unknown policy {self.on_bad!r}, expected one of {POLICIES}")
        if self.dedupe not in ("store", "days"):
            raise ValueError(f"unknown dedupe {self.dedupe!r}")

    # ------------------------------------------------------------------------------------- stream
    def write_batch(self, decoded: DataFrame, batch_id: int) -> None:
        """Store one micro-batch. Called again for the same batch, it leaves the same result."""
        spark = decoded.sparkSession
        until_committed(decoded, self.root, self.run, batch_id, lambda now, folder: self._write(spark, decoded, now, folder))
        if self.fold_every is not None and len(store.progress(spark, self.root).notes) >= self.fold_every:
            store.fold(spark, self.root)

    def _write(self, spark: SparkSession, decoded: DataFrame, now: store.Progress, folder: Callable[[str], str]) -> None:
        started = time.perf_counter()
        totals = totals_of(decoded)
        if self.on_bad == "fail" and totals["bad"]:
            stop_at_bad(decoded)
        good = decoded.where(F.col("reason").isNull()).select(*EVENT_COLUMNS, "topic", "partition", "offset")
        new = dedupe.first_delivery(good, ("topic", "partition", "offset")).select(*EVENT_COLUMNS)
        if self.dedupe == "days":
            # the days of a batch are few; their folders are the only ones that are read
            known = store.events(spark, self.root, now)
            known = known.where(F.col("dt").isin(totals["days"]) if totals["days"] else F.lit(False)).select("event_id")
        else:
            known = store.known_ids(spark, self.root, now, totals["prefixes"])
        if totals["good"] <= FEW:
            ids = [row["event_id"] for row in good.select("event_id").distinct().collect()]
            met = [row["event_id"] for row in known.where(F.col("event_id").isin(ids)).distinct().collect()] if ids else []
            new = new.where(~F.col("event_id").isin(met)) if met else new
        else:
            new = dedupe.unseen(new, known)
        (
            new.withColumn("dt", event_day(F.col("event_ts"))).hint("rebalance", "dt")
            .write.partitionBy("dt").option("compression", "zstd").parquet(folder("events"))
        )
        if self.on_bad == "dlq" and totals["bad"]:
            write_dead_letters(decoded, folder("dead_letters"))
        # from the files just written, so that rollup and events cannot differ
        written = or_empty(
            spark, new.schema, lambda: spark.read.schema(new.schema).parquet(folder("events"))
        )
        counted = Observation()
        rows = F.when(F.col("hour_epoch").isNull(), F.col("review_count") + F.col("search_count") + F.col("view_count"))
        delta = rollup.delta(written).observe(counted, F.coalesce(F.sum(rows), F.lit(0)).alias("rows"))
        delta.write.parquet(folder("deltas"))
        write_commit(spark, folder("commits"), totals, counted.get["rows"], started)

    def start(self, messages: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Run the stream. Without an ``interval`` it takes what is there now and stops."""
        configure(messages.sparkSession)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return (
            decode(messages, self.decoder).writeStream.foreachBatch(self.write_batch)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )


def start_noop(messages: DataFrame, checkpoint: str, decoder: str = "versioned") -> StreamingQuery:
    """Decode and discard: the ceiling of source and decoder."""
    configure(messages.sparkSession)
    return (
        decode(messages, decoder).writeStream.format("noop")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_lake(messages: DataFrame, root: str, checkpoint: str, decoder: str = "versioned", on_bad: str = "dlq",
               run: str = "lake") -> StreamingQuery:
    """Append valid events to the lake, at least once; the lake deduplicates on read.

    Rejected messages follow ``on_bad`` as in ``Ingest``: ``dlq`` keeps them in ``dead_letters`` beside the lake's events,
    ``skip`` only counts them, ``fail`` stops before anything of the batch is appended. Each batch leaves a commit with its
    counts, read with ``store.commits`` and ``store.dead_letters``; ``run`` is bound to its checkpoint as in ``Ingest``.
    """
    if on_bad not in POLICIES:
        raise ValueError(f"unknown policy {on_bad!r}, expected one of {POLICIES}")
    configure(messages.sparkSession)

    def append(batch: DataFrame, folder: Callable[[str], str]) -> None:
        started = time.perf_counter()
        totals = totals_of(batch)
        if on_bad == "fail" and totals["bad"]:
            stop_at_bad(batch)
        if on_bad == "dlq" and totals["bad"]:
            write_dead_letters(batch, folder("dead_letters"))
        lake.append_events(batch.where(F.col("reason").isNull()), root)
        write_commit(batch.sparkSession, folder("commits"), totals, totals["good"], started)

    def write(batch: DataFrame, batch_id: int) -> None:
        until_committed(batch, root, run, batch_id, lambda now, folder: append(batch, folder))

    return (
        decode(messages, decoder).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class ProgressLog(StreamingQueryListener):
    """Keeps the last progress of each query: rows, duration, and how far the source is behind."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.latest[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        known = [lag for lag in map(self._behind, progress.sources) if lag is not None]
        self.latest[str(progress.id)] = {
            "batch_id": progress.batchId, "rows": progress.numInputRows,
            "rows_per_second": progress.processedRowsPerSecond, "lag": sum(known) if known else None,
        }

    @staticmethod
    def _behind(source) -> int | None:
        """Messages that a source has not read, over all partitions of all its topics; else as its metrics estimate."""
        try:
            ends, latest = json.loads(source.endOffset), json.loads(source.latestOffset)
            return sum(max(0, n - ends.get(topic, {}).get(part, 0)) for topic, parts in latest.items() for part, n in parts.items())
        except (TypeError, ValueError, AttributeError):
            value = source.metrics.get("maxOffsetsBehindLatest")
            return None if value is None else int(value)

    def onQueryTerminated(self, event) -> None:
        self.latest.pop(str(event.id), None)
