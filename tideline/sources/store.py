"""The event store of the stream: every event once, and a rollup that matches, on plain Parquet folders.

Each micro-batch writes folders of its own attempt, in this order, and then claims the next number of the log:

``events/run=R/batch_id=N/attempt=A/dt=D``     events that were new
``dead_letters/run=R/batch_id=N/attempt=A``    messages that were rejected
``deltas/run=R/batch_id=N/attempt=A``          rollup of the new events by product, and by hour
``commits/run=R/batch_id=N/attempt=A``         one JSON row with counts
``log/V``                                      a note; from here on the attempt counts

A note is created by one writer only. Who finds the number taken looks at what the winner stored and starts again, so two runs,
or two processes that work on one batch, never both insert an id. An attempt without a note is invisible, and a batch with a
note is not written again. A run is bound to the id of its stream's checkpoint: a new checkpoint, whose batches count from 0
again, writes under a name of its own (``claims.bound_name``). ``fold`` merges the small files of many batches, adds their ids
to the index (``id_index``) and ends the list of attempts that readers have to name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.operators import rollup
from tideline.sources import claims, id_index
from tideline.sources.lake import ROWS_PER_FILE
from tideline.sources.logs import or_empty
from tideline.tables import DEAD_LETTERS, INT, LAKE_EVENTS, LONG, PRODUCT_STATS, REAL, TEXT, TIME, extended, schema

COMMITS = schema(committed_at=TIME, processed=LONG, inserted=LONG, dlq=LONG, sink_ms=REAL)
_STORED_LETTERS = extended(DEAD_LETTERS, diverted_at=TIME)
_STATS = extended(PRODUCT_STATS, hour_epoch=LONG)
_KEYS = ("product_id", "hour_epoch")
#: folders that a rollup base is dealt to by product
SHELVES = 32
_LOG = schema(version=LONG, run=TEXT, batch_id=LONG, attempt=TEXT)


def _read(spark: SparkSession, root: str, table: str, columns: StructType, kind: str = "parquet") -> DataFrame:
    wanted = extended(columns, run=TEXT, batch_id=LONG, attempt=TEXT)
    return or_empty(spark, wanted, lambda: spark.read.schema(wanted).format(kind).load(f"{root}/{table}"))


def batch_folder(root: str, table: str, run: str, batch_id: int) -> str:
    return f"{root}/{table}/run={run}/batch_id={batch_id}"


def _counting(spark: SparkSession, root: str, table: DataFrame) -> DataFrame:
    """Rows of attempts that have a note in the log."""
    log = or_empty(spark, _LOG, lambda: spark.read.schema(_LOG).json(f"{root}/log")).select("attempt")
    return table.join(log, "attempt", "left_semi").drop("attempt")


def commits(spark: SparkSession, root: str) -> DataFrame:
    return _counting(spark, root, _read(spark, root, "commits", COMMITS, "json"))


@dataclass(frozen=True)
class Progress:
    """The last fold (number, log version it ends with, what it holds) and the notes of the log after it."""

    fold: int = 0
    through: int = 0
    folded: dict[str, int] = field(default_factory=dict)
    events: list[int] = field(default_factory=list)
    rollup: int | None = None
    ids: list[list[int]] = field(default_factory=list)
    notes: tuple[dict, ...] = ()

    @property
    def committed(self) -> dict[str, int]:
        """The last batch of each run; a run commits its batches one after the other."""
        last = dict(self.folded)
        for note in self.notes:
            last[note["run"]] = max(note["batch_id"], last.get(note["run"], -1))
        return last

    @property
    def version(self) -> int:
        return self.notes[-1]["version"] if self.notes else self.through

    def has(self, run: str, batch_id: int) -> bool:
        return self.committed.get(run, -1) >= batch_id


def progress(spark: SparkSession, root: str) -> Progress:
    """Reads one note for the last fold and one for each batch after it, whatever the length of the history."""
    folds = claims.names(spark, f"{root}/folds")
    last = Progress(**claims.read(spark, f"{root}/folds/{folds[-1]}")) if folds else Progress()
    later = [name for name in claims.names(spark, f"{root}/log") if int(name) > last.through]
    notes = tuple(claims.read(spark, f"{root}/log/{name}") for name in later)
    return Progress(**{**vars(last), "notes": notes})


def _pending(spark: SparkSession, root: str, table: str, columns: StructType, now: Progress) -> DataFrame:
    """What the batches since the last fold wrote. Their folders are named, so no others are listed or read."""
    wanted = extended(columns, run=TEXT, batch_id=LONG, attempt=TEXT)
    folders = [f"{batch_folder(root, table, note['run'], note['batch_id'])}/attempt={note['attempt']}" for note in now.notes]
    if not folders:
        return spark.createDataFrame([], wanted).drop("attempt")
    return spark.read.schema(wanted).option("basePath", f"{root}/{table}").parquet(*folders).drop("attempt")


def commit(spark: SparkSession, root: str, now: Progress, run: str, batch_id: int, attempt: str) -> bool:
    """Make an attempt count that was made from ``now``. False if another commit came first."""
    version = now.version + 1
    note = {"version": version, "run": run, "batch_id": batch_id, "attempt": attempt}
    return claims.create(spark, f"{root}/log/{claims.number(version)}", note)


def _folded_events(spark: SparkSession, root: str, versions: list[int]) -> DataFrame:
    columns = extended(LAKE_EVENTS, run=TEXT, batch_id=LONG, version=LONG)
    parts = or_empty(spark, columns, lambda: spark.read.schema(columns).parquet(f"{root}/folded_events"))
    return parts.where(F.col("version").isin(versions) if versions else F.lit(False)).drop("version")


def _pending_events(spark: SparkSession, root: str, now: Progress) -> DataFrame:
    return _pending(spark, root, "events", LAKE_EVENTS, now)


def events(spark: SparkSession, root: str, now: Progress | None = None) -> DataFrame:
    """Stored events of committed batches, with run, batch_id and dt."""
    now = now or progress(spark, root)
    return _folded_events(spark, root, now.events).unionByName(_pending_events(spark, root, now))


def known_ids(spark: SparkSession, root: str, now: Progress, prefixes: list[int] | None = None) -> DataFrame:
    """Stored ids: those of the batches since the last fold, and those of the index with the given prefixes."""
    pending = _pending_events(spark, root, now).select("event_id")
    return pending.unionByName(id_index.lookup(spark, root, now.ids, prefixes))


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters of committed batches; ``dlq_offset`` orders the copies of a message over all runs."""
    letters = _counting(spark, root, _read(spark, root, "dead_letters", _STORED_LETTERS))
    return letters.withColumn("dlq_offset", F.struct("diverted_at", "run", "batch_id", "source_offset"))


def _stats(spark: SparkSession, root: str, now: Progress, merged: bool = True) -> DataFrame:
    """What the batches counted, by product and by hour; not ``merged``, the parts of the rollup."""
    parts = _pending(spark, root, "deltas", _STATS, now).select(*_STATS.fieldNames())
    if now.rollup is not None:
        parts = parts.unionByName(_base(spark, root, now))
    return rollup.add_up(parts, by=_KEYS) if merged else parts


def _base(spark: SparkSession, root: str, now: Progress, shelf: int | None = None) -> DataFrame:
    """The rollup as the last fold left it; of one ``shelf`` only that folder is listed and read."""
    base = f"{root}/rollup/version={now.rollup}"
    wanted, folder = extended(_STATS, shelf=INT), base if shelf is None else f"{base}/shelf={shelf}"
    return or_empty(spark, wanted, lambda: spark.read.schema(wanted).option("basePath", base).parquet(folder)).drop("shelf")


def _shelf() -> Column:
    return F.coalesce(F.pmod(F.xxhash64("product_id"), F.lit(SHELVES)).cast("int"), F.lit(-1))


def product_one(spark: SparkSession, root: str, product: int) -> DataFrame:
    """The rollup of one product, no row for an unknown one: reads a shelf of the base and the deltas after it."""
    now = progress(spark, root)
    one = (F.col("product_id") == product) & F.col("hour_epoch").isNull()
    parts = _pending(spark, root, "deltas", _STATS, now).select(*_STATS.fieldNames()).where(one)
    if now.rollup is not None:
        shelf = spark.range(1).select(F.lit(product).cast("int").alias("product_id")).select(_shelf().alias("n")).first()["n"]
        parts = parts.unionByName(_base(spark, root, now, shelf).where(one))
    return rollup.add_up(parts)


def _recounts(spark: SparkSession, root: str, now: Progress) -> DataFrame:
    """What a recount of the event files gives, in parts: of the folded ones as they were counted once, of the others now."""
    parts = rollup.product_stats(_pending_events(spark, root, now))
    if now.rollup is None:
        return parts
    return parts.unionByName(spark.read.schema(PRODUCT_STATS).parquet(f"{root}/recounts/version={now.rollup}"))


def product_stats(spark: SparkSession, root: str) -> DataFrame:
    """The rollup: the base of the last fold and the deltas of the batches after it."""
    return _stats(spark, root, progress(spark, root)).where("hour_epoch IS NULL").drop("hour_epoch")


def hourly_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events by hour and type as the stream keeps them. There is no watermark: a late event changes the hour it belongs to."""
    hours = _stats(spark, root, progress(spark, root)).where("hour_epoch IS NOT NULL")
    kinds = F.array(*[F.struct(F.lit(kind).alias("event_type"), F.col(f"{kind}_count").alias("n")) for kind in ("review", "search", "view")])
    return hours.select("hour_epoch", F.inline(kinds)).where("n > 0")


def fold(spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Merge what the batches since the last fold left in small files. Returns the number of folds.

    Their events go to larger files by day, sorted by product and time; their deltas go into a new rollup base, their ids into
    the index. Earlier folds are not rewritten. The note that says what is merged is written last and makes the fold count;
    if two folds run at once, one note is created and the other fold leaves no trace. The folders of merged batches are not
    read again and may be deleted; the log stays.
    """
    now = progress(spark, root)
    if not now.notes:
        return now.fold
    new = uuid.uuid4().int >> 66
    batches = _pending_events(spark, root, now)
    parts = max(1, -(-batches.count() // rows_per_file))
    order = ["dt", "product_id", "event_ts", "event_id"]
    (
        batches.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dt")
        .option("compression", "zstd").parquet(f"{root}/folded_events/version={new}")
    )
    shelved = _stats(spark, root, now).withColumn("shelf", _shelf())
    (
        shelved.repartition("shelf").sortWithinPartitions("shelf", "product_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shelf").parquet(f"{root}/rollup/version={new}")
    )
    # counted from the files that were just written, once: what a check compares the rollup with
    rollup.add_up(_recounts(spark, root, now)).write.mode("overwrite").parquet(f"{root}/recounts/version={new}")
    ids = id_index.add(spark, root, now.ids, batches.select("event_id"))
    note = {"fold": now.fold + 1, "through": now.version, "folded": now.committed, "events": [*now.events, new], "rollup": new, "ids": ids}
    claims.create(spark, f"{root}/folds/{claims.number(note['fold'])}", note)
    return note["fold"]


def ingest_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``metrics.ingest_windows`` takes: stored events, rejected messages and batches, each with its time.

    An event counts when its batch was committed. Batches whose commit was deleted after a fold are left out.
    """
    done = commits(spark, root).select("run", "batch_id", F.col("committed_at").alias("at"), F.col("sink_ms").alias("ms"))
    stored = events(spark, root).join(done, ["run", "batch_id"]).select("at", "event_ts")
    return stored, dead_letters(spark, root).select(F.col("diverted_at").alias("at")), done.select("at", "ms")


def validate(spark: SparkSession, root: str, full: bool = False) -> DataFrame:
    """Events, rollup total and products whose rollup does not match a recount.

    Event files are counted once: those of folded batches when they were folded, those of later batches now. Checksums
    of buckets of products are compared first, and only buckets that differ are counted again from all their events. ``full``
    counts all event files again.
    """
    now = progress(spark, root)
    stored = _stats(spark, root, now, merged=False).where("hour_epoch IS NULL").drop("hour_epoch")
    if full:
        return rollup.validation_summary(events(spark, root, now), rollup.add_up(stored))
    recounts = _recounts(spark, root, now)
    differ = [row["bucket"] for row in rollup.differing_buckets(recounts, stored).collect()]
    counted = F.col("review_count") + F.col("search_count") + F.col("view_count")

    def total(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.coalesce(F.sum(counted), F.lit(0)).cast("bigint").alias(name))

    wrong = spark.range(1).select(F.lit(0).cast("bigint").alias("mismatched_products"))
    if differ:
        own = rollup.bucket().isin(differ)
        wrong = rollup.mismatches(events(spark, root, now).where(own), rollup.add_up(stored).where(own)).agg(F.count("*").alias("mismatched_products"))
    return total(recounts, "events").crossJoin(total(stored, "stats_total")).crossJoin(wrong)
