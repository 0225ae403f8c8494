"""The event lake: Parquet partitioned by UTC day, written at least once, deduplicated on read or by compaction.

Compaction writes the days that have new files into a folder of its own, ``compacted/version=V/dt=D``, and then creates the
next note in ``snapshots``: for each day the version that holds it, the files it was made of (their number and a digest of
their names) and its rows. Readers take the last note, so they see all of a compaction or nothing of it, and days without
new files are not touched again. Of two compactions at once the one whose note comes second starts again from the other's.
Versions that no snapshot names are deleted by ``clean``.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import fixed_values as fixed
from tideline.functions.columns import event_day
from tideline.operators.dedupe import one_per_event
from tideline.session import configure
from tideline.sources import claims
from tideline.tables import EVENT_COLUMNS, LAKE_EVENTS

#: one task sorts the rows of one file, about 0.2 GB of memory (8,000,000 rows took over 1 GB)
ROWS_PER_FILE = 1_000_000


def _folder(root: str, compacted: bool) -> str:
    return f"{root.rstrip('/')}/{'compacted' if compacted else 'events'}"


def append_events(events: DataFrame, root: str) -> None:
    """Append events to the day folders of the lake, each day in few files; a large day is dealt to several tasks."""
    configure(events.sparkSession)
    (
        events.select(*EVENT_COLUMNS, event_day(F.col("event_ts")).alias("dt")).hint("rebalance", "dt")
        .write.mode("append").partitionBy("dt").option("compression", "zstd").parquet(_folder(root, False))
    )


def read_events(
    spark: SparkSession, root: str, compacted: bool = False, dedupe: bool = True, where: Column | None = None
) -> DataFrame:
    """Events of the lake; with ``compacted`` those of its last snapshot.

    ``where`` is a filter on event columns.  It is applied before the dedupe: copies of an event are equal,
    so the result is the same, and the filter reaches the scan.  Add a ``dt`` range when time is bounded.
    """
    if compacted:
        root = root.rstrip("/")
        days = snapshot(spark, root)["days"]
        folders = [f"{_folder(root, True)}/version={day['version']}/dt={dt}" for dt, day in days.items() if day["after"]]
        events = spark.read.schema(LAKE_EVENTS).option("basePath", _folder(root, True)).parquet(*folders or [_folder(root, True)])
        events = events.select(*LAKE_EVENTS.fieldNames())
    else:
        events = spark.read.schema(LAKE_EVENTS).parquet(_folder(root, False))
    if where is not None:
        events = events.where(where)
    return one_per_event(events) if dedupe else events


def snapshot(spark: SparkSession, root: str) -> dict:
    """The last note: its number, and for each day ``version``, ``files``, ``names``, ``before``, ``after``, ``written``."""
    root = root.rstrip("/")
    found = claims.names(spark, f"{root}/snapshots")
    return claims.read(spark, f"{root}/snapshots/{found[-1]}") if found else {"number": 0, "days": {}}


def _files_by_day(events: DataFrame) -> dict[str, list[str]]:
    """The files that ``events`` reads, as its plan lists them, by the day of their folder."""
    days: dict[str, list[str]] = {}
    for path in sorted(events.inputFiles()):
        days.setdefault(re.search(r"/dt=([^/]+)/", path)[1], []).append(path)
    return days


def _digest(files: list[str]) -> str:
    return hashlib.blake2b("\n".join(map(posixpath.basename, files)).encode(), digest_size=16).hexdigest()


def compact(
    spark: SparkSession, root: str, rows_per_file: int = ROWS_PER_FILE, days: tuple[str, str] | None = None
) -> dict:
    """Bring the compacted copy of the lake (or of the days between two dates) up to date; days without new files stay.

    A day is deduplicated on its own. Rows are dealt to files by range over (day, product, time, id): a day becomes as many
    files as its rows need, so a day or a product of any share is split, and files of a day do not overlap in product. The
    source files stay.

    Returns rows and files of the days asked for, those that stayed included, and the days that were rewritten. Ids are
    counted over the rewritten days together, and in each day that stayed.
    """
    started, root = time.perf_counter(), root.rstrip("/")
    while True:
        last = snapshot(spark, root)
        raw = read_events(spark, root, dedupe=False)
        found = {dt: files for dt, files in _files_by_day(raw).items() if days is None or days[0] <= dt <= days[1]}
        names = {dt: _digest(files) for dt, files in found.items()}
        dirty = sorted(dt for dt in found if last["days"].get(dt, {}).get("names") != names[dt])
        ids, fresh = _rewrite(spark, root, raw.where(F.col("dt").isin(dirty)), rows_per_file) if dirty else (0, {})
        for dt in dirty:
            fresh[dt] = {"after": 0, "before": 0, "written": 0, "version": 0} | fresh.get(dt, {}) | {"files": len(found[dt]), "names": names[dt]}
        every = last["days"] | fresh
        if not dirty or claims.create(spark, f"{root}/snapshots/{claims.number(last['number'] + 1)}", {"number": last["number"] + 1, "days": every}):
            break
    seen = [every[dt] for dt in found]
    return {
        "rows_before": sum(day["before"] for day in seen),
        "distinct_before": ids + sum(every[dt]["after"] for dt in found if dt not in dirty),
        "rows_after": sum(day["after"] for day in seen), "files_before": sum(day["files"] for day in seen),
        "files_after": sum(day["written"] for day in seen), "days": dirty, "seconds": time.perf_counter() - started,
    }


def _rewrite(spark: SparkSession, root: str, raw: DataFrame, rows_per_file: int) -> tuple[int, dict[str, dict]]:
    """Write days as a new version; the number of different ids, and what the version holds of each day."""
    version = uuid.uuid4().int >> 66
    parts = max(1, -(-raw.count() // rows_per_file))  # from the files' footers
    order = ["dt", "product_id", "event_ts", "event_id"]
    rest = [name for name in EVENT_COLUMNS if name != "event_id"]
    # copies are counted where they are dropped, so that the report needs no pass of its own
    kept = raw.groupBy("dt", "event_id").agg(F.first(F.struct(*rest)).alias("row"), F.count("*").alias("copies"))
    kept = kept.select("dt", "event_id", *[F.col(f"row.{name}").alias(name) for name in rest], "copies")
    folder = f"{_folder(root, True)}/version={version}"
    (
        kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*EVENT_COLUMNS, "copies", "dt")
        .write.partitionBy("dt").option("compression", "zstd")
        .option("parquet.block.row.count.limit", str(fixed.ROW_GROUP_ROWS))
        # files are sorted by product, so statistics skip most row groups for a product; Bloom filters those it could be in
        .option("parquet.bloom.filter.enabled#product_id", "true")
        .option("parquet.bloom.filter.expected.ndv#product_id", str(fixed.ROW_GROUP_ROWS)).parquet(folder)
    )
    written = spark.read.parquet(folder)
    files = {dt: len(paths) for dt, paths in _files_by_day(written).items()}
    counts = written.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.sum("copies").alias("before"), F.count("*").alias("after"))
    found = {row["dt"]: {"version": version, "before": row["before"], "after": row["after"], "written": files[row["dt"]]} for row in counts.collect()}
    # ids of several days: a day holds each once, so only a lake of more days has to compare them
    ids = written.select("event_id").distinct().count() if len(found) > 1 else sum(day["after"] for day in found.values())
    return ids, found


def clean(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete versions that the last ``keep`` snapshots do not name. Only while no compaction runs: it has no note yet."""
    root = root.rstrip("/")
    notes = [claims.read(spark, f"{root}/snapshots/{name}") for name in claims.names(spark, f"{root}/snapshots")[-keep:]]
    alive = {day["version"] for note in notes for day in note["days"].values()}
    there = [int(name.partition("=")[2]) for name in claims.names(spark, _folder(root, True)) if name.startswith("version=")]
    gone = [version for version in there if version not in alive]
    for version in gone:
        claims.remove(spark, f"{_folder(root, True)}/version={version}")
    return gone


def compaction_counts(raw: DataFrame) -> DataFrame:
    """Rows, distinct ids and rows after a compaction by day, in one row and without writing."""
    per_day = raw.groupBy("dt", "event_id").agg(F.count("*").alias("copies"))
    per_id = per_day.groupBy("event_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("days"))
    zero = F.lit(0).cast("bigint")
    return per_id.agg(
        F.coalesce(F.sum("copies"), zero).alias("rows_before"),
        F.count("*").alias("distinct_before"),
        F.coalesce(F.sum("days"), zero).alias("rows_after"),
    )
