"""Index of stored event ids: sorted files in folders by a prefix of the id's hash, each with a Bloom filter.

Each fold of the store adds one version with the ids of the batches it merges, together with the later ones of the versions
before that are not much larger, so that an id is rewritten a logarithmic number of times and few versions are alive. A lookup
names the prefixes of the ids it asks for; only their folders are listed and read. A short list of ids is also pushed
down to the files, whose statistics and Bloom filters say which of them to open.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.logs import or_empty
from tideline.tables import INT, TEXT, schema

PREFIXES = 64
IDS_PER_FILE = 4_000_000
#: a version is merged with those after it unless it has more than so many times their ids
GROWTH = 2
_IDS = schema(event_id=TEXT)


def prefix(event_id: str | Column = "event_id") -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(PREFIXES)).cast("int")


def _versions(spark: SparkSession, root: str, versions: list[int], prefixes: list[int] | None) -> DataFrame:
    wanted = schema(event_id=TEXT, prefix=INT)
    found = spark.createDataFrame([], wanted)
    folders = "*" if prefixes is None else "{" + ",".join(map(str, prefixes)) + "}"
    for version in versions:
        base = f"{root}/ids/version={version}"
        found = found.unionByName(or_empty(
            spark, wanted, lambda base=base: spark.read.schema(wanted).option("basePath", base).parquet(f"{base}/prefix={folders}")))
    return found


def lookup(spark: SparkSession, root: str, versions: list[list[int]], prefixes: list[int] | None = None) -> DataFrame:
    """Indexed ids (``event_id``), only those of the folders of some prefixes."""
    if prefixes is not None and not prefixes:
        return spark.createDataFrame([], _IDS)
    return _versions(spark, root, [version for version, _ in versions], prefixes).select("event_id")


def add(spark: SparkSession, root: str, versions: list[list[int]], ids: DataFrame) -> list[list[int]]:
    """Write a version with ``ids`` and what it takes over; returns the versions (with their numbers of ids) alive then."""
    rows, alive = ids.count(), list(versions)
    taken = []
    while alive and alive[-1][1] <= GROWTH * rows:
        version, n = alive.pop()
        taken.append([version, n])
        rows += n
    if not rows:
        return versions
    new = uuid.uuid4().int >> 66
    every = ids.select("event_id").unionByName(lookup(spark, root, taken)).withColumn("prefix", prefix())
    order = ["prefix", "event_id"]
    (
        every.repartitionByRange(max(1, -(-rows // IDS_PER_FILE)), *order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("prefix").option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#event_id", "true")
        .option("parquet.bloom.filter.expected.ndv#event_id", str(min(IDS_PER_FILE, max(1000, 2 * rows // PREFIXES))))
        .parquet(f"{root}/ids/version={new}")
    )
    return [*alive, [new, rows]]
