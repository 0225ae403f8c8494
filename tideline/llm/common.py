"""Helpers that several operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import pinned

__all__ = ["arrow_map", "digests", "packed_texts", "partitions", "pinned", "text_bytes", "unpack", "with_row"]


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(name: str | Column = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    column = F.col(name) if isinstance(name, str) else name
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row``, beside columns under names of our own: nothing of the input can clash."""
    return df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias("row"),
                     *[column.alias(name) for name, column in columns.items()])


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str,
              most_bytes: int = 16 << 20, done: Callable[[], None] | None = None) -> DataFrame:
    """``function`` over each Arrow batch, cut so small that very long texts do not fill a worker.

    ``done`` is called after a task's last batch. Workers outlive tasks, so what one stage holds would be missing in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = part = None
        for batch in batches:
            for part in slices(batch, most_bytes):
                yield from function(part)
        if done and batch is not None:
            done()
        del batch, part
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` each; a single longer row stays whole."""
    parts = max(1, min(batch.num_rows, -(-batch.nbytes // most_bytes)))
    size = max(1, -(-batch.num_rows // parts))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def packed_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its column ``text`` (bytes) packed, so that dealing texts moves less than half of them."""
    place, names = df.columns.index(text), df.columns
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)

    def shrink(batch):
        pack = zstandard.ZstdCompressor(level=1).compress
        columns = list(batch.columns)
        columns[place] = pa.array([pack(x) for x in columns[place].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(df, shrink, kinds)


def unpack(column: pa.Array) -> Iterator[bytes]:
    """The texts of a packed column."""
    return map(zstandard.ZstdDecompressor().decompress, column.to_pylist())


def digests(keys: Iterable[bytes]):
    """128-bit digests of byte strings as an array of two signed 64-bit columns."""
    import numpy as np

    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(key, digest_size=16).digest() for key in keys]), dtype="<i8").reshape(-1, 2)
