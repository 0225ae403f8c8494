"""Lines that repeat across documents: two Bloom filters name suspects, only suspects are confirmed by shuffle.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least ``least`` code points
that at least two documents hold loses all its lines, except in the smallest document that holds it.

1. The filters grow with the data, so they are never one object: the hash of a key names a block of 4 KiB, and each block
   is a row of a table. Tasks send each key once per batch to the task of its block; that task fills the block's filter of
   keys seen once, and a key found there already goes to the filter of keys seen twice.
2. Lines meet the "seen twice" block of their hash in a join that tests the bits; a hot line makes one partition of
   that join large, and Spark splits it. What fails the test is unique and goes no further.
3. Suspects are confirmed by 128-bit digests: smallest and largest document of each digest. Real repeats give each document
   its list of digests to drop.

Rows with a null id keep all their lines and count for nothing; a null or empty text is one empty line; rows that repeat
under one id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import arrow_map, digests, pinned, text_bytes, with_row

LEAST = 10
BLOCK_BITS = 1 << 15
KEYS_PER_BLOCK = 2048
PROBES = 4


def keys_of(text: bytes) -> list[bytes]:
    """The key of each line. ``bytes`` lower-cases and strips ASCII alone, as wanted."""
    return [line.strip() for line in text.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(batch: pa.RecordBatch, least: int):
    """Digests of the keys of each document, each once, and the id of each."""
    keys, ids = [], []
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        own = {k for k in keys_of(text) if long_enough(k, least)}
        keys.extend(own)
        ids.extend([key] * len(own))
    return digests(keys), ids


def blocks(n_lines: int) -> int:
    """Bits of the hash that name a block."""
    return max(0, math.ceil(math.log2(max(1, n_lines) / KEYS_PER_BLOCK)))


def _block_of(high: np.ndarray, bits: int) -> np.ndarray:
    return (high.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(high), np.int32)


def seen_twice(texts: DataFrame, bits: int, least: int = LEAST) -> DataFrame:
    """The filter of keys that two documents hold: ``block`` and its bits as an array of longs."""

    def once_per_batch(batch):
        found, ids = _hashes(batch, least)
        found = found[[x is not None for x in ids]] if len(found) else found
        key, first, counts = np.unique(found[:, 1], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_block_of(np.ascontiguousarray(found[first, 0]), bits)), pa.array(key), pa.array(counts > 1)],
            ["block", "low", "again"])

    def fill(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            block, low, again = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(block, kind="stable")
            block, low, again = block[order], low[order], again[order]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                key, inverse, counts = np.unique(low[start:end], return_inverse=True, return_counts=True)
                flagged = np.bincount(inverse, weights=again[start:end], minlength=len(key)) > 0
                word, bit = _places(key)
                own = int(block[start])
                if own not in once:
                    once[own], twice[own] = np.zeros((2, BLOCK_BITS // 64), np.uint64)
                met = ((once[own][word] & bit) != 0).all(axis=1)
                repeated = met | flagged | (counts > 1)
                np.bitwise_or.at(once[own], word, bit)
                np.bitwise_or.at(twice[own], word[repeated], bit[repeated])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(twice), pa.int32()),
             pa.array([x.view(np.int64) for x in twice.values()], pa.list_(pa.int64()))], ["block", "bits"])

    rows = arrow_map(texts, once_per_batch, "block int, low long, again boolean")
    return rows.repartition("block").mapInArrow(fill, "block int, bits array<long>")


def _places(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the words of its block that hold its bits, and those bits."""
    place = (low.view(np.uint64)[:, None] >> np.arange(0, 16 * PROBES, 16, dtype=np.uint64)) & np.uint64(BLOCK_BITS - 1)
    return (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))


def suspects(texts: DataFrame, bits: int, least: int = LEAST) -> DataFrame:
    """Digests of the lines of each document whose bits are all set in the filter of keys seen twice."""

    def once_per_document(batch):
        found, ids = _hashes(batch, least)
        high, low = np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(_block_of(high, bits)), pa.array(high), pa.array(low)],
            ["id", "block", "high", "low"])

    lines = arrow_map(texts, once_per_document, "id long, block int, high long, low long").where("id is not null")
    twice = seen_twice(texts, bits, least).toDF("own_block", "own_bits")
    met = F.col("block") == F.col("own_block")
    for i in range(PROBES):
        place = F.shiftrightunsigned("low", 16 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        met &= F.getbit(F.col("own_bits")[F.shiftright(place, 6)], place.bitwiseAND(F.lit(63))) == 1
    return lines.join(twice, met, "left_semi").select("id", "high", "low")


def dropped_keys(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``id`` and ``drop``, the digests of the keys whose lines that document loses; documents that lose none are absent."""
    breaks = F.length(F.col("text")) - F.length(F.replace(F.col("text").cast("string"), F.lit("\n")).cast("binary"))
    n_lines = texts.agg(F.sum(breaks + 1)).first()[0] or 0
    found = pinned(suspects(texts, blocks(n_lines), least))
    holders = found.groupBy("high", "low").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # written out, so that both sides of the join are dealt anew and Spark can split a line that very many documents hold
    repeats = pinned(holders.where("first < last").select("high", "low", "first"))
    lost = found.join(repeats, ["high", "low"]).where("id > first")
    return lost.groupBy("id").agg(F.collect_list(F.struct("high", "low")).alias("drop"))


def dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` as ``row``, with ``kept`` (text without its repeated lines), ``n_lines`` and ``n_dropped``."""
    rows = with_row(df, id=F.col(id_column).cast("long"), text=text_bytes(text_column))
    drops = dropped_keys(rows.select("id", "text"), least)
    joined = rows.join(drops.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("row", "text", "drop")

    def apply(batch):
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.split(b"\n")
            stay = lines
            if drop:
                gone = {(x["high"], x["low"]) for x in drop}
                keys = keys_of(text)
                stay = [line for line, digest in zip(lines, map(tuple, digests(keys).tolist()), strict=True)
                        if digest not in gone]
            kept.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            ["row", "kept", "n_lines", "n_dropped"])

    kind = rows.schema["row"].dataType.simpleString()
    return arrow_map(joined, apply, f"row {kind}, kept binary, n_lines long, n_dropped long")


def digest_rows(df: DataFrame, **options) -> DataFrame:
    """``dedup`` with the digest of the kept text in place of the text."""
    kept = dedup(df.select("doc_id", "text"), **options)
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2(F.col("kept"), 256).alias("kept_sha256"))
