"""Long word sequences that a smaller document holds: a De Bruijn graph of repeated windows, compacted to paths.

A window of ``size`` words is an edge between two nodes of one word less. A path whose inner nodes have one way in and one
way out in every document is held as a whole by each document that holds any of it, so one row stands for all its windows.

Documents are dealt once, by a hash of their id, to small groups that stay as they are for all steps (one exchange of
texts, used again by each); what passes between groups is packed arrays of hashes, each value once per group, so a passage
that a third of all documents hold costs one value per group.

1. Each window has a smallest hashed run of ``ANCHOR`` words. Anchors that two documents hold make their windows
   candidates: equal windows have equal anchors, so none is lost. About one word in five is an anchor.
2. Candidate windows are the edges. Each group sends its nodes with the word before and after; a node with two different
   ones anywhere, or where a sequence of candidates starts or ends, is a break.
3. Sequences of candidates are cut at breaks: the compacted paths. Equal paths (two independent 64-bit hashes over all their
   words) meet in a Spark join that gives the smallest document of each.
4. The words that such paths cover in larger documents are removed, by the places that each group sent along with its paths.

Collisions of the short hashes of steps 1 and 2 only make more candidates and breaks. A null text has no words. Rows with a
null id keep all words and count for nothing; rows that repeat under one id are one document; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import partitions, text_bytes, with_row

SIZE = 13
ANCHOR = 5
GROUP_BYTES = 16 << 20
BUCKET_BYTES = 64 << 20

_U = np.uint64
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CONFLICT = np.uint32(0xFFFFFFFF)
_REPLY = "group int, kind int, codes binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.uint64:
    return _U(pow(base, n, 1 << 64))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as the longest document so far needs them."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, _U), np.ones(1, _U)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << n.bit_length()
            self.tables = [np.cumprod(np.r_[_U(1), np.full(size - 1, base, _U)]) for base in self.bases]
        return self.tables


_POWERS = {base: _Powers(base) for base in (_BASE, _OTHER)}


class Words:
    """The words of one document and the hashes of its runs of words."""

    def __init__(self, text: bytes, size: int, bits: int):
        self.words, self.size, self.bits = text.split(), size, bits
        self.n = max(0, len(self.words) - size + 1)
        if self.n:
            self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), _U, len(self.words))

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` words, from runs of powers of two."""
        part, width, done, total = self.hash, 1, 0, None
        while True:
            if k & width:
                if total is None:
                    total, done = part, width
                else:
                    total = total[:len(total) - width] * _power(_BASE, width) + part[done:done + len(total) - width]
                    done += width
            if 2 * width > k:
                return total
            part = part[:-width] * _power(_BASE, width) + part[width:]
            width *= 2

    def _short(self, x: np.ndarray) -> np.ndarray:
        """``bits`` bits for the bucket and 32 within it."""
        return _mix(x) >> _U(32 - self.bits)

    def anchors(self) -> np.ndarray:
        """For each window the smallest hash of its runs of ``ANCHOR`` words, shortened."""
        low, width, span = _mix(self.runs(min(ANCHOR, self.size))), 1, self.size - min(ANCHOR, self.size) + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if rest := span - width:
            low = np.minimum(low[:-rest], low[rest:])
        return low >> _U(32 - self.bits)

    def nodes(self, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes beside candidate windows, with the word before and after; 0 where there is no candidate on that side."""
        into, out = np.r_[False, candidate], np.r_[candidate, False]
        at = np.flatnonzero(into | out)
        label = (self.hash >> _U(32)).astype(np.uint32) >> np.uint32(1) | np.uint32(1)
        before = np.where(into[at], label[at - 1], np.uint32(0))
        after = np.where(out[at], label[np.minimum(at + self.size - 1, len(label) - 1)], np.uint32(0))
        return self._short(self.runs(self.size - 1)[at]), before, after

    def paths(self, candidate: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each compacted path and two hashes over all its words."""
        node = self._short(self.runs(self.size - 1)[:-1])
        joined = np.r_[False, candidate[:-1]] & candidate & ~_within(node, breaks)
        first = np.flatnonzero(candidate & ~joined)
        last = np.flatnonzero(candidate & ~np.r_[joined[1:], False])
        hashes = []
        for base, words in ((_BASE, self.hash), (_OTHER, _mix(self.hash + _U(_OTHER)))):
            power, inverse = _POWERS[base].upto(len(words) + 1)
            total = np.r_[_U(0), np.cumsum(words * power[:len(words)])]
            hashes.append(_mix((total[last + self.size] - total[first]) * inverse[first] + (last - first).astype(_U)))
        return first, last, hashes[0].view(np.int64), hashes[1].view(np.int64)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), np.bool_)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _buckets(codes: np.ndarray):
    """Bucket, start and end of each bucket in sorted codes."""
    bucket = (codes >> _U(32)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)], strict=True):
        if end > start:
            yield int(bucket[start]), start, end


def _low(codes: np.ndarray) -> bytes:
    return (codes & _U(0xFFFFFFFF)).astype("<u4").tobytes()


def _documents(table: pa.Table):
    for batch in table.to_batches():
        for i, (key, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            yield i, key, text


def _replies(table: pa.Table, kind: int) -> np.ndarray:
    """The sorted codes of a kind that the group was told."""
    told = [np.frombuffer(codes, "<u8") for k, codes in zip(table.column("kind").to_pylist(), table.column("codes").to_pylist(),
                                                           strict=True) if k == kind]
    return np.sort(np.concatenate(told)) if told else np.zeros(0, _U)


#: where a document, named by its id and the checksum of its text, holds a path: its first window and its last
_SPAN = np.dtype([("doc", "<i8"), ("text", "<u4"), ("first", "<u4"), ("last", "<u4")])


def _lost(table: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """By document, the spans of paths that a smaller document holds."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for spans, first in zip(table.column("codes").to_pylist(), table.column("first").to_pylist(), strict=True):
        spans = np.frombuffer(spans, _SPAN)
        for doc, text, start, end in spans[spans["doc"] > first].tolist():
            found.setdefault((doc, text), []).append((start, end))
    return found


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _send_anchors(size, bits):
    schema = "bucket int, group int, codes binary, again binary"

    def send(table: pa.Table) -> pa.Table:
        found = []
        for _, key, text in _documents(table):
            words = Words(text, size, bits)
            if words.n and key is not None:
                found.append(np.unique(words.anchors()))
        group = table.column("group")[0].as_py()
        codes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, int))
        rows = [(b, group, _low(codes[s:e]), _low(codes[s:e][counts[s:e] > 1])) for b, s, e in _buckets(codes)]
        return _table(schema, *(zip(*rows, strict=True) if rows else [()] * 4))

    return send, schema


def _tell(groups, arrays, keep, bucket, kind) -> pa.Table:
    """To each group those of its own codes that are kept, with their bucket."""
    rows = []
    for group, own in zip(groups, arrays, strict=True):
        if len(hit := own[_within(own, keep)]):
            rows.append((group, kind, (hit.astype(_U) | _U(bucket << 32)).astype("<u8").tobytes()))
    return _table(_REPLY, *(zip(*rows, strict=True) if rows else [()] * 3))


def _repeated_anchors(table: pa.Table) -> pa.Table:
    arrays = [np.frombuffer(x, "<u4") for x in table.column("codes").to_pylist()]
    again = [np.frombuffer(x, "<u4") for x in table.column("again").to_pylist()]
    codes, counts = np.unique(np.concatenate(arrays), return_counts=True)
    keep = np.union1d(codes[counts > 1], np.concatenate(again))
    return _tell(table.column("group").to_pylist(), arrays, keep, table.column("bucket")[0].as_py(), 1)


def _merge_nodes(node, before, after):
    """Each node once, sorted, and whether its words before or after differ."""
    order = np.argsort(node, kind="stable")
    node, before, after = node[order], before[order], after[order]
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    differ = np.zeros(len(start), np.bool_)
    for label in (before, after):
        differ |= np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
    return node[start], before[start], after[start], differ


def _send_nodes(size, bits):
    schema = "bucket int, group int, codes binary, before binary, after binary"

    def send(key, table: pa.Table, told: pa.Table) -> pa.Table:
        known, found = _replies(told, 1), []
        for _, own, text in _documents(table):
            words = Words(text, size, bits)
            if words.n and own is not None and len(known):
                candidate = _within(words.anchors(), known)
                if candidate.any():
                    found.append(words.nodes(candidate))
        rows = []
        if found:
            node, before, after, differ = _merge_nodes(*[np.concatenate(x) for x in zip(*found, strict=True)])
            before = np.where(differ, _CONFLICT, before)
            rows = [(b, key[0].as_py(), _low(node[s:e]), before[s:e].astype("<u4").tobytes(), after[s:e].astype("<u4").tobytes())
                    for b, s, e in _buckets(node)]
        return _table(schema, *(zip(*rows, strict=True) if rows else [()] * 5))

    return send, schema


def _breaks(table: pa.Table) -> pa.Table:
    arrays, before, after = ([np.frombuffer(x, "<u4") for x in table.column(name).to_pylist()]
                             for name in ("codes", "before", "after"))
    codes, labels = np.concatenate(arrays), np.concatenate(before)
    node, _, _, differ = _merge_nodes(codes, labels, np.concatenate(after))
    keep = np.union1d(node[differ], codes[labels == _CONFLICT])
    return _tell(table.column("group").to_pylist(), arrays, keep, table.column("bucket")[0].as_py(), 2)


def _send_paths(size, bits):
    schema = "group int, high long, low long, doc long, last_doc long, spans binary"

    def send(key, table: pa.Table, told: pa.Table) -> pa.Table:
        """Each path of the group once, with its smallest and largest document, and where all of them hold it."""
        known, breaks, found = _replies(told, 1), _replies(told, 2), []
        for _, own, text in _documents(table):
            words = Words(text, size, bits)
            if words.n and own is not None and len(known):
                candidate = _within(words.anchors(), known)
                if candidate.any():
                    first, last, high, low = words.paths(candidate, breaks)
                    span = np.empty(len(first), _SPAN)
                    span["doc"], span["text"], span["first"], span["last"] = own, zlib.crc32(text), first, last
                    found.append((high, low, span))
        if not found:
            return _table(schema, *[()] * 6)
        high, low, span = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((span["first"], span["doc"], low, high))
        high, low, span = high[order], low[order], span[order]
        start = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        end = np.r_[start[1:], len(span)]
        packed = span.tobytes()
        spans = [packed[a * _SPAN.itemsize:b * _SPAN.itemsize] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return _table(schema, np.full(len(start), key[0].as_py(), np.int32), high[start], low[start], span["doc"][start],
                      span["doc"][end - 1], spans)

    return send, schema


def _remove(size, row_type):
    def apply(key, table: pa.Table, told: pa.Table) -> pa.Table:
        lost = _lost(told)
        kept, n_words, n_removed = [], [], []
        for _, own, text in _documents(table):
            words = stay = text.split()
            if spans := lost.get((own, zlib.crc32(text))):
                gone = np.zeros(len(words) + 1, np.int64)
                for first, last in spans:
                    gone[first] += 1
                    gone[last + size] -= 1
                stay = [word for word, out in zip(words, (np.cumsum(gone[:-1]) > 0).tolist(), strict=True) if not out]
            kept.append(b" ".join(stay))
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
        return pa.table([table.column("row"), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64()),
                         pa.array(n_removed, pa.int64())], names=["row", "kept", "n_words", "n_removed"])

    return apply, f"row {row_type}, kept binary, n_words long, n_removed long"


def _deal(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """Rows dealt to groups of about ``GROUP_BYTES``, and the bits that name a bucket of hashes."""
    rows = with_row(df, id=F.col(id_column).cast("long"), text=text_bytes(text_column))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions(df.sparkSession)
    groups = max(4 * tasks, math.ceil(n_bytes / GROUP_BYTES))
    bits = min(30, max(3, math.ceil(math.log2(max(1, n_bytes / BUCKET_BYTES)))))
    # rows without an id are dealt by their text
    group = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(groups)).cast("int")
    return rows.withColumn("group", group).repartition(tasks, "group"), bits


def _steps(dealt: DataFrame, size: int, bits: int) -> DataFrame:
    """For each group the paths that a smaller document than one of its own holds, and where its documents hold them."""
    texts = dealt.groupBy("group")

    def with_told(told, step):
        function, schema = step
        return texts.cogroup(told.groupBy("group")).applyInArrow(function, schema)

    function, schema = _send_anchors(size, bits)
    told = texts.applyInArrow(function, schema).groupBy("bucket").applyInArrow(_repeated_anchors, _REPLY)
    nodes = with_told(told, _send_nodes(size, bits))
    told = told.unionByName(nodes.groupBy("bucket").applyInArrow(_breaks, _REPLY))
    # dealt once, for the first document of each path and for the join with it: both sides name all columns, none of them null,
    # so that Spark sees one exchange and finds the paths in one pass over the texts
    send, schema = _send_paths(size, bits)
    paths = with_told(told, (send, ", ".join(f"{field} not null" for field in schema.split(", "))))
    paths = paths.repartition(partitions(dealt.sparkSession), "high", "low")
    first = paths.groupBy("high", "low").agg(F.min("doc").alias("first"), F.max("last_doc").alias("last"),
                                             F.max("group").alias("in"), F.max(F.octet_length("spans")).alias("bytes"))
    first = first.where("first < last and in >= 0 and bytes > 0").select("high", "low", "first")
    met = paths.join(first, ["high", "low"]).where("last_doc > first and doc >= first")
    return met.select("group", F.col("spans").alias("codes"), "first")


def dedup(df: DataFrame, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` as ``row``, with ``kept`` (the words that stay, joined by a space), ``n_words``, ``n_removed``."""
    dealt, bits = _deal(df, id_column, text_column)
    lost = _steps(dealt, size, bits)
    function, schema = _remove(size, dealt.schema["row"].dataType.simpleString())
    return dealt.groupBy("group").cogroup(lost.groupBy("group")).applyInArrow(function, schema)


def digest_rows(df: DataFrame) -> DataFrame:
    """``dedup`` with the digest of the kept words in place of the words."""
    kept = dedup(df.select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2("kept", 256).alias("kept_sha256"))
