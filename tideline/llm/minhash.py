"""MinHash fingerprints: many universal hash permutations over word shingles, in numpy; bands and Jaccard for near copies.

A shingle is ``WORDS`` consecutive words, split at ASCII white space with A-Z in lower case (a shorter text is one shingle, a
text without words none). Each of ``HASHES`` permutations x -> a*x + b modulo 2^64, a odd, keeps its smallest value over all
shingles; 16 mixed bits of each are the fingerprint (its own leading bits are zero in long texts). The likeness of two fingerprints is the share of equal places; that of
two texts without words is 1.

``edited`` pairs each document with the next one by id. Texts are packed and dealt to id ranges once; the first document of a
range is dealt to the range before as well, so each range reads its documents in order and holds two at a time. The bounds
of the ranges are ids of documents (approximate percentiles), no more than shuffle partitions.

``similar_pairs`` joins bands of fingerprints, one row for equal sets of shingles, and verifies the Jaccard of what agrees.
``similar_links`` gives links enough to connect what is similar: the nodes of a band meet in one task, packed, which gives the
links of a spanning forest alone, by the shingles themselves. A band of very many shingles is cut into blocks, and each two
blocks meet in a task. So no pair is a row, and none that shares a band is left out.

A null text is an empty text. Rows with a null id have no next document: their last quarter is cut off. Rows that repeat
under one id follow each other, by their packed text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import arrow_map, packed_texts, partitions, pinned, slices, text_bytes, unpack

WORDS = 5
HASHES = 64
BANDS = 16
LIKE = 0.8
CHUNK = 1 << 12
#: shingles in a block of a band
BLOCK = 1 << 21

_U = np.uint64
_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(0, 1 << 63, HASHES, dtype=_U) * _U(2) + _U(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=_U)
_BASE = [_U(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in range(WORDS + 1)]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, len(found))
    size = min(words, len(found))
    n = len(hashes) - size + 1
    total = hashes[:n].copy()
    for i in range(1, size):
        total = total * _BASE[1] + hashes[i:i + n]
    total = (total ^ (total >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return total ^ (total >> _U(29))


def signature(text: bytes, words: int = WORDS) -> np.ndarray:
    """The fingerprint as ``HASHES`` numbers of 16 bits."""
    found, least = shingles(text, words), np.full(HASHES, np.iinfo(np.uint64).max, _U)
    for start in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[start:start + CHUNK, None] * _A + _B).min(axis=0))
    least = (least ^ (least >> _U(31))) * _U(0x94D049BB133111EB)
    return (least >> _U(48)).astype(">u2")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float((one == other).mean())


def signatures(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` in hex digits, four for each permutation."""

    def judge(batch):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([signature(x).tobytes().hex() for x in batch.column(1).to_pylist()], pa.string())],
            ["doc_id", "fingerprint"])

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    return arrow_map(texts, judge, "doc_id long, fingerprint string")


def _dealt(texts: DataFrame) -> DataFrame:
    """Packed texts in id ranges, in order; ``tail`` marks what only follows the range's last document."""
    n = partitions(texts.sparkSession)
    row = texts.agg(F.min("id").alias("least"), F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000)
                    .alias("bounds")).first()
    least = row["least"]
    bounds = np.array(sorted({x for x in row["bounds"] or () if x > least}), dtype=np.int64)

    def deal(batch):
        places, own, tail = [], [], []
        for i, (x, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            # rows without an id have ranges below 0, by their text
            place = -1 - zlib.crc32(packed) % n if x is None else int(np.searchsorted(bounds, x, "right"))
            places.append(i)
            own.append(place)
            tail.append(0)
            if x is not None and x == least or place > 0 and bounds[place - 1] == x:
                places.append(i)
                own.append(place - 1 if x != least else len(bounds))
                tail.append(1)
        found = batch.take(pa.array(places, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(tail, pa.int32()), *found.columns],
                                         ["range", "tail", "id", "text"])

    rows = arrow_map(packed_texts(texts), deal, "range int, tail int, id long, text binary")
    return rows.repartition(n, "range").sortWithinPartitions("range", "tail", "id", "text")


def edited(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and the likenesses to it and to the next document.

    The edited text has its last quarter of code points replaced by as many from the start of the next document, or all.
    """
    texts = df.select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # range, id, text, signature of the document that waits for its next
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                rows = []
                for place, tail, key, text in zip(*[batch.column(i).to_pylist() for i in range(3)], unpack(batch.column(3)),
                                                  strict=True):
                    if held is not None and held[0] != place:
                        held = None  # its next was in the range that has ended
                    own = None if tail and held is None else signature(text)
                    if held is not None:
                        rows.append(pair(held, text, own))
                    if place < 0:
                        rows.append(pair((place, key, text, own), b"", signature(b"")))
                    held = None if tail or place < 0 else (place, key, text, own)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(document, following, sign):
        _, key, text, own = document
        letters = text.decode("utf-8", "replace")
        cut = len(letters) // 4
        changed = (letters[:len(letters) - cut] + following.decode("utf-8", "replace")[:cut]).encode()
        other = signature(changed)
        return (key, len(letters), hashlib.sha256(changed).hexdigest(), own.tobytes().hex(), other.tobytes().hex(),
                likeness(own, other), likeness(own, sign))

    return _dealt(texts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")


def _representatives(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with an id, one node (with its fingerprint) for each set of shingles, and each document's representative."""
    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).where(
        "doc_id is not null")

    def judge(batch):
        own = batch.column(1).to_pylist()
        sets, sizes = [], []
        for x in own:
            found = np.unique(shingles(x))
            sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            sizes.append(len(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(x).tobytes().hex() for x in own], pa.string()),
                                          pa.array(sets, pa.binary()), pa.array(sizes, pa.int64())],
                                         ["doc_id", "fingerprint", "set", "size"])

    prints = pinned(arrow_map(texts, judge, "doc_id long, fingerprint string, set binary, size long"))
    nodes = pinned(prints.groupBy("set").agg(F.min("doc_id").alias("node"), F.first("fingerprint").alias("fingerprint"),
                                             F.first("size").alias("size")))
    members = prints.select("doc_id", "set").join(nodes, "set").select("doc_id", F.col("node").alias("representative"))
    return texts, nodes, members


def _node_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The packed text of each node."""
    packed = packed_texts(texts.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))
    return packed.groupBy("doc_id").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """``a``, ``b`` and the ``jaccard`` of their texts' shingles."""

    def verify(batch):
        found = []
        for one, two in zip(unpack(batch.column(2)), unpack(batch.column(3)), strict=True):
            x, y = np.unique(shingles(one)), np.unique(shingles(two))
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "jaccard"])

    sided = pairs.join(packed.toDF("a", "one"), "a").join(packed.toDF("b", "two"), "b").select("a", "b", "one", "two")
    return arrow_map(sided, verify, "a long, b long, jaccard double")


def similar_pairs(df: DataFrame, threshold: float = LIKE, bands: int = BANDS, id_column: str = "doc_id",
                  text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b``, ``jaccard`` of representatives, and ``doc_id`` with its ``representative``.

    Documents with equal sets of shingles have one representative, the smallest id. Two that agree in some band are compared
    in the join itself, in the first band they share; what is alike enough (less a margin of 0.15) is verified on its texts.
    """
    texts, nodes, members = _representatives(df, id_column, text_column)
    size = 4 * HASHES // bands
    cut = F.array(*[F.substring("fingerprint", 1 + i * size, size) for i in range(bands)])
    rows = nodes.select("node", "fingerprint", F.posexplode(cut).alias("band", "key"))
    other = rows.select(F.col("node").alias("b"), F.col("fingerprint").alias("other"), "band", "key")

    def part(text, i, width):
        return F.substring(text, i * width + 1, F.lit(width))

    places = F.sequence(F.lit(0), F.lit(HASHES - 1))
    alike = F.size(F.filter(places, lambda i: part(F.col("fingerprint"), i, 4) == part(F.col("other"), i, 4)))
    first = ~F.exists(F.filter(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: i < F.col("band")),
                      lambda i: part(F.col("fingerprint"), i, size) == part(F.col("other"), i, size))
    met = rows.join(other, ["band", "key"]).where((F.col("node") < F.col("b")) & first & (alike >= (threshold - 0.15) * HASHES))
    pairs = pinned(met.select(F.col("node").alias("a"), "b"))

    return _verified(pairs, _node_texts(texts, nodes)).where(F.col("jaccard") >= threshold), members


def similar_forest(sets: list[np.ndarray], threshold: float = LIKE) -> list[tuple[int, int, float]]:
    """Places (a, b) and the Jaccard of a spanning forest of the similar pairs. Each is compared with those not yet reached.

    What two sets share is counted at once for all: shingles of many sets as bits, those of few by their holders.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        jaccard = both / (int(sizes.sum()) - both) if sizes.any() else 1.0
        return [(0, 1, jaccard)] if jaccard >= threshold else []
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    many = held > max(1, n // 64)
    few = (held > 1) & ~many
    place, width = np.cumsum(many) - 1, -(-int(many.sum()) // 64)
    bits, step = np.zeros((n, width), _U), max(1, (1 << 18) // max(1, width))
    for start in range(0, n if width else 0, step):
        own = slice(ends[start] - sizes[start], ends[min(n, start + step) - 1])
        dense = np.zeros((min(n, start + step) - start, 64 * width), bool)
        row, marked = np.repeat(np.arange(len(dense)), sizes[start:start + step]), many[column[own]]
        dense[row[marked], place[column[own][marked]]] = True
        bits[start:start + step] = np.packbits(dense, axis=1).view(_U)
    kept = few[column]
    owners = np.repeat(np.arange(n), sizes)[kept]
    column = (np.cumsum(few) - 1)[column[kept]]
    holders, starts = owners[np.argsort(column, kind="stable")], np.r_[0, np.cumsum(held[few])]
    first = np.searchsorted(owners, np.arange(n + 1))

    def shared(node: int) -> np.ndarray:
        own = column[first[node]:first[node + 1]]
        sizes_ = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] + sizes_ - np.cumsum(sizes_), sizes_) + np.arange(sizes_.sum())
        return np.bincount(holders[at], minlength=n)

    links, left, rest = [], np.arange(n), bits
    while len(left):
        stack, left, rest = [int(left[0])], left[1:], rest[1:]
        while stack and len(left):
            node = stack.pop()
            both = np.bitwise_count(rest & bits[node]).sum(axis=1, dtype=np.int64) + shared(node)[left]
            union = sizes[left] + sizes[node] - both
            jaccard = np.where(union > 0, both / np.maximum(union, 1), 1.0)
            near = jaccard >= threshold
            if near.any():
                reached = left[near].tolist()
                links.extend((node, other, j) for other, j in zip(reached, jaccard[near].tolist(), strict=True))
                stack.extend(reached)
                left, rest = left[~near], rest[~near]
    return links


def similar_links(df: DataFrame, threshold: float = LIKE, bands: int = BANDS, id_column: str = "doc_id",
                  text_column: str = "text", most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a``, ``b``, ``jaccard`` of representatives, and ``doc_id`` with its ``representative``.

    Nodes that share a band are compared by their shingles, so that whatever is similar there is connected; a band gives fewer
    links than it has nodes, or than it has in each two blocks of about ``most`` shingles. Bands of the same nodes are
    compared once. All texts of a node that has several take part. Rows without an id take no part; an empty table gives no links.
    """
    texts, nodes, members = _representatives(df, id_column, text_column)
    size, at = 4 * HASHES // bands, ["band", "key"]
    cut = F.array(*[F.substring("fingerprint", 1 + i * size, size) for i in range(bands)])
    rows = nodes.select("node", "size", F.posexplode(cut).alias("band", "key"))
    sums = rows.groupBy(*at).agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("first"),
                                 *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"nodes{i}") for i in (1, 2)])
    met = sums.where("n > 1").groupBy("n", "total", "first", "nodes1", "nodes2").agg(F.min(F.struct(*at)).alias("one"))
    # written out, so that both sides of the join with it are dealt anew and a band of very many nodes can be split
    met = pinned(met.select("one.*", F.greatest(F.lit(1), F.ceil(F.col("total") / most)).cast("int").alias("blocks")))
    placed = rows.join(met, at).select(*at, "node", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own")))
    placed = pinned(placed.select(*at, "node", "own", F.explode(others).alias("other")).select(
        *at, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node"))
    packed = packed_texts(texts.join(placed.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    groups = [*at, "one", "two"]
    sided = placed.join(packed.distinct().toDF("node", "text"), "node").select(*groups, "node", "text")
    dealt = sided.repartition(partitions(df.sparkSession), *groups).sortWithinPartitions(*groups, "node")

    def run(batches):
        mark, own, sets, found = None, [], [], []

        def linked():
            if len(own) > 1:
                found.extend((min(own[a], own[b]), max(own[a], own[b]), jaccard)
                             for a, b, jaccard in similar_forest(sets, threshold) if own[a] != own[b])

        def told():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)],
                                              ["a", "b", "jaccard"])

        for whole in batches:
            for batch in slices(whole, 4 << 20):
                marks = zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)
                for group, node, text in zip(marks, batch.column(4).to_pylist(), unpack(batch.column(5)), strict=True):
                    if group != mark:
                        linked()
                        mark, own, sets = group, [], []
                    own.append(node)
                    sets.append(np.unique(shingles(text)))
                if found:
                    yield told()
                    found = []
        linked()
        if found:
            yield told()
        pa.default_memory_pool().release_unused()

    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return pinned(dealt.mapInArrow(run, "a long, b long, jaccard double")).distinct(), members


def digest_rows(df: DataFrame) -> DataFrame:
    return edited(df.select("doc_id", "text"))
