"""Token sequences of fixed size, filled by best-fit decreasing.

A document's ids (and one end id) are cut into full windows and a rest. Full windows are sequences of their own. Rests are
dealt evenly to groups, sorted by falling length within their group, and each goes to the open window with the least room
that still holds it. A segment tree over the remaining room (0 to ``size``) finds that window in a few steps; its leaves
count open windows, so memory follows the open windows of one group, never the corpus.

The number of groups follows the shuffle partitions that the cluster is set to. Placement depends on the sorted rows of the
group alone, so a task that runs again gives the same sequences. A null text is an empty text (one end id); a null id packs
like any other; rows that repeat are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import arrow_map, partitions, text_bytes

SIZE = 2048
END_ID = 1
CACHED = 1 << 18

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _merger(path: str):
    """An encoder from the ranks of the same vocabulary, if they lie beside it: equal ids in a sixth of the time."""
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks_path):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The split before the merges never joins what a single space between two visible characters parts, so such chunks are
    encoded once and remembered; the new ones of a text in one call. Chunks of Latin letters get their ids from the ranks of
    the vocabulary where these lie beside it; all others, whose letter classes depend on a library's Unicode tables, and
    those that may hold a special token go through the tokenizer itself. Tests compare both.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        special = {i: token.content for i, token in self._tokenizer.get_added_tokens_decoder().items()}
        self._rare = re.compile("|".join(map(re.escape, special.values())) or r"(?!)")
        self._merger = _merger(path)
        if self._merger is not None:
            tokens = [self._merger.decode_single_token_bytes(i) if i not in special else b"" for i in range(self._merger.n_vocab)]
            self._spaced = np.array([token.startswith(b" ") for token in tokens])
        self.forget()

    def forget(self) -> None:
        """Drop the remembered chunks: they are most of what an encoder holds."""
        self._known: dict[str, bytes | None] = {}
        self._before: dict[str, bytes | None] = {}

    def _ids(self, text: str) -> bytes:
        return _bytes(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, text: str) -> bytes:
        return _bytes(self._merger.encode_ordinary(text)) if self._plain(text) else self._ids(text)

    def _plain(self, text: str) -> bool:
        """Whether the ranks give its ids: Latin letters only, and no special token."""
        return self._merger is not None and (text.isascii() or max(text) <= "\u024f") and not self._rare.search(text)

    def _uneven(self, text: str) -> bytes:
        """Cut only at single spaces between two visible characters."""
        head, *chunks = text.split(" ")
        parts = [[head]]
        for chunk in chunks:
            before = parts[-1][-1]
            if before and not before[-1].isspace() and chunk and not chunk[0].isspace():
                parts.append([])
            parts[-1] += [" ", chunk] if chunk else [" "]
        return b"".join([self._chunk("".join(part)) for part in parts])

    def _learn(self, chunks: list[str]) -> None:
        """Remember the chunks of a text. What has not been met for a while goes: two generations of ``CACHED`` chunks stay."""
        if len(self._known) > CACHED:
            self._known, self._before = {}, self._known
        known, before, new = self._known, self._before, []
        for chunk in set(chunks).difference(known):
            if chunk in before:
                known[chunk] = before[chunk]
            elif chunk and not chunk[0].isspace() and not chunk[-1].isspace():
                new.append(chunk)
            else:
                known[chunk] = None
        joined = " " + " ".join(new)
        if new and self._plain(joined):
            # one call for all: exactly the first token of each chunk begins with its space
            ids = np.array(self._merger.encode_ordinary(joined), dtype="<u4")
            cuts = [*(4 * np.flatnonzero(self._spaced[ids])).tolist(), 4 * len(ids)]
            packed = ids.tobytes()
            known.update(zip(new, [packed[start:end] for start, end in zip(cuts, cuts[1:])], strict=True))
        else:
            known.update((chunk, self._chunk(" " + chunk)) for chunk in new)

    def encode(self, text: str) -> bytes:
        head, *chunks = text.split(" ")
        if not chunks:
            return self._chunk(text) if text else b""
        last = chunks.pop()
        if not head or head[-1].isspace() or not last or last[0].isspace():
            return self._uneven(text)
        try:
            found = b"".join(map(self._known.__getitem__, chunks))
        except (KeyError, TypeError):  # new chunks, or one beside an uneven blank
            self._learn(chunks)
            each = [self._known[chunk] for chunk in chunks]
            if None in each:
                return self._uneven(text)
            found = b"".join(each)
        return b"".join([self._chunk(head), found, self._chunk(" " + last)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """Open windows by remaining room: a segment tree whose leaves hold stacks of windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = True
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and that room."""
        i = need + self.leaves
        if not self.tree[i]:
            # up to the first right neighbour that holds a window, then down its left side
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.at[room].pop()
        if not self.at[room]:
            self.tree[i] = False
            i >>= 1
            while i:
                self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]
                i >>= 1
        return window, room


def pieces(df: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None, id_column: str = "doc_id",
           text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Full windows and rests of each document, with their ids as little-endian unsigned 32-bit bytes."""
    source = path or vocabulary()
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * size

    def cut(batch):
        encode, rows = encoder(source).encode, []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text.decode("utf-8", "replace")) + end
            for start in range(0, len(ids), width):
                part = ids[start:start + width]
                rows.append((key, start // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if with_ids else None))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    return arrow_map(texts, cut, _PIECES, done=lambda: encoder(source).forget())


def pack(cut: DataFrame, size: int = SIZE, groups: int | None = None) -> DataFrame:
    """``sequence_id`` and ``offset`` for each piece; sequences are numbered by group and order."""
    n, names = groups or partitions(cut.sparkSession), cut.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).cast("int")
    dealt = (cut.withColumn("group", group).repartition(n, "group")
             .sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids_crc32"))

    def place(batches):
        group, opened, count = None, None, 0
        for batch in batches:
            ids, offsets = [], []
            for own, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != group:
                    group, opened, count = own, Windows(size), 0
                got = opened.take(length) if length < size else None
                if got is None:
                    got, count = (count, size), count + 1
                window, room = got
                if room > length:
                    opened.put(room - length, window)
                ids.append((own << 40) + window)
                offsets.append(size - room)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids in order, padded to ``size`` unless their number is a power of two."""
    rows = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"), F.sum("length").alias("tokens"))

    def build(batch):
        found = []
        for parts, tokens in zip(batch.column("parts").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            ids = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4")
            short = 0 if tokens & (tokens - 1) == 0 else size - tokens
            found.append(np.r_[ids, np.full(short, pad_id, dtype="<u4")].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("tokens"),
                                          pa.array(found, pa.list_(pa.int32()))], ["sequence_id", "tokens", "ids"])

    return arrow_map(rows, build, "sequence_id long, tokens long, ids array<int>")


def digest_rows(df: DataFrame) -> DataFrame:
    """Where each piece lies, without its ids."""
    cut = pieces(df, with_ids=False).drop("ids")
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
