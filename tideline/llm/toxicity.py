"""Toxic texts by two Kneser-Ney models, one for each label, that share their backoff counts.

A model predicts a word alone, whatever words are around it, with the counts of its own label, discounted, and backs off to the
shared count of the word. It also predicts each letter from the four before it in its word, again by its own label's counts, and backs off to shared
counts of both labels: in how many different surroundings the letter was seen after two letters, and after none. So a rare
word weighs nothing by being rare, and an unseen form of a toxic stem still weighs by its stem.

A text's measures are per word: the mean difference of both log-likelihoods, and the mean of what single words have beyond
``CLEAR``, so that chance in a thousand ordinary words doesn't drown a few clear ones. A logistic curve turns them into a
score between 0 and 1.

Counts come from all labelled rows of the training folds and are gathered by shuffle, word by word. The models are hashed
tables of ``BUCKETS`` entries, whose size is fixed, so they can be sent to all tasks; grams that share a bucket add up.
The curve is fitted on at most ``SAMPLE`` labelled rows that the counts leave out, from fold 0; of a kind of label that these
lack, or hold all of, a quarter of its rows is taken from all folds, one at least. Only a kind's single row is counted as well.
Texts are scored where they are read.

A null or empty text, or one without words, holds nothing toxic: its score is the share of toxic labels, but half of
``THRESHOLD`` at most, so that it is not rejected for what other texts are. A label that is null is no label; if a document has two,
the larger holds. Without labels of both kinds every other score is that share (0 without labels). Rows that repeat are judged
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import arrow_map, packed_texts, pinned, text_bytes, unpack, with_row

ORDER = 5
DISCOUNT = 0.75
BITS = 20
BUCKETS = 1 << BITS
SAMPLE = 20_000
THRESHOLD = 0.3
CLEAR = 2.0
#: words of no evidence that each text is given, so that a few words alone do not decide
WEIGHT = 3
CACHED = 1 << 17
#: words that are judged at once, so that the arrays over their letters stay small
WORDS = 1 << 13
TEXT_BYTES = 1 << 20
START, END = "\x02", "\x03"
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡*_-–—"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def word_of(chunk: str) -> str:
    return chunk.strip(EDGES).lower()


def _code(x: np.ndarray, role: int) -> np.ndarray:
    """Well mixed 64-bit codes, other ones for each role; the leading bits are the bucket."""
    x = x + _U(role * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Grams:
    """The codes of words and of the letters in them, for many words at once."""

    def __init__(self, words: list[str]):
        edge = START * (ORDER - 1)
        letters = np.frombuffer("".join(edge + word + END for word in words).encode("utf-32-le", "replace"), "<u4").astype(_U)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.counts = sizes + 1
        self.first = np.r_[0, np.cumsum(self.counts)[:-1]]
        begin = np.r_[0, np.cumsum(sizes + ORDER)[:-1]]
        at = np.repeat(begin - self.first, self.counts) + np.arange(self.counts.sum())
        part = [letters[at + i] for i in range(ORDER)]
        two = part[2] * _BASE + part[3]
        four = (part[0] * _BASE + part[1]) * _BASE * _BASE + two
        self.gram, self.context = _code(four * _BASE + part[4], 0), _code(four, 1)
        self.tail, self.after, self.letter = _code(two * _BASE + part[4], 2), _code(two, 3), _code(part[4], 4)
        place = np.arange(self.counts.sum()) - np.repeat(self.first, self.counts)
        powers = np.cumprod(np.r_[_U(1), np.full(int(self.counts.max(initial=1)), _BASE, _U)])
        self.word = _code(np.add.reduceat(part[4] * powers[place], self.first), 5) if len(words) else np.zeros(0, _U)


class Model:
    """The hashed counts, and the curve from measures to score."""

    def __init__(self, tables: dict[str, np.ndarray], totals: dict[str, float], share: float):
        self.tables, self.totals, self.share = tables, totals, share
        self.weights: np.ndarray | None = None
        self.known: dict[str, int] = {}
        self.measures = np.zeros((0, 6))

    def __getstate__(self):
        """Packed: the tables are mostly zeros, and each executor keeps a copy on its disk."""
        pack = zstandard.ZstdCompressor(level=3).compress
        return self.__dict__ | {"known": {}, "measures": np.zeros((0, 6)),
                                "tables": {name: pack(table.tobytes()) for name, table in self.tables.items()}}

    def __setstate__(self, state):
        unpacked = zstandard.ZstdDecompressor().decompress
        self.__dict__ = state | {"tables": {name: np.frombuffer(unpacked(table), np.float32)
                                            for name, table in state["tables"].items()}}

    def of_words(self, words: list[str]) -> np.ndarray:
        """For each word: difference by words, by letters, each beyond ``CLEAR``, their sum beyond it, and 1."""
        grams, t, n = Grams(words), self.tables, self.totals

        def at(name, code):
            return t[name][(code >> _U(64 - BITS)).astype(np.int64)].astype(np.float64)

        def ratio(up, down, otherwise):
            return np.where(down > 0, up / np.where(down > 0, down, 1.0), otherwise)

        toxic, plain = at("word_toxic", grams.word), at("word_plain", grams.word)
        shared = (toxic + plain) / max(1.0, n["toxic"] + n["plain"])
        likely = [(np.maximum(c - DISCOUNT, 0) + DISCOUNT * n[f"kinds_{k}"] * shared) / max(1.0, n[k])
                  for k, c in (("toxic", toxic), ("plain", plain))]
        by_word = np.where(shared > 0, np.log(np.maximum(likely[0], 1e-300)) - np.log(np.maximum(likely[1], 1e-300)), 0.0)

        kinds = max(1.0, n["letters"])
        one = (np.maximum(at("letter", grams.letter) - DISCOUNT, 0) + DISCOUNT * kinds / (kinds + 1)) / max(1.0, n["tails"])
        three = ratio(np.maximum(at("tail", grams.tail) - DISCOUNT, 0) + DISCOUNT * at("after_kinds", grams.after) * one,
                      at("after", grams.after), one)
        likely, seen = [], False
        for k in ("toxic", "plain"):
            count = at(f"context_{k}", grams.context)
            lead = np.maximum(at(f"gram_{k}", grams.gram) - DISCOUNT, 0)
            likely.append(ratio(lead + DISCOUNT * at(f"kinds_{k}", grams.context) * three, count, three))
            seen = seen | (count > 0)
        each = np.where(seen, np.log(np.maximum(likely[0], 1e-12)) - np.log(np.maximum(likely[1], 1e-12)), 0.0)
        by_letter = np.add.reduceat(each, grams.first) if len(words) else each
        return np.c_[by_word, by_letter, np.maximum(by_word - CLEAR, 0), np.maximum(by_letter - CLEAR, 0),
                     np.maximum(by_word + by_letter - CLEAR, 0), np.ones(len(words))]

    def _learn_chunks(self, chunks: set[str]) -> None:
        if len(self.known) + len(chunks) > CACHED:
            self.known, self.measures = {}, np.zeros((0, 6))
        new = list(chunks.difference(self.known))
        words = [word_of(chunk) for chunk in new]
        names = {word: i for i, word in enumerate(dict.fromkeys(filter(None, words)))}
        every = list(names)
        found = np.vstack([*[self.of_words(every[i:i + WORDS]) for i in range(0, len(every), WORDS)], np.zeros((1, 6))])
        base = len(self.measures)
        self.measures = np.vstack([self.measures, found[[names.get(word, -1) for word in words]]])
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def of_texts(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """The measures of each text; None for a text without words."""
        split = [text.decode("utf-8", "replace").split() for text in texts]
        missing = set().union(*split) if split else set()
        if not missing <= self.known.keys():
            self._learn_chunks(missing)
        found = []
        for chunks in split:
            total = self.measures[np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
            found.append(total[:5] / (total[5] + WEIGHT) if total[5] else None)
        return found

    def scores(self, texts: list[bytes]) -> list[float]:
        none = min(self.share, THRESHOLD / 2)
        if self.weights is None:
            return [self.share if any(map(word_of, text.decode("utf-8", "replace").split())) else none for text in texts]
        own = self.of_texts(texts)
        return [none if x is None else
                float(1 / (1 + np.exp(-np.clip(x @ self.weights[:5] + self.weights[5], -40, 40)))) for x in own]


def fold(id_column: str = "doc_id"):
    """The fold of a row by its id; rows of fold 2 are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _counted(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``word`` with its counts ``toxic`` and ``plain`` over all labelled texts. Texts are packed before they are dealt."""

    def count(batch):
        counts = (Counter(), Counter())
        for text, label in zip(unpack(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[label].update(text.decode("utf-8", "replace").split())
        merged: dict[str, list[int]] = {}
        for place, own in ((0, counts[1]), (1, counts[0])):
            for chunk, n in own.items():
                if word := word_of(chunk):
                    merged.setdefault(word, [0, 0])[place] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(merged), pa.string()), *[pa.array([x[i] for x in merged.values()], pa.int64()) for i in (0, 1)]],
            ["word", "toxic", "plain"])

    # by sort and merge whatever the sizes: labels grow with the texts, so sending them to all tasks only works for a while
    learned = packed_texts(texts).join(labels.hint("merge"), F.col("id") == F.col("of")).select("text", "label")
    rows = arrow_map(learned, count, "word string, toxic long, plain long", TEXT_BYTES)
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _gathered(words: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Hashed counts of both models and of the shared backoff, and their totals."""
    words = pinned(words)

    def codes(batch):
        grams = Grams(batch.column(0).to_pylist())
        gram, first, inverse = np.unique(grams.gram, return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, weights=np.repeat(batch.column(i).to_numpy(), grams.counts), minlength=len(gram))
                for i in (1, 2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64)) for x in (gram, grams.context[first], grams.tail[first], grams.after[first],
                                                  grams.letter[first])] + [pa.array(x.astype(np.int64)) for x in sums],
            ["gram", "context", "tail", "after", "letter", "toxic", "plain"])

    def word_codes(batch):
        yield pa.RecordBatch.from_arrays([pa.array(Grams(batch.column(0).to_pylist()).word.view(np.int64)), batch.column(1),
                                          batch.column(2)], ["gram", "a", "b"])

    grams = arrow_map(words, codes, "gram long, context long, tail long, after long, letter long, toxic long, plain long",
                      TEXT_BYTES)
    grams = pinned(grams.groupBy("gram").agg(*[F.max(x).alias(x) for x in ("context", "tail", "after", "letter")],
                                             F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")))
    tails = pinned(grams.groupBy("tail").agg(F.count("*").alias("n"), F.max("after").alias("after"),
                                             F.max("letter").alias("letter")))
    none = F.lit(0).cast("long")
    plus = [F.count_if(F.col(x) > 0).alias(y) for x, y in (("toxic", "c"), ("plain", "d"))]
    parts = (
        grams.select("gram", F.col("toxic").alias("a"), F.col("plain").alias("b"), none.alias("c"), none.alias("d")),
        grams.groupBy("context").agg(F.sum("toxic").alias("a"), F.sum("plain").alias("b"), *plus),
        tails.select("tail", F.col("n").alias("a"), none.alias("b"), none.alias("c"), none.alias("d")),
        tails.groupBy("after").agg(F.sum("n").alias("a"), F.count("*").alias("b"), none.alias("c"), none.alias("d")),
        tails.groupBy("letter").agg(F.count("*").alias("a"), none.alias("b"), none.alias("c"), none.alias("d")),
        arrow_map(words, word_codes, "gram long, a long, b long", TEXT_BYTES).select("*", none.alias("c"), none.alias("d")),
    )
    found = None
    for role, part in enumerate(parts):
        own = part.toDF("code", "a", "b", "c", "d").select(
            F.lit(role).alias("role"), F.shiftrightunsigned("code", 64 - BITS).cast("int").alias("bucket"), "a", "b", "c", "d")
        found = own if found is None else found.unionByName(own)
    summed = found.groupBy("role", "bucket").agg(*[F.sum(x).cast("float").alias(x) for x in "abcd"]).toArrow()
    role, place = (summed.column(name).to_numpy() for name in ("role", "bucket"))
    names = (("gram_toxic", "gram_plain"), ("context_toxic", "context_plain", "kinds_toxic", "kinds_plain"), ("tail",),
             ("after", "after_kinds"), ("letter",), ("word_toxic", "word_plain"))
    tables = {}
    for own, columns in enumerate(names):
        for name, x in zip(columns, "abcd", strict=False):
            tables[name] = np.zeros(BUCKETS, np.float32)
            tables[name][place[role == own]] = summed.column(x).to_numpy()[role == own]
    row = words.agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"),
                    F.count_if(F.col("toxic") > 0).alias("kinds_toxic"), F.count_if(F.col("plain") > 0).alias("kinds_plain"))
    more = tails.agg(F.count("*").alias("tails"), F.countDistinct("letter").alias("letters"))
    totals = row.first().asDict() | more.first().asDict()
    return tables, {name: float(value or 0) for name, value in totals.items()}


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a logistic curve, by Newton steps with a little shrinkage."""
    middle, width = x.mean(axis=0), x.std(axis=0) + 1e-12
    design, shrink = np.c_[(x - middle) / width, np.ones(len(x))], np.r_[np.full(x.shape[1], 0.3), 1e-6]
    w = np.zeros(len(shrink))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(shrink),
                               design.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[w[:-1] / width, w[-1] - (w[:-1] * middle / width).sum()]


def _sampled(own: DataFrame, n: dict[int, int]) -> DataFrame:
    """At most ``SAMPLE`` labelled rows for the curve, of both kinds."""
    sample = pinned(own.where(fold("of") == 0).orderBy(F.xxhash64("of"), "of").limit(SAMPLE))
    taken = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    for kind in n:
        if taken.get(kind, 0) in (0, n[kind]):
            more = min(-(-n[kind] // 4), SAMPLE // 2)
            added = own.where(F.col("label") == kind).orderBy(F.xxhash64("of"), "of").limit(more)
            others = sample.where(F.col("label") != kind).orderBy(F.xxhash64("of"), "of").limit(SAMPLE - more)
            sample = pinned(others.unionByName(added))
    return sample


def learn(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic") -> Model:
    """A model from the labelled rows of ``df`` whose fold is not 2."""
    own = labels.select(F.col(id_column).cast("long").alias("of"), F.col(label_column).cast("int").alias("label"))
    own = own.where("of is not null and label in (0, 1)").groupBy("of").agg(F.max("label").alias("label"))
    own = pinned(own.where(fold("of") != 2))
    n = {row["label"]: row["count"] for row in own.groupBy("label").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model({}, {}, share)
    texts = df.select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("text")).where(fold("id") != 2)
    # at most SAMPLE rows of 16 bytes, so it may be sent to all tasks
    sample = _sampled(own, n)
    single = [kind for kind in n if n[kind] == 1]
    rest = own.join(F.broadcast(sample.where(~F.col("label").isin(single)).select("of")), "of", "left_anti")
    model = Model(*_gathered(_counted(texts, rest)), share)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measured(batch):
        found = [(x.tolist(), label) for x, label in zip(shared.value.of_texts(batch.column(0).to_pylist()),
                                                        batch.column(1).to_pylist(), strict=True) if x is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())),
                                          pa.array([label for _, label in found], pa.int32())], ["x", "label"])

    held = texts.join(F.broadcast(sample), F.col("id") == F.col("of")).select("text", "label")
    points = arrow_map(held, measured, "x array<double>, label int", TEXT_BYTES).toArrow()
    shared.destroy()
    y = points.column("label").to_numpy()
    if len(set(y.tolist())) == 2:
        model.weights = _curve(np.array(points.column("x").to_pylist()), y)
    return model


def score(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` as ``row``, with their ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batch):
        found = shared.value.scores(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    rows = with_row(df, text=text_bytes(text_column))
    return arrow_map(rows, judge, f"row {rows.schema['row'].dataType.simpleString()}, score double", TEXT_BYTES)


def digest_rows(df: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(df.select("doc_id", "text"), learn(df, labels))
    return scored.select(F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id") == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
