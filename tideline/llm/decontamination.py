"""Benchmark passages in training texts: spaced seeds find places, a comparison around each place decides.

A mask keeps six of eight neighbouring words and ignores the others. The two masks are chosen so that any ``WINDOW`` aligned
words with up to two substitutions hold a place where one of them ignores, or lies beside, every substitution. Hashes of the
kept words of each benchmark place and of each text place meet in a join; around a hit the words on both sides are compared,
and it counts if some ``WINDOW`` aligned words (or all words of a shorter item) agree but for a fifth.

Only columns and joins are used. Text places are tested against a bitmap of ``1 << BITS`` bits, filled from the benchmark,
before they become rows, so that few go on; its size is fixed, so it travels with the plan, and what it lets through wrongly
is dropped by the join. Spark decides how to join by the sizes it measures.

Words are runs of letters and digits, in lower case. A null text or item has no words; items of fewer words than a mask are
not searched. Rows with a null id are judged as one. Rows and items that repeat give one row per pair of ids. Empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 6, 7))
SPAN = 8
WINDOW = 13
TOLERATED = 0.2
BITS = 21


def _words(text: Column) -> Column:
    """Hashes of the words of a text."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(hashes, at + o) if o else F.get(hashes, at) for o in MASKS[mask]])


def _places(hashes: Column) -> Column:
    return F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN)).otherwise(
        F.array().cast("array<int>"))


def _near(hashes: Column, at: Column) -> Column:
    """The words of all windows that hold the seed at ``at``."""
    lead = F.least(at, F.lit(WINDOW - 1))
    return F.slice(hashes, at - lead + 1, lead + SPAN + WINDOW)


def _found(hashes: Column, keep) -> Column:
    """Seeds of all masks at all places that ``keep`` lets through, with the words around each."""

    def of(mask: int) -> Column:
        places = F.filter(_places(hashes), lambda i: keep(_seed(hashes, i, mask)))
        return F.transform(places, lambda i: F.struct(i.alias("at"), _seed(hashes, i, mask).alias("seed"),
                                                      _near(hashes, i).alias("near")))

    return F.concat(*[of(mask) for mask in range(len(MASKS))])


def _bitmap(seeds: DataFrame, bits: int) -> Column:
    """A bitmap of the seeds as an array of longs, at most ``1 << (bits - 6)`` of them."""
    place = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    words = seeds.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("set")).collect()
    filled = [0] * (1 << (bits - 6))
    for row in words:
        filled[row["word"]] = row["set"]
    return F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")


def _agree() -> Column:
    """Whether some window of both neighbourhoods agrees, each word but for the tolerated share."""
    lead, own = F.least("at", F.lit(WINDOW - 1)), F.least("item_at", F.lit(WINDOW - 1))
    both = F.least(lead, own)
    tail = F.least(F.size("near") - lead, F.size("item_near") - own)
    equal = F.transform(F.sequence(-both, tail - 1),
                        lambda r: (F.get("near", lead + r) == F.get("item_near", own + r)).cast("int"))
    width = F.least(F.col("item_words"), F.lit(WINDOW))
    need = width - F.floor(width * TOLERATED).cast("int")
    starts = F.when(both + tail >= width, F.sequence(F.lit(0), both + tail - width)).otherwise(F.array().cast("array<int>"))
    total = F.lit(0)
    return F.exists(starts, lambda s: F.aggregate(F.slice(equal, s + 1, width), total, lambda a, x: a + x) >= need)


def contaminated(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id``, ``item_id``, the number of seeds that were confirmed and the words (from 0) they lie between."""
    items = benchmark.select(F.col(item_column).alias("item_id"), _words(F.col(item_text)).alias("hashes"))
    items = items.select("item_id", F.size("hashes").alias("item_words"),
                         F.explode(_found(F.col("hashes"), lambda seed: seed.isNotNull())).alias("x"))
    items = items.select("item_id", "item_words", F.col("x.at").alias("item_at"), F.col("x.near").alias("item_near"),
                         F.col("x.seed").alias("seed"))
    bitmap = _bitmap(items.select("seed"), bits)

    def may_hit(seed: Column) -> Column:
        return F.getbit(F.get(bitmap, F.shiftright(seed.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int")),
                        seed.bitwiseAND(F.lit(63)).cast("int")) == 1

    texts = df.select(F.col(id_column).alias("doc_id"), _words(F.col(text_column)).alias("hashes"))
    hits = texts.select("doc_id", F.explode(_found(F.col("hashes"), may_hit)).alias("x"))
    hits = hits.select("doc_id", F.col("x.at").alias("at"), F.col("x.near").alias("near"), F.col("x.seed").alias("seed"))
    confirmed = hits.join(items, "seed").where(_agree())
    return confirmed.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_seeds"), F.min("at").cast("long").alias("first_word"),
        (F.max("at") + SPAN - 1).cast("long").alias("last_word"))
