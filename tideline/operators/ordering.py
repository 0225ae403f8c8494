"""Order-dependent operators that never sort one group, or the whole table, in one task.

Rows are cut by value: into stretches of an order column, or into magnitudes of what is ranked. Work inside a cut is local,
and one small row per cut goes further. Only ``dense_position`` numbers a whole table, and pins its numbering for that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tideline.session import pinned

#: parts that the values around an index are cut into, and how often
_CELLS, _REFINED = 4096, 2
_PART_SHIFT = 33  # monotonically_increasing_id() keeps the partition above this bit


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` sorted by ``order`` over all partitions, with ``_part`` and the 0-based ``_pos`` inside it.

    The borders come from a sample, so the numbering is pinned with a reliable checkpoint: every later
    use, and every recomputation after a lost executor, sees the same rows in the same place.
    ``order`` should tell all rows apart, otherwise rows that tie cannot be spread.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed.persist(StorageLevel.MEMORY_AND_DISK)  # a checkpoint counts and writes: both from one sort
    numbered = pinned(placed)
    placed.unpersist()
    return numbered.withColumns({
        "_part": F.shiftright("_row", _PART_SHIFT),
        "_pos": F.col("_row").bitwiseAND((1 << _PART_SHIFT) - 1),
    }).drop("_row")


def dense_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 1-based rank of each row in ``order``, dense over the whole table."""
    placed = in_order(df, order)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition of the sort, whatever the size of the table
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )


def with_next(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], width: float = 600.0) -> DataFrame:
    """Add ``next_<column>``: the value in the following row of the same group, null in its last row.

    The first column of ``order`` is a number. Rows meet in stretches of ``width`` of it, so a group of any share is spread
    over its length; what crosses from one stretch to the next is one row, its first.
    """
    group, rest = list(group), [c for c in columns if c not in order]
    row = F.struct(*order, *rest)
    cut = df.withColumn("_stretch", F.floor(F.col(order[0]) / F.lit(width)))
    heads = cut.groupBy(*group, "_stretch").agg(F.min(row).alias("_own"))
    heads = heads.withColumn("_head", F.lead("_own").over(Window.partitionBy(*group).orderBy("_stretch")))
    heads = heads.select(*[F.col(name).alias(f"_of_{name}") for name in group], F.col("_stretch").alias("_at"), "_head")
    inside = Window.partitionBy(*group, "_stretch").orderBy(*order, *rest)
    linked = cut.withColumn("_lead", F.lead(row).over(inside))
    same = F.col("_stretch").eqNullSafe(F.col("_at"))
    for name in group:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    following = F.coalesce("_lead", "_head")
    return linked.join(heads, same, "left").select(
        *df.columns, *[following[name].alias(f"next_{name}") for name in columns]
    )


def _magnitude(value: str) -> Column:
    """A whole number that does not fall where ``value`` rises; values within a quarter of a percent share one."""
    v = F.col(value).cast("double")

    def size(x: Column) -> Column:
        return F.floor(F.least(F.ln(x), F.lit(1000.0)) * 256) + 300_000

    return F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0).cast("bigint"))


def _cell(value: str) -> Column:
    """One of ``_CELLS`` equal parts between ``_low`` and ``_high`` that ``value`` falls in; does not fall where it rises."""
    v, low, high = (F.col(name).cast("double") for name in (value, "_low", "_high"))
    part = F.floor((v - low) / (high - low) * _CELLS)
    return F.when(high > low, F.least(part, F.lit(_CELLS - 1))).otherwise(F.lit(0)).cast("bigint")


def _chosen(rows: DataFrame, keys: list[str], value: str, places: Callable[[Column], Column]) -> DataFrame:
    """For each index that is looked for: the cell it is in, the index inside it, and the bounds of its values.

    One small row a cell is counted up in one window; ``places`` gives (name, index) pairs from the number of all values.
    """
    shares = rows.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_share"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = shares.withColumns({"_to": F.sum("_share").over(upto), "_total": F.sum("_share").over(whole)})
    shares = shares.withColumn("_before", F.col("_to") - F.col("_share")).withColumn("_place", F.explode(places(F.col("_total"))))
    return shares.where("_before <= _place.index and _place.index < _to").withColumn("_index", F.col("_place.index") - F.col("_before"))


def _narrowed(
    df: DataFrame, group: list[str], value: str, quantiles: dict[str, float | Callable[[Column], Column]]
) -> DataFrame:
    """The few values around each index: ``group``, ``_name``, value, ``_n`` (how often it comes) and ``_index`` among them."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n")).withColumn("_cell", _magnitude(value))

    def places(total: Column) -> Column:
        return F.array(*[F.struct(
            F.lit(name).alias("name"),
            (q(total) if callable(q) else F.least(total - 1, F.floor(F.lit(float(q)) * total))).cast("bigint").alias("index"),
        ) for name, q in quantiles.items()])

    found = _chosen(rows, group, value, places)
    found = found.select(*group, "_cell", F.col("_place.name").alias("_name"), "_index", "_low", "_high")
    rows = rows.join(found, [*group, "_cell"])
    for _ in range(_REFINED):
        rows = rows.withColumn("_cell", _cell(value)).drop("_low", "_high")
        # the index is the same in all rows of a name, so it is a key that costs nothing
        found = _chosen(rows, [*group, "_name", "_index"], value, lambda _: F.array(F.struct(F.col("_index").alias("index"))))
        found = found.select(*group, F.col("_name"), "_cell", (F.col("_place.index") - F.col("_before")).alias("_inside"), "_low", "_high")
        rows = rows.drop("_index").join(found, [*group, "_name", "_cell"]).withColumnRenamed("_inside", "_index")
    return rows


def nearest_rank(
    df: DataFrame, group: Sequence[str], value: str, quantiles: dict[str, float | Callable[[Column], Column]]
) -> DataFrame:
    """Exact percentiles per group: the sorted value at index ``min(n - 1, floor(q * n))``, or at that of a function of n.

    Equal values are counted before they travel. Counts per magnitude say in which magnitude an index lies; twice the values
    of that one are cut into 4,096 equal parts between the least and the largest of them, and counts say in which part the
    index lies. Only the values of the last part are ranked, so a group may hold any share of the rows, and its values may lie
    as close to each other as they want. Group columns must not be null.
    """
    group = list(group)
    inside = Window.partitionBy(*group, "_name").orderBy(value)
    ranked = _narrowed(df, group, value, quantiles).withColumn("_upto", F.sum("_n").over(inside))
    found = ranked.where("_upto - _n <= _index and _index < _upto")
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in quantiles])
