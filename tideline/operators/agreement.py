"""Do two results hold the same rows?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(result: DataFrame, digits: int = 2) -> DataFrame:
    """Floating-point and decimal columns rounded, so that formatting does not count."""
    kinds = (T.DoubleType, T.FloatType, T.DecimalType)
    return result.select(*[
        F.round(F.col(f.name).cast("double"), digits).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name)
        for f in result.schema.fields
    ])


def with_rank(result: DataFrame, *order) -> DataFrame:
    """Make the order of a top-k report part of its rows. For results that a limit keeps small."""
    return result.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def agree(left: DataFrame, right: DataFrame, digits: int = 2) -> DataFrame:
    """One row: rows on both sides, rows without a partner, and whether the two are equal as bags."""
    names = left.columns
    signed = rounded(left, digits).withColumn("_side", F.lit(1).cast("bigint")).unionByName(
        rounded(right.select(*names), digits).withColumn("_side", F.lit(-1).cast("bigint"))
    )
    per_row = signed.groupBy(*names).agg(
        F.count_if(F.col("_side") > 0).alias("_left"), F.count_if(F.col("_side") < 0).alias("_right")
    )
    zero = F.lit(0).cast("bigint")
    return per_row.agg(
        F.coalesce(F.sum("_left"), zero).alias("left_rows"),
        F.coalesce(F.sum("_right"), zero).alias("right_rows"),
        F.coalesce(F.sum(F.abs(F.col("_left") - F.col("_right"))), zero).alias("different_rows"),
    ).withColumn("identical", F.col("different_rows") == 0)
