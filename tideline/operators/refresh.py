"""Refresh of the catalog dimensions. All of it is row-local, so a refresh is a scan and a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text


def refresh_shades(shades: DataFrame, now: Column | None = None) -> DataFrame:
    return shades.withColumns({
        "canonical_name": text.normalize_shade(F.col("raw_name")),
        "refreshed_at": F.current_timestamp() if now is None else now,
    })


def refresh_products(products: DataFrame, now: Column | None = None) -> DataFrame:
    return products.withColumns({
        "canonical_key": text.product_key(F.col("brand"), F.col("raw_name")),
        "refreshed_at": F.current_timestamp() if now is None else now,
    })


def product_ingredients(products: DataFrame) -> DataFrame:
    """One row per ingredient of a product, numbered from 0 in order of first mention."""
    names = text.split_ingredients(F.col("ingredients_text"))
    # the outer form, since the plain one would test the array for being empty, and so compute it twice
    return (
        products.where(F.col("ingredients_text") != "")
        .select("product_id", F.posexplode_outer(names).alias("position", "normalized"))
        .where(F.col("position").isNotNull())
    )


def duplicate_products(products: DataFrame) -> DataFrame:
    """Canonical keys of products that were entered more than once."""
    return (
        products.groupBy("canonical_key").agg(F.count("*").alias("entries")).where(F.col("entries") > 1)
    )


def refresh_report(shades: DataFrame, products: DataFrame, ingredients: DataFrame) -> DataFrame:
    """One row with the number of rows and of distinct results in each refreshed table."""
    none = F.lit(None)

    def share(df: DataFrame, table: str, column: str) -> DataFrame:
        # rows per distinct value first: a value that is very common is reduced before the shuffle
        per_value = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        sums = per_value.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
            F.count("value").alias("distinct_rows"),
        )
        return sums.select(F.lit(table).alias("table"), "rows", "distinct_rows")

    parts = (
        share(shades, "shades", "canonical_name")
        .unionByName(share(products, "products", "canonical_key"))
        .unionByName(share(ingredients, "ingredients", "normalized"))
    )

    def pick(table: str, column: str) -> Column:
        return F.max(F.when(F.col("table") == table, F.col(column)).otherwise(none))

    return parts.agg(
        pick("shades", "rows").alias("shades"),
        pick("shades", "distinct_rows").alias("distinct_canonical_shades"),
        pick("products", "rows").alias("products"),
        pick("products", "distinct_rows").alias("distinct_products"),
        pick("ingredients", "rows").alias("ingredient_rows"),
        pick("ingredients", "distinct_rows").alias("distinct_ingredients"),
    )
