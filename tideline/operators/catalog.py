"""Build a makeup catalog from a product export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fixed
from tideline.functions import text
from tideline.operators.ordering import dense_position
from tideline.tables import CATALOG_EXTRACT


def _trimmed(name: str):
    return text.strip(F.coalesce(F.col(name), F.lit("")))


def catalog_filter(export: DataFrame) -> DataFrame:
    """Export rows with a name and a brand that are makeup by tag or name and nothing else by either."""
    cleaned = export.withColumns({
        "product_name": _trimmed("product_name"), "brands": _trimmed("brands"),
        "categories_tags": F.coalesce("categories_tags", F.lit("")),
    })
    named = (F.col("product_name") != "") & (F.col("brands") != "")
    return cleaned.where(named & text.is_makeup(F.col("categories_tags"), F.col("product_name")))


def catalog_build(export: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The catalog extract in order of code, with whole ingredient texts unless ``max_chars`` bounds them."""
    ingredients = _trimmed("ingredients_text")
    if max_chars is not None:
        ingredients = F.left(ingredients, F.lit(max_chars))
    return (
        catalog_filter(export)
        .select(
            "code", F.col("product_name").alias("name"), F.col("brands").alias("brand"),
            text.best_category(F.col("categories_tags")).alias("category"),
            ingredients.alias("ingredients_text"),
        )
        .orderBy("code")
    )


def catalog_ids(extract: DataFrame) -> DataFrame:
    """Products numbered from 1 in order of code, each with its one default shade."""
    numbered = dense_position(extract, CATALOG_EXTRACT.fieldNames(), "product_id")
    return numbered.select(
        F.col("product_id").cast("int").alias("product_id"),
        "code", "brand", F.col("name").alias("raw_name"), "category", "ingredients_text",
        (F.col("product_id") * 10).cast("int").alias("shade_id"),
        F.coalesce(text.extract_shade(F.col("name")), F.lit(fixed.UNSPECIFIED_SHADE)).alias("shade_name"),
        F.lit(fixed.UNSPECIFIED_HEX).alias("hex"),
    )


def products(numbered: DataFrame) -> DataFrame:
    """Product rows of a numbered catalog; an empty ingredient text becomes null."""
    return numbered.select(
        "product_id", "brand", "raw_name", "category",
        F.nullif(F.col("ingredients_text"), F.lit("")).alias("ingredients_text"),
    )


def shades(numbered: DataFrame) -> DataFrame:
    return numbered.select("shade_id", "product_id", F.col("shade_name").alias("raw_name"), "hex")
