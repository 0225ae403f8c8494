"""Catalog dimension tables in versions: readers see the last version that is complete.

A version is a folder per table.  It counts from the moment its one-row entry in ``versions`` exists,
which is written last, so a refresh is all or nothing and an interrupted one leaves no trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import refresh as steps
from tideline.sources.logs import or_empty
from tideline.tables import LONG, PRODUCT_INGREDIENTS, PRODUCTS, SHADES, TIME, schema

TABLES = {"products": PRODUCTS, "shades": SHADES, "product_ingredients": PRODUCT_INGREDIENTS}
_VERSIONS = schema(version=LONG, committed_at=TIME)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the last complete version, 0 when there is none."""
    versions = or_empty(spark, _VERSIONS, lambda: spark.read.schema(_VERSIONS).parquet(f"{root}/versions"))
    return versions.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root)
    if version == 0:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/version={version}")


def write_version(spark: SparkSession, root: str, **tables: DataFrame) -> int:
    """Write a complete set of tables and make it current. A table that is left out is empty."""
    version = current_version(spark, root) + 1
    for name, columns in TABLES.items():
        table = tables.get(name)
        table = spark.createDataFrame([], columns) if table is None else table.select(*columns.fieldNames())
        table.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    entry = spark.range(1).select(F.lit(version).cast("bigint").alias("version"),
                                  F.current_timestamp().alias("committed_at"))
    entry.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def refresh(spark: SparkSession, root: str) -> DataFrame:
    """Normalize shades and products and rebuild the ingredient lists, all or nothing. Returns the report."""
    shades = read_table(spark, root, "shades")
    products = read_table(spark, root, "products")
    write_version(
        spark, root,
        shades=steps.refresh_shades(shades), products=steps.refresh_products(products),
        product_ingredients=steps.product_ingredients(products),
    )
    return steps.refresh_report(*[read_table(spark, root, name) for name in ("shades", "products", "product_ingredients")])
