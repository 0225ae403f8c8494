"""Readers for metric logs and run summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.tables import METRIC_WINDOWS, REFRESH_LOG, RUN_SUMMARY, SAMPLES


def or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    """The table ``read()`` gives, or an empty one while its folder does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _run_of_file():
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def _name_of_file():
    return F.regexp_extract("_metadata.file_path", r"([^/]*?)(\.[^/]*)?$", 1)


def _field(name: str, kind: T.DataType):
    """A field of the document: a number in any spelling keeps its value, what is no such value is null."""
    value = F.try_variant_get("_doc", f"$.{name}", kind.simpleString())
    if isinstance(kind, T.LongType):
        value = F.coalesce(value, F.try_variant_get("_doc", f"$.{name}", "double").try_cast("bigint"))
    return value.alias(name)


def _document(line: str):
    """A line as a variant. Bare ``NaN`` and ``Infinity``, which no JSON has but some writers write, become texts of that name."""
    named = F.regexp_replace(line, r"(?<=[:,\[])(\s*)(NaN|-?Infinity)(?=\s*[,}\]])", '$1"$2"')
    return F.coalesce(F.try_parse_json(line), F.try_parse_json(named))


def _json_lines(spark: SparkSession, schema: T.StructType, path: str, run: str | None, consumer: str | None = None) -> DataFrame:
    """Every line that is a JSON object. Only other lines are left out; a field of an other type is null."""
    named = [(name, column) for name, column in ((run, _run_of_file), (consumer, _name_of_file)) if name]

    def read() -> DataFrame:
        lines = spark.read.text(path).select(_document("value").alias("_doc"), *[c().alias(n) for n, c in named])
        objects = lines.where(F.schema_of_variant("_doc").startswith("OBJECT"))
        return objects.select(*[n for n, _ in named], *[_field(f.name, f.dataType) for f in schema.fields])

    return or_empty(spark, T.StructType([*[T.StructField(n, T.StringType()) for n, _ in named], *schema.fields]), read)


def metric_windows(spark: SparkSession, path: str, run: str | None = "scenario", consumer: str | None = "consumer") -> DataFrame:
    """Windows that consumers logged, as JSON lines. The run is the folder name, the consumer the file name."""
    return _json_lines(spark, METRIC_WINDOWS, path, run, consumer)


def samples(spark: SparkSession, path: str, kind: str, run: str | None = "run") -> DataFrame:
    """Samples of one kind (``db`` or ``k8s``) from a log that mixes kinds."""
    return _json_lines(spark, SAMPLES, path, run).where(F.col("kind") == kind)


def refresh_log(spark: SparkSession, path: str, run: str | None = "scenario") -> DataFrame:
    return _json_lines(spark, REFRESH_LOG, path, run)


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per run from nested summaries, one document per file. The run is the folder name."""
    def read() -> DataFrame:
        docs = spark.read.schema(RUN_SUMMARY).option("multiLine", "true").json(path)
        return docs.select(_run_of_file().alias("run"), *RUN_SUMMARY.fieldNames())

    schema = T.StructType([T.StructField("run", T.StringType()), *RUN_SUMMARY.fields])
    return or_empty(spark, schema, read)


def run_table(summaries: DataFrame) -> DataFrame:
    """The flat columns the run operators use."""
    return summaries.select(
        "run", F.coalesce("t0", "produce_start").alias("t0"), "produce_end", "drain_end",
        F.col("killed.at").alias("killed_at"), "sent", "drained", "restarts",
        F.col("validation.events").alias("stored"),
        F.col("validation.mismatched_products").alias("mismatched_products"),
        F.coalesce("final_dlq.total", F.lit(0)).alias("dead"),
        F.col("recovery.redriven").alias("redriven"),
        F.col("producer_stats.valid").alias("valid"), F.col("producer_stats.v1_valid").alias("v1_valid"),
    )
