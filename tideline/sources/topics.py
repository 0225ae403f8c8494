"""Message sources: a Kafka topic, or files with the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.tables import DEAD_LETTERS, MESSAGES


def kafka_options(servers: str, topic: str, **more: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", **more}


def topic_stream(spark: SparkSession, servers: str, topic: str, max_messages: int | None = None) -> DataFrame:
    """All messages of a topic from its start. The checkpoint of the query keeps the offsets.

    ``max_messages`` bounds a micro-batch. It is a bound for the whole topic, not for one poll of one consumer:
    choose it so that a batch fills the cluster.
    """
    options = kafka_options(servers, topic, startingOffsets="earliest", failOnDataLoss="true")
    if max_messages is not None:
        options["maxOffsetsPerTrigger"] = str(max_messages)
    return spark.readStream.format("kafka").options(**options).load()


def topic_snapshot(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """What is in a topic now, from start to end, without any consumer group."""
    options = kafka_options(servers, topic, startingOffsets="earliest", endingOffsets="latest")
    return spark.read.format("kafka").options(**options).load()


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish (key, value), for example redriven dead letters."""
    messages.select("key", "value").write.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "topic": topic}
    ).save()


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Messages from Parquet files with the columns of the Kafka source."""
    reader = spark.readStream.schema(MESSAGES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def file_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(folder)


def _header(name: str) -> Column:
    """Last value of a message header as text, null when absent."""
    matching = F.filter(F.col("headers"), lambda h: h["key"] == name)
    return F.try_element_at(matching, F.lit(-1))["value"].cast("string")


def dead_letters_of(messages: DataFrame) -> DataFrame:
    """Dead-letter columns of messages that carry reason and origin in their headers."""
    return messages.select(
        "key", "value",
        _header("reason").alias("reason"),
        _header("source_topic").alias("source_topic"),
        _header("source_partition").cast("int").alias("source_partition"),
        _header("source_offset").cast("bigint").alias("source_offset"),
        F.col("offset").alias("dlq_offset"),
    )


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as messages: original key and value, reason and origin in headers."""
    def header(name: str) -> Column:
        return F.struct(F.lit(name).alias("key"), F.col(name).cast("string").cast("binary").alias("value"))

    names = [n for n in DEAD_LETTERS.fieldNames() if n not in ("key", "value")]
    return letters.select("key", "value", F.array(*[header(n) for n in names]).alias("headers"))
