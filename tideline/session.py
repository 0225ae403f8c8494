"""Session settings the package relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in a JSON document keeps its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # a short list of ids is asked of the Bloom filters of Parquet files one by one
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # state of a stream (ids within a watermark) outgrows executor memory, so it is kept on disk
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session. Sizing (shuffle partitions, memory) stays with the cluster."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and for bench.py."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # building a plan does not need the Python line of every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tideline-checkpoints-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later uses read it instead of computing it again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
