"""Five stages from raw documents to token sequences; each calls one operator of ``tideline.llm``.

A stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next stage's ``docs``;
all but the last return the columns that ``docs`` has. A row with a null id is judged by the toxicity filter like any other and
passes the other filters: nothing can name it there. Rows that repeat under one id stay or go together. A null text stays
null. Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontamination, line_dedup, minhash, packing, simhash, toxicity
from tideline.llm.components import components
from tideline.session import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from ``labels`` does not reject."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds, their ``n_chars`` counted anew; none goes."""
    kept = line_dedup.dedup(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.col("n_dropped") > 0, F.length(F.col("kept").cast("string"))).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars.cast(kind))
    return kept.select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates.

    Linked are documents with SimHash fingerprints that differ in three bits at most, and those whose five-word shingles have a
    verified Jaccard of 0.8 or more: 64 bits find copies with few changes only. Rows with one id go or stay together.
    """
    found = simhash.near_duplicates(docs).where("doc_id is not null").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    similar, members = minhash.similar_links(docs)
    links = found.unionByName(members.toDF("a", "b")).unionByName(similar.select("a", "b"))
    gone = components(links).where("node <> component").select(F.col("node").alias("of"))
    return docs.join(gone, docs["doc_id"] == gone["of"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("of")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["of"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the token sequences."""
    return packing.digest_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What passes between them is written to a new folder in the shared checkpoint folder.

    The result reads the last of it, so the folder stays; whoever owns the checkpoint folder may delete it afterwards.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
