"""The registered query of each operator: it applies the operator to its whole table, with production parameters."""

from __future__ import annotations

from tideline.llm import conversation_repair, decontamination, hard_negatives, licenses, line_dedup, minhash, packing, secrets, sharding, simhash, substring_dedup, toxicity, url_filter
from tideline.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    """Documents that hold benchmark items, and which."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_secrets(spark, sf_dir):
    """Spans of secrets in each document."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    """Each document without the lines that a smaller document holds."""
    return line_dedup.digest_rows(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    """Rule and verdict for each page's URL."""
    return url_filter.digest_rows(_table(spark, sf_dir, "pages"))


def op5_licenses(spark, sf_dir):
    """The license that each document is, and the license notices it has."""
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known(spark))


def op6_toxicity(spark, sf_dir):
    """How toxic each document is, as learned from the labels outside fold 2."""
    return toxicity.digest_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash(spark, sf_dir):
    """Fingerprints of each document and of its edited text."""
    return minhash.digest_rows(_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    """Fingerprint and group of near duplicates of each document."""
    return simhash.digest_rows(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    """Each document without the long word sequences that a smaller document holds."""
    return substring_dedup.digest_rows(_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    """Where each piece of each document lies in the token sequences."""
    return packing.digest_rows(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    """Each conversation, damaged, judged and repaired at least cost."""
    return conversation_repair.digest_rows(_table(spark, sf_dir, "conversations"))


def op12_sharding(spark, sf_dir):
    """Shard and slot of each document: equal counts, equal texts together."""
    return sharding.digest_rows(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    """For each anchor and positive the rows of other labels whose scores come close."""
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secrets, op3_line_dedup, op4_url_filter, op5_licenses, op6_toxicity, op7_minhash, op8_simhash, op9_substring_dedup, op10_packing, op11_conversation_repair, op12_sharding, op13_hard_negatives)}
