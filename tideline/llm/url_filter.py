"""URL filter: rules by host and path decide first; a logistic regression on hashed character n-grams decides the rest.

The regression learns from a small labelled table of URLs: n-grams of three to five characters of host and of path, each
hashed to one of ``FEATURES`` columns. ``training`` says how many labelled URLs it takes at most; the features and the fit
are Spark's own (``HashingTF``, ``LogisticRegression``). Judging is a pass over the rows where they are read; its model has
``FEATURES`` weights, whatever the input.

A null URL, or one without ``://``, has an empty host and path. Rows that repeat are judged one by one. Without labels every
verdict is allow; with labels of one kind it is that kind. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 12
GRAMS = (3, 4, 5)
TRAINING = 4_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for own_host, own_path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule = F.when(fits, own_host + own_path) if rule is None else rule.when(fits, own_host + own_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def _cut(text: Column, n: int, mark: str) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and of path, each marked by where it is from; nothing crosses from one to the other."""
    return F.concat(*[_cut(F.concat(F.lit("^"), text, F.lit("$")), n, mark)
                      for mark, text in (("h", host), ("p", path)) for n in GRAMS])


@dataclass(frozen=True)
class Judge:
    """``model``, or the only verdict there is."""

    model: LogisticRegressionModel | None
    always: str = "allow"


def _features(df: DataFrame, url: Column) -> DataFrame:
    """``df`` as ``row``, with ``host``, ``path`` and ``features``."""
    host, path = parts(url)
    rows = df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return hashing.transform(rows).drop("grams")


def learn(labelled: DataFrame, url_column: str = "url", label_column: str = "verdict", training: int = TRAINING) -> Judge:
    """A judge from at most ``training`` different labelled URLs, those with the smallest hashes."""
    rows = labelled.select(F.col(url_column).cast("string").alias("url"), F.col(label_column).alias("verdict"))
    rows = rows.where("url is not null and verdict in ('allow', 'block')").groupBy("url").agg(F.max("verdict").alias("verdict"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(training).cache()
    kinds = [row["verdict"] for row in rows.select("verdict").distinct().collect()]
    if len(kinds) < 2:
        rows.unpersist()
        return Judge(None, *kinds)
    points = _features(rows, F.col("url")).select("features", (F.col("row.verdict") == "block").cast("double").alias("label"))
    fit = LogisticRegression(maxIter=50, regParam=0.01, standardization=False).fit(points)
    rows.unpersist()
    return Judge(fit)


def judge(df: DataFrame, judge: Judge, url_column: str = "url", rules=RULES) -> DataFrame:
    """The rows of ``df`` as ``row``, with ``host``, ``path``, ``rule``, ``verdict`` and ``block_probability``."""
    rows = _features(df, F.col(f"`{url_column}`").cast("string"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if judge.model is None:
        probability = F.lit(1.0 if judge.always == "block" else 0.0)
        judged = rows.withColumn("block_probability", probability)
    else:
        from pyspark.ml.functions import vector_to_array

        judged = judge.model.transform(rows)
        judged = judged.withColumn("block_probability", vector_to_array("probability")[1])
    learned = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return judged.select("row", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
                         "block_probability")


def digest_rows(df: DataFrame, rules=RULES) -> DataFrame:
    """Each page's verdict; the labelled table is that of the pages that the rules decide."""
    host, path = parts(F.col("url").cast("string"))
    _, verdict = rule_of(host, path, rules)
    judged = judge(df.select("page_id", "url"), learn(df.select("url", verdict.alias("verdict"))), rules=rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "block_probability")
