import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import ordering


@pytest.fixture(autouse=True)
def several_partitions(spark):
    """Small test data would be coalesced into one partition, and no border would be crossed."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rank(values, q):
    values = sorted(values)
    return values[min(len(values) - 1, int(q * len(values)))]


def test_nearest_rank_with_a_group_that_holds_most_rows(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 30}", round(rng.random() * 50, 1)) for i in range(6000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    got = {r["g"]: (r["p50"], r["p99"], r["p0"]) for r in
           ordering.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}).collect()}
    assert got == {g: (rank(v, 0.5), rank(v, 0.99), min(v)) for g, v in groups.items()}
    total = ordering.nearest_rank(df, [], "v", {"p50": 0.5}).collect()
    assert [r["p50"] for r in total] == [rank([v for _, v in rows], 0.5)]


def test_the_largest_group_is_spread(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    parts = ordering.in_order(df, ["g", "v"]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 20000


def test_with_next_crosses_partitions_and_stays_in_its_group(spark):
    rows = [(f"r{i % 3}" if i % 2 else "hot", float(i), None if i % 7 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, ts double, n int").repartition(5)
    got = {(r["run"], r["ts"]): (r["next_ts"], r["next_n"]) for r in
           ordering.with_next(df, ["run"], ["ts"], ["ts", "n"]).collect()}
    expected = {}
    for run in {r[0] for r in rows}:
        own = sorted((t, n) for g, t, n in rows if g == run)
        for (t, _), following in zip(own, [*own[1:], (None, None)]):
            expected[run, t] = following
    assert got == expected


def test_ranks_of_any_sign_and_size(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1e-300, -1e300, 1e300, float("inf"), *[rng.choice((-1, 1)) * 10 ** rng.uniform(-9, 9) for _ in range(700)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    quantiles = {f"q{i}": i / 20 for i in range(20)}
    got = ordering.nearest_rank(df, [], "v", {**quantiles, "last": lambda n: n - 1}).first()
    assert [got[name] for name in quantiles] == [rank(values, q) for q in quantiles.values()]
    assert got["last"] == float("inf")


def test_nothing_runs_while_plans_are_built(spark):
    df = spark.range(100).selectExpr("'g' AS g", "cast(id AS double) AS v")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    ordering.nearest_rank(df, ["g"], "v", {"p50": 0.5})
    ordering.with_next(df, ["g"], ["v"], ["v"])
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_dense_position(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("string").alias("code")).repartition(7)
    got = [(r["code"], r["id"]) for r in ordering.dense_position(df, ["code"], "id").orderBy("id").collect()]
    assert got == [(code, i) for i, code in enumerate(sorted(str(n) for n in range(5000)), start=1)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ordering.nearest_rank(df, ["g"], "v", {"p50": 0.5}).count() == 0
    assert ordering.dense_position(df, ["g", "v"]).count() == 0
    assert ordering.with_next(df, ["g"], ["v"], ["v"]).count() == 0


def test_values_close_to_each_other_are_narrowed_down(spark):
    """A million different stamps within a millionth of a percent, nine tenths of them in one group."""
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (F.lit(1.7e15) + F.col("id") * 7919 % n).alias("v"))
    few = ordering._narrowed(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}).groupBy("g", "_name").count().collect()
    assert len(few) == 4 and max(r["count"] for r in few) <= 4
    got = {r["g"]: (r["p50"], r["p99"]) for r in ordering.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    values = {"a": [], "b": []}
    for i in range(n):
        values["b" if i % 10 == 0 else "a"].append(1.7e15 + i * 7919 % n)
    assert got == {g: (rank(v, 0.5), rank(v, 0.99)) for g, v in values.items()}


def test_ranks_of_whole_numbers_and_repeated_values(spark):
    rng = random.Random(8)
    values = [rng.choice((3, 3, 3, 4, -7, 0, 2**40 + rng.randrange(5), 10**12 + rng.randrange(10**6))) for _ in range(3000)]
    got = ordering.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), [], "v", {f"q{i}": i / 40 for i in range(41)}).first()
    assert [got[f"q{i}"] for i in range(41)] == [rank(values, i / 40) for i in range(41)]
