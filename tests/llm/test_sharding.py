import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tideline.llm import sharding


def check(got, rows, shards=sharding.SHARDS):
    """The law, the columns that follow from the rows, and the slots."""
    told = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == told
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(shards)) and {r["law"] for r in got} <= {"rows"}
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert all(r["grown_shard"] is None for r in got)


def groups(got):
    """Shards of each group of equal texts (rows told apart by size and checksum)."""
    found = {}
    for r in got:
        found.setdefault((r["size"], r["text_crc32"]), []).append(r["shard"])
    return {key: Counter(x) for key, x in found.items() if len(x) > 1}


def test_documents(spark):
    rows = odd.texts(spark) + [(None, None), (None, "Same Line Here")]
    got = sharding.digest_rows(odd.documents(spark, rows)).collect()
    check(got, rows)
    assert sum(len(x) - 1 for x in groups(got).values()) <= sharding.SHARDS - 1
    assert sharding.digest_rows(odd.empty(spark)).count() == 0
    assert odd.rows_of(sharding.digest_rows(odd.documents(spark, rows))) == sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("n", [1, 7, 9])
def test_few_rows(spark, n):
    rows = [(i, "x" * (i // 2)) for i in range(n)]
    check(sharding.digest_rows(odd.documents(spark, rows)).collect(), rows)


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(2)
    rows = [(i, "the hot text") for i in range(1000)] + [(1000 + i, f"pair {i // 2}") for i in range(800)]
    rows += [(2000 + i, f"triple {i // 3}") for i in range(600)] + [(3000 + i, f"alone {i}") for i in range(600)]
    rng.shuffle(rows)
    got = sharding.digest_rows(odd.documents(spark, rows)).collect()
    check(got, rows)
    split = {key: x for key, x in groups(got).items() if len(x) > 1}
    hot = split.pop((len("the hot text") + 1, zlib.crc32(b"the hot text")))
    # a shard has 375 rows, 75 of them free at first: the hot text gathers in the shards that have room, whole groups do not give way
    assert sum(n for _, n in hot.most_common(3)) >= 1.5 * 375
    assert len(split) <= sharding.SHARDS - 1


def test_only_linked_rows(spark):
    """Nothing can give way: members of pairs only change places."""
    rows = [(i, f"pair {i % 400}") for i in range(800)]
    got = sharding.digest_rows(odd.documents(spark, rows)).collect()
    check(got, rows)
    assert sum(len(x) > 1 for x in groups(got).values()) <= 20


def test_links_of_several_hubs(spark):
    """Chains of ten nodes, each linked with the next; cut links against those of a random placement."""
    nodes = spark.range(400).select(F.col("id").alias("node"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("start"))
    links = nodes.select("node", "start", F.explode(F.array(F.col("node"), F.col("node") + 1)).alias("hub")).where("hub % 10 <> 0")
    shard = {r["node"]: r["shard"] for r in sharding.sharded(nodes, links, [], 4).collect()}
    assert sorted(Counter(shard.values()).values()) == [100] * 4
    cut = sum(shard[i] != shard[i + 1] for i in range(399) if (i + 1) % 10)
    assert cut < 0.75 * 0.75 * 360


def test_admission():
    assert sharding.admitted({(0, 1): 10, (1, 0): 10}, [20, 20], [20, 20]) == [1.0, 1.0]
    assert sharding.admitted({(0, 1): 10}, [20, 15], [20, 20]) == [1.0, 0.5]
    assert sharding.admitted({(0, 1): 10}, [20, 20], [20, 20]) == [1.0, 0.0]
    assert sharding.quotas(10, 4) == [3, 3, 2, 2]
