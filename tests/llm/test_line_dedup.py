import hashlib
from collections import defaultdict

import pytest

from tests.llm import odd
from tideline.llm import line_dedup


def expected(rows):
    def keys(text):
        return [line.decode() for line in (x.strip() for x in text.encode().lower().split(b"\n"))]

    holders = defaultdict(set)
    for key, text in rows:
        if key is not None:
            for k in keys(text or ""):
                if len(k) >= 10:
                    holders[k].add(key)
    found = []
    for key, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line, k in zip(lines, keys(text or ""), strict=True)
                if key is None or len(holders[k]) < 2 or min(holders[k]) == key]
        found.append((key, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(found, key=repr)


def test_documents(spark):
    rows = odd.texts(spark)
    assert odd.rows_of(line_dedup.digest_rows(odd.documents(spark, rows))) == expected(rows)


def test_hot_line_and_ties(spark):
    rows = [(i, f"A line that all of them hold\nown line number {i}\nÄÖÜäöüßéàè") for i in range(400)]
    assert odd.rows_of(line_dedup.digest_rows(odd.documents(spark, rows))) == expected(rows)


def test_all_columns_come_back(spark):
    df = odd.documents(spark, odd.texts(spark, 5))
    assert line_dedup.dedup(df).select("row.*").schema == df.schema
    assert line_dedup.dedup(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [0, 3])
def test_filter_loses_no_repeat(spark, bits):
    rows = [(i, f"shared line {i % 50:04d}\nlonely line {i:06d}") for i in range(300)]
    texts = odd.documents(spark, rows).selectExpr("doc_id AS id", "cast(text AS binary) AS text")
    found = line_dedup.suspects(texts, bits).groupBy("high", "low").count().where("count > 1").count()
    assert found == 50
