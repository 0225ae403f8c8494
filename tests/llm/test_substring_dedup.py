import hashlib
import random
import re

from tests.llm import odd
from tideline.llm import substring_dedup


def expected(rows, size=13):
    words = [re.findall(r"[^\x20\x09-\x0d]+", text or "") for _, text in rows]
    first = {}
    for (key, _), own in zip(rows, words, strict=True):
        if key is not None:
            for i in range(len(own) - size + 1):
                window = tuple(own[i:i + size])
                first[window] = min(first.get(window, key), key)
    found = []
    for (key, _), own in zip(rows, words, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - size + 1 if key is not None else 0):
            if first[tuple(own[i:i + size])] < key:
                gone[i:i + size] = [True] * size
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        found.append((key, len(own), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(found, key=repr)


def test_documents(spark):
    rows = odd.texts(spark)
    assert odd.rows_of(substring_dedup.digest_rows(odd.documents(spark, rows))) == expected(rows)


def test_branching_texts_of_few_words(spark):
    pick = random.Random(8)
    pool = ["a b c d e f g h i j k l m n o p q r s t u v w".split(), "x y".split(), "the same few words again and again".split()]
    rows = []
    for key in pick.sample(range(-50, 500), 160):
        words = []
        for _ in range(pick.randint(1, 6)):
            source = pick.choice(pool)
            start = pick.randrange(len(source))
            words += source[start:start + pick.randint(1, 20)] or ["z"]
        rows.append((key, " ".join(words)))
    assert odd.rows_of(substring_dedup.digest_rows(odd.documents(spark, rows))) == expected(rows)


def test_all_columns_come_back(spark):
    df = odd.documents(spark, odd.texts(spark, 5))
    assert substring_dedup.dedup(df).select("row.*").schema == df.schema
    assert substring_dedup.dedup(odd.empty(spark)).count() == 0
