import itertools
import random
import re

from tests.llm import odd
from tideline.llm import decontamination as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def expected(rows, items):
    found = set()
    for key, text in rows:
        own = words(text)
        for item, item_text in items:
            other = words(item_text)
            width = min(d.WINDOW, len(other))
            if len(other) < d.SPAN:
                continue
            need = width - int(width * d.TOLERATED)
            for shift in range(width - len(other), len(own) - width + 1):
                equal = [own[i + shift] == w if 0 <= i + shift < len(own) else None for i, w in enumerate(other)]
                if any(None not in equal[a:a + width] and sum(equal[a:a + width]) >= need for a in range(len(other) - width + 1)):
                    found.add((key, item))
                    break
    return found


def test_masks_meet_every_window_with_two_substitutions():
    for changed in itertools.combinations(range(d.WINDOW), 2):
        assert any(not {o + i for o in mask} & set(changed) for mask in d.MASKS for i in range(d.WINDOW - d.SPAN + 1))


def test_documents(spark):
    pick = random.Random(5)
    given = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd.SF_DIR}/benchmark.parquet").collect()][:12]
    items = [*given, (900, None), (901, "too short"), (902, "Eight words, which is what a mask needs exactly!"), given[0]]
    rows = odd.texts(spark, 40)
    for i, (_, text) in enumerate(given):
        own = text.split()
        for n in (0, 1, 2, 3):
            changed = list(own)
            for place in pick.sample(range(len(own)), n):
                changed[place] = f"other{place}"
            rows.append((3000 + 10 * i + n, "Before it " + " ".join(changed) + " after"))
        rows.append((3000 + 10 * i + 5, " ".join(own[:9])))
    rows.append((4000, "EIGHT words which is what a mask needs exactly, then more"))
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, hashes string, at int")
    got = d.contaminated(odd.documents(spark, rows), benchmark)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == expected(rows, dict(items).items())
    assert {(3000 + 10 * i, item) for i, (item, _) in enumerate(given)} <= found and (4000, 902) in found
    assert d.contaminated(odd.empty(spark), benchmark).count() == 0
    assert d.contaminated(odd.documents(spark, rows), benchmark.limit(0)).count() == 0
