import random
import zlib

import numpy as np

from tests.llm import odd
from tideline.llm import toxicity


def made(n, share=0.3, seed=1):
    """Texts of ordinary words; toxic ones have a few forms of bad stems, most forms rare."""
    pick = random.Random(seed)
    plain = ["".join(pick.choices("abcdefghilmnorstu", k=pick.randint(2, 7))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        toxic = pick.random() < share
        words = pick.choices(plain, k=pick.randint(40, 120))
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[pick.randrange(len(words))] = pick.choice(["zwok", "kvatch"]) + pick.choice(plain)[:3]
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_texts(spark):
    rows, labels = made(1200)
    found = toxicity.digest_rows(odd.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_held_out_labels_are_not_learned(spark):
    rows, labels = made(300)
    changed = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = [odd.rows_of(toxicity.digest_rows(odd.documents(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")))
              for x in (labels, changed)]
    assert scores[0] == scores[1]


def test_odd_documents_and_labels(spark):
    rows, labels = made(200)
    rows += [(i, t) for i, t in odd.texts(spark, 5) if i is None or i >= 1000 or i < 0]
    odd_labels = [*labels, (labels[0][0], None), (None, 1), (labels[1][0], labels[1][1]), (99_999, 1), (1001, 7)]
    df = odd.documents(spark, rows)
    found = toxicity.digest_rows(df, spark.createDataFrame(odd_labels, "doc_id long, toxic int")).collect()
    assert len(found) == len(rows)
    empties = {r["score"] for r in found if r["doc_id"] in (1000, 1001, 1002)}
    assert len(empties) == 1 and 0 < empties.pop() < 1
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.score(df, model).select("row.*").schema == df.schema


def test_without_both_kinds_of_labels(spark):
    df = odd.documents(spark, made(20)[0])
    for labels, share in (([], 0.0), ([(i, 1) for i in range(20)], 1.0)):
        found = toxicity.digest_rows(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in found.collect()} == {share}
    assert toxicity.digest_rows(odd.empty(spark), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_a_kind_that_the_curve_lacks_is_taken_from_other_folds(spark):
    rows, labels = made(400)
    folds = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    kept = [(i, y) for i, y in labels if folds[i] != 0 or not y]
    rows += [(5000, None), (5001, " -- ")]
    for n in (len(kept), 1):
        toxic = sorted(i for i, y in kept if y and folds[i] != 2)[:n]
        own = [(i, y) for i, y in kept if not y or i in toxic or folds[i] == 2]
        found = toxicity.digest_rows(odd.documents(spark, rows), spark.createDataFrame(own, "doc_id long, toxic int")).collect()
        scores = {r["doc_id"]: r["score"] for r in found}
        assert len(set(scores.values())) > 100
        if n > 1:
            held = [i for i, _ in labels if folds[i] == 2]
            assert sum((scores[i] >= 0.3) == dict(labels)[i] for i in held) / len(held) > 0.9


def test_texts_without_words_are_not_rejected_by_share(spark):
    rows, labels = made(300, share=0.7)
    rows += [(5000, None), (5001, ""), (5002, " -- ")]
    for own in (labels, [(i, 1) for i, _ in labels]):
        found = toxicity.digest_rows(odd.documents(spark, rows), spark.createDataFrame(own, "doc_id long, toxic int")).collect()
        assert {r["predicted"] for r in found if r["doc_id"] >= 5000} == {0}


def test_words_are_judged_in_slices(monkeypatch):
    pick, sizes = np.random.default_rng(1), []
    names = [f"{a}_{b}" for a in ("word", "gram", "context", "kinds") for b in ("toxic", "plain")] + ["tail", "after", "after_kinds", "letter"]
    totals = dict.fromkeys(("toxic", "plain", "kinds_toxic", "kinds_plain", "letters", "tails"), 1e6)
    tables = {name: pick.integers(0, 9, toxicity.BUCKETS).astype(np.float32) for name in names}
    of_words = toxicity.Model.of_words
    monkeypatch.setattr(toxicity.Model, "of_words", lambda self, words: sizes.append(len(words)) or of_words(self, words))
    texts = [" ".join(f"word{i}" for i in range(20_000)).encode(), b"", b" -- ", b"word7 word19999"]
    found = toxicity.Model(tables, totals, 0.5).of_texts(texts)
    assert max(sizes) <= 8192 and sum(sizes) == 20_000
    each = of_words(toxicity.Model(tables, totals, 0.5), [f"word{i}" for i in range(20_000)])
    for x, own in ((found[0], each), (found[3], each[[7, 19_999]])):
        assert np.allclose(x, own.sum(axis=0)[:5] / (len(own) + toxicity.WEIGHT))
    assert found[1] is None and found[2] is None
