import itertools
import os
import re
import shutil

import pytest

import corpus_pipeline
from tests.llm import odd, test_decontamination, test_line_dedup, test_packing, test_simhash
from tideline.llm import toxicity


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The given tables, the documents with odd ones added."""
    return str(tmp_path_factory.mktemp("tables"))


def near_groups(rows):
    """The smallest document linked with each: by fingerprints within three bits, or by five-word shingles with a Jaccard of 0.8."""
    label = {i: c for i, _, c in test_simhash.expected(rows) if i is not None}
    sets = {}
    for i, text in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = [i for i in sets if i is not None]
    for a, b in itertools.combinations(ids, 2):
        both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if (both >= 0.8 * every if every else True) and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {i: new if c == old else c for i, c in label.items()}
    return label


def test_stages_against_brute_force(spark, folder):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{odd.SF_DIR}/{name}.parquet", f"{folder}/{name}.parquet")
    odd.documents(spark, odd.texts(spark, 200)).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        if name == "toxicity":
            model = toxicity.learn(before, spark.read.parquet(f"{folder}/labels.parquet"))
            want = [(i, t) for (i, t), s in zip(rows, model.scores([(t or "").encode() for _, t in rows]), strict=True) if s < 0.3]
        elif name == "line_dedup":
            counts = {(i, t): None for i, t in rows}
            assert docs.count() == len(rows) and len(counts) <= len(rows)
            kept = sorted(((r["doc_id"], *r[1:]) for r in docs.selectExpr(
                "doc_id", "sha2(coalesce(text, ''), 256)").collect()), key=repr)
            want = None
            assert kept == sorted(((i, d) for i, _, _, d in test_line_dedup.expected(rows)), key=repr)
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "near_dedup":
            label = near_groups(rows)
            want = [(i, t) for i, t in rows if i is None or label[i] == i]
            assert {1007, 1008, 1009} <= set(label) and label[1008] == label[1009] == label[1007]
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {i for i, _ in test_decontamination.expected(rows, items)}
            want = [(i, t) for i, t in rows if i is None or i not in bad]
        else:
            tokens = sum(len(test_packing.plain_ids(t)) for _, t in rows)
            assert docs.agg({"length": "sum"}).first()[0] == tokens
            want = None
        if want is not None:
            assert odd.rows_of(docs.select("doc_id", "text")) == sorted(want, key=repr)
    whole = corpus_pipeline.run(spark, folder)
    assert odd.rows_of(whole.select("doc_id", "start", "length", "ids_crc32")) == odd.rows_of(
        seen["packing"].select("doc_id", "start", "length", "ids_crc32"))


def test_empty_documents_pass_through(spark, folder):
    odd.empty(spark).write.mode("overwrite").parquet(f"{folder}/none")
    docs = spark.read.parquet(f"{folder}/none")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert os.path.isdir(folder)
