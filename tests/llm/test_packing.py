import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm import odd
from tideline.llm import packing

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_tokenizer(spark):
    encoder = packing.encoder(packing.vocabulary())
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", ".", "'s", "'", "1", "٣", "中", "😀", "<|endoftext|>", "ñ", "\r\n", "İ", "\x85", "²"]
    pick = random.Random(3)
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 14))) for _ in range(4000)]
    for text in texts + [t or "" for _, t in odd.texts(spark)]:
        assert encoder.encode(text) == np.array(plain_ids(text)[:-1], dtype="<u4").tobytes(), text


def test_best_fit_takes_the_tightest_window():
    windows, pick, open_rooms = packing.Windows(2048), random.Random(1), []
    for window in range(3000):
        need = pick.randint(1, 2048)
        fits = [room for room in open_rooms if room >= need]
        got = windows.take(need)
        assert (got[1] if got else None) == (min(fits) if fits else None)
        room = got[1] if got else 2048
        if got:
            open_rooms.remove(room)
        if room > need:
            windows.put(room - need, window)
            open_rooms.append(room - need)


def test_documents(spark):
    rows = odd.texts(spark)
    got = packing.digest_rows(odd.documents(spark, rows)).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for key, text in rows:
        ids = plain_ids(text)
        for start in range(0, len(ids), 2048):
            part = ids[start:start + 2048]
            wanted[key].append((start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in wanted.items()} == {
        k: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in v) for k, v in by.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    full = sum(length for parts in sequences.values() for _, length in parts) / 2048 / len(sequences)
    assert full > 0.9
    assert packing.digest_rows(odd.empty(spark)).count() == 0


def test_sequences_round_trip(spark):
    rows = [(i, t) for i, t in odd.texts(spark, 20) if i is not None]
    cut = packing.pieces(odd.documents(spark, rows))
    packed = packing.pack(cut).cache()
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = built[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert np.array(own, "<u4").tobytes() == bytes(r["ids"])
    assert all(len(ids) == 2048 or len(ids) & (len(ids) - 1) == 0 for ids in built.values())


def test_a_task_leaves_no_chunks_in_its_worker(spark):
    path = packing.vocabulary()

    def held(batches):
        for batch in batches:
            known = packing.encoder(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(known._known) + len(known._before)] * batch.num_rows)], ["n"])

    texts = [(i, f"some chunks that only document{i} has") for i in range(400)]
    assert packing.pieces(spark.createDataFrame(texts, "doc_id long, text string")).count() == 400
    left = spark.range(0, 40, 1, 4).mapInArrow(held, "n long").collect()
    assert {r["n"] for r in left} == {0}
