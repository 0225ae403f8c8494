import hashlib
import random

import numpy as np

from tests.llm import odd
from tideline.llm import minhash
from tideline.llm.components import components


def printed(text):
    return minhash.signature((text or "").encode()).tobytes().hex()


def test_edited_documents(spark):
    rows = [(i, t) for i, t in odd.texts(spark) if i is not None and i != 1012]
    got = {r["doc_id"]: r for r in minhash.digest_rows(odd.documents(spark, rows[::-1])).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        cut = len(text) // 4
        changed = text[:len(text) - cut] + following[:cut]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (printed(text), printed(changed))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_nulls_ties_and_single_rows(spark):
    one = minhash.digest_rows(odd.documents(spark, [(5, "abcdefgh")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    found = minhash.digest_rows(odd.documents(spark, [(None, "abcdefgh"), (1, "x y"), (1, "x y"), (2, None), (None, None)])).collect()
    assert len(found) == 5
    assert [r["edited_sha256"] for r in found if r["doc_id"] is None and r["n_chars"]] == [hashlib.sha256(b"abcdef").hexdigest()]
    assert minhash.digest_rows(odd.empty(spark)).count() == 0


def test_likeness_follows_jaccard():
    pick = random.Random(2)
    words = [f"w{pick.randrange(5000)}" for _ in range(600)]
    for changed in (0, 20, 60, 200):
        other = list(words)
        other[:changed] = [f"v{i}" for i in range(changed)]
        x, y = (set(minhash.shingles(" ".join(w).encode()).tolist()) for w in (words, other))
        own = minhash.likeness(*(minhash.signature(" ".join(w).encode()) for w in (words, other)))
        assert abs(own - len(x & y) / len(x | y)) < 0.2


def test_similar_pairs(spark):
    pick = random.Random(6)
    rows = []
    for group in range(30):
        words = [f"g{group}w{pick.randrange(900)}" for _ in range(200)]
        for copy in range(4):
            other = list(words)
            for place in pick.sample(range(200), copy * 2):
                other[place] = f"c{copy}p{place}"
            rows.append((group * 10 + copy, " ".join(other)))
        rows.append((group * 10 + 7, " ".join(words)))
    pairs, members = minhash.similar_pairs(odd.documents(spark, rows))
    sets = {i: set(minhash.shingles(t.encode()).tolist()) for i, t in rows}
    own = dict(odd.rows_of(members))
    nodes = sorted(set(own.values()))
    assert all(own[g * 10 + 7] == g * 10 for g in range(30))
    true = {(a, b) for a in nodes for b in nodes if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()}
    assert set(found) <= true and len(found) >= 0.95 * len(true)
    assert all(np.isclose(j, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for (a, b), j in found.items())


def test_unrelated_long_texts(spark):
    one, other = (" ".join(f"{kind}{i}" for i in range(700_000)) for kind in "ab")
    assert minhash.likeness(*(minhash.signature(text.encode()) for text in (one, other))) < 0.05
    assert minhash.likeness(*(minhash.signature(text.encode()) for text in (one, one + " " + other[:1_000_000]))) > 0.7
    pairs, members = minhash.similar_pairs(odd.documents(spark, [(1, one), (2, other), (3, one.upper())]))
    assert dict(odd.rows_of(members)) == {1: 1, 2: 2, 3: 1} and pairs.count() == 0


def test_similar_links_connect_what_is_similar(spark):
    """Groups of near copies, one of them large, and a chain whose ends are not similar to each other."""
    pick = random.Random(9)
    rows = []
    for group, copies in enumerate([2, 3, 5, 150]):
        words = [f"g{group}w{pick.randrange(900)}" for _ in range(300)]
        for copy in range(copies):
            other = list(words)
            for place in pick.sample(range(300), 3):
                other[place] = f"c{copy}p{place}"
            rows.append((group * 1000 + copy, " ".join(other)))
    words = [f"chain{i}" for i in range(200)]
    for step in range(12):
        rows.append((9000 + step, " ".join(words[:200 - 15 * step] + [f"next{i}" for i in range(15 * step)])))
    rows += [(20, None), (21, ""), (None, "no id"), (22, "one"), (23, "ONE"), (1, rows[1][1])]
    links, members = minhash.similar_links(odd.documents(spark, rows))
    links, own = links.collect(), dict(odd.rows_of(members))
    sets = {i: set(minhash.shingles((t or "").encode()).tolist()) for i, t in rows if i is not None}
    label = dict(own)
    for r in links:
        assert len(sets[r["a"]] & sets[r["b"]]) >= 0.8 * len(sets[r["a"]] | sets[r["b"]])
        old, new = sorted((label[r["a"]], label[r["b"]]), reverse=True)
        label = {i: new if c == old else c for i, c in label.items()}
    for a in sets:
        for b in sets:
            if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert label[a] == label[b]
    assert len(links) < 6 * len(rows) and own[23] == 22 and own[21] == 20
    links, members = minhash.similar_links(odd.empty(spark))
    assert links.count() == members.count() == 0


def test_similar_links_join_what_is_similar_to_different_hubs(spark):
    """30 copies of one text and 30 of another; only the two texts themselves, which have larger ids, connect them."""
    pick = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    places = pick.sample(range(2, 298), 6)

    def changed(words, where, mark):
        return " ".join(f"{mark}p{i}" if i in where else word for i, word in enumerate(words))

    other = changed(base, set(places), "other").split()
    rows = [(500, " ".join(base)), (501, " ".join(other))]
    for first, words in ((0, base), (100, other)):
        rows += [(i, changed(words, set(pick.sample(range(300), 3)), f"c{i}")) for i in range(first, first + 30)]
    sets = {i: set(minhash.shingles(t.encode()).tolist()) for i, t in rows}
    assert [(a, b) for a in sets for b in sets if (a in (500, *range(30))) and b in (501, *range(100, 130))
            and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] == [(500, 501)]
    links, _ = minhash.similar_links(odd.documents(spark, rows))
    assert {r["component"] for r in components(links).collect()} == {0}


def test_similar_links_in_blocks(spark):
    pick = random.Random(12)
    words = [f"g{pick.randrange(900)}" for _ in range(100)]
    rows = [(i, " ".join(f"c{pick.randrange(9)}" if place in marked else word for place, word in enumerate(words)))
            for i in range(120) for marked in [set(pick.sample(range(100), pick.randrange(5)))]]
    # one id with two texts takes part with both
    rows += [(7, "quite another text of more than five words"), (300, "quite another text of more than five words here")]
    docs = odd.documents(spark, rows)
    whole, blocks = (odd.rows_of(components(minhash.similar_links(docs, most=most)[0])) for most in (minhash.BLOCK, 1000))
    assert whole == blocks and len({c for _, c in whole}) > 1


def brute_force(sets):
    own = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            union = len(sets[a]) + len(sets[b]) - both
            if (both / union if union else 1.0) >= 0.8:
                own = [min(own[a], own[b]) if c in (own[a], own[b]) else c for c in own]
    return own


def test_forest_of_very_many_copies():
    pick = random.Random(5)
    words, more = [f"g{pick.randrange(900)}" for _ in range(400)], ["the", "and", *(f"v{i}" for i in range(300))]
    texts = []
    for _ in range(250):
        other = list(words)
        for place in pick.sample(range(400), pick.randrange(30)):
            other[place] = pick.choice(more)
        texts.append(" ".join(other))
    for n, empty in ((250, []), (250, ["", ""]), (3, []), (2, []), (0, ["", ""]), (1, ["one two"])):
        sets = [np.unique(minhash.shingles(text.encode())) for text in texts[:n] + empty]
        links = minhash.similar_forest(sets)
        own = list(range(len(sets)))
        for a, b, jaccard in links:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert jaccard == (both / (len(sets[a]) + len(sets[b]) - both) if len(sets[a]) else 1.0) >= 0.8
            assert own[a] != own[b]
            own = [min(own[a], own[b]) if c in (own[a], own[b]) else c for c in own]
        assert own == brute_force(sets)
