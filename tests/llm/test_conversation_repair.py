import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tideline.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, mark string, copy long, n int, part string, digest binary, gone string"
EXTRA = ("m", 3, 1, "p", b"d", "g")
BLANK = "\x20\x09-\x0d"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(rows, faults):
    """Dijkstra over (cost, audit); what has been written decides what may follow."""
    def follows(last, role):
        return role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[last]

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, said = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, said
        if (at, last) in done:
            continue
        done.add((at, last))
        forced = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", at, forced[0], (*said, forced + ":")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, said))
            if faults[at] not in ("blank", "duplicate"):
                late = 3 if faults[at] == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + late, audit + "R", at + 1, forced[0], (*said, f"{forced}:{text}")))
                if follows(last, role):
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, role[0], (*said, f"{role}:{text}")))


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        left = sorted((r[1:] for r in damage(r for r in rows if r[0] == conv)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in left:
            solid = re.sub(f"[{BLANK}]+", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[0] for r in left} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(left)]
        cost, audit, said = cheapest([r[1:] for r in left], faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture
def odd_rows():
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "User"]
    texts = ["Fine.", "So?", "cut off", " \t\x0b", "", None, "x. \n", "Ünï\x85", "no\x1f."]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([t, t, t, None, t + 5]), rng.choice(roles), rng.choice([*texts, f"turn {t}.", f"at {t}"])))
    rows += [(100, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"line {t}" + "." * (t % 5 > 0)) for t in range(700)]
    rows += [(101, 1, "user", "the very same.")] * 300 + [(101, 2, "assistant", "answer.")]
    rows += [(102, None, "user", "no turn.")] * 5 + [(None, 0, "user", "whose?"), (None, 1, "assistant", "nobody's."), (103, 0, None, "x" * 200_000)]
    # every row of this one is dropped
    rows += [(i, 0, "user", "gone.") for i in range(2000, 2200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:2]
    return rows


def test_the_auction_finds_the_least_audit():
    rng = random.Random(1)
    for n in range(24):
        for _ in range(20):
            marks = "".join(rng.choice("bdsuaoSUAO" if rng.random() < 0.5 else "ua") for _ in range(n))
            roles = [({"s": "system", "u": "user", "a": "assistant"}.get(m.lower(), "other"), "") for m in marks]
            faults = ["blank" if m in "bd" else "truncated" if m.isupper() else None for m in marks]
            each, tail = repair._whole(marks)
            assert (repair.costs(marks, repair.TAIL)[0], "".join(each) + tail) == cheapest(roles, faults)[:2]


def test_odd_conversations(spark, odd_rows):
    got = repair.digest_rows(table(spark, odd_rows))
    assert odd.rows_of(got) == expected(odd_rows)


def test_a_conversation_crosses_partitions(spark, odd_rows):
    rows, gone = repair.damaged(table(spark, odd_rows))
    edits = repair.repair(rows, gone)
    parts = {r["conv_id"]: r["n"] for r in edits.groupBy("conv_id").agg(F.count_distinct("part").alias("n")).collect()}
    assert parts[100] > 1 and parts[5] == 1
    assert {r["conv_id"] for r in edits.where("crosses").select("conv_id").distinct().collect()} == {c for c, n in parts.items() if n > 1}
    assert edits.where("edit = 'I'").where("role not in ('user', 'assistant') or text <> '' or turn is not null").count() == 0


def test_no_rows(spark):
    assert repair.digest_rows(table(spark, [])).count() == 0
    assert repair.repair(table(spark, [])).count() == 0


def test_given_conversations(spark):
    given = spark.read.parquet(f"{odd.SF_DIR}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given.collect()]
    assert odd.rows_of(repair.digest_rows(given)) == expected(rows)
