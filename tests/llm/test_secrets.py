import hashlib
import random
import re

from tests.llm import odd
from tideline.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def expected(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def base(text):
    return [span for span in secrets.spans_of(text) if span[1] < 3]


def test_random_texts():
    parts = ["pass", "word", "wd", "secret", "ToKeN", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "A1", "0", "12", "abcdef",
             "f", "x", "aaaa", "0a1b", "é", "ſ", "-", "deadbeef", "\n"]
    pick = random.Random(4)
    for _ in range(8000):
        text = "".join(pick.choices(parts, k=pick.randint(0, 40)))
        assert base(text) == expected(text), text


def test_checksums():
    body = "0aB3" * 7 + "xy"
    right = "ghp_" + body + secrets.checksum(body)
    wrong = "npm_" + body + "zzzzzz"
    assert secrets.spans_of(f"{right} {wrong}") == [(0, 3, 40)]
    assert secrets.spans_of(right + "0") == []
    assert secrets.spans_of("npm_" + body + secrets.checksum(body))[0][1] == 4


def test_documents(spark):
    rows = [*odd.texts(spark), (2000, "token: abcdef " * 9000), (2001, "é" * 5 + "AKIA" + "Q" * 16), (2002, "0" * 40_000)]
    got = {r["doc_id"]: r for r in secrets.scan(odd.documents(spark, rows)).collect() if r["doc_id"] is not None}
    for key, text in rows:
        if key is None:
            continue
        found = expected(text or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
        assert got[key]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[key][c] for c in ("n_assign", "n_access", "n_hex")] == [[k for _, k, _ in found].count(i) for i in range(3)]
    assert secrets.scan(odd.empty(spark)).count() == 0
