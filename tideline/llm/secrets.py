"""Secrets in texts: an Aho-Corasick automaton finds keywords, anchored expressions read on from each hit.

One pass of the automaton over a text gives the places of all keywords; only there an expression is matched, anchored at
the hit. Runs of hex digits have no keyword of their own, so their automaton holds a set of short strings of which every
long enough run must contain one: a digit next to a hex digit on either side, or four of the letters a to f.
Tokens that carry a checksum (six base-62 digits of a CRC-32) count only if it is right.

Nothing is shuffled: texts stay where they are read, so a hot source or a group of copies costs no more than its share.
A null text is an empty text; rows that repeat are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import arrow_map, text_bytes

# What a secret looks like. Letters of the keywords count in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(gh[opsur]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CHECKED_STARTS = ("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "github", "npm")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


def checksum(body: str) -> str:
    """The CRC-32 of ``body`` as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _cases(word: str) -> list[str]:
    return ["".join(x) for x in itertools.product(*[sorted({c.lower(), c.upper()}) for c in word])]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keyword -> (kind, length). Built once in each Python worker."""
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        for case in _cases(word):
            found.add_word(case, (0, len(case)))
    found.add_word("AKIA", (1, 4))
    for start in CHECKED_STARTS:
        found.add_word(start, (3, len(start)))
    letters, digits = "abcdef", "0123456789"
    # a run of 24 hex digits holds two of them with a digit and another hex digit on each side, or four letters
    for a, b, c in itertools.product(digits + letters, digits, digits + letters):
        found.add_word(a + b + c, (2, 3))
    for four in itertools.product(letters, repeat=4):
        found.add_word("".join(four), (2, 4))
    found.make_automaton()
    return found


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets in ``text`` in code points, by start and kind."""
    found, after = [], [0, 0, 0, 0]
    for end, (kind, length) in automaton().iter(text):
        start = end - length + 1
        if start < after[kind]:
            continue
        if kind == 2:
            # the run may reach back over digits that were no hit
            while start > after[2] and text[start - 1] in "0123456789abcdef":
                start -= 1
            after[2] = stop = HEX.match(text, start).end()
            if stop - start >= LEAST_HEX:
                found.append((start, 2, stop))
        elif kind == 0:
            if match := ASSIGN.match(text, start):
                after[0] = match.end()
                if match.end(1) - match.start(1) >= LEAST_ASSIGN:
                    found.append((start, 0, match.end()))
        elif kind == 1:
            if match := ACCESS.match(text, start):
                after[1] = match.end()
                if match.end() - start >= LEAST_ACCESS:
                    found.append((start, 1, match.end()))
        elif (match := CHECKED.match(text, start)) and checksum(match[2]) == match[3]:
            after[3] = match.end()
            found.append((start, 4 if match[1] == "npm" else 3, match.end()))
    found.sort()
    return found


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: counts of each base kind, the digest of the base spans, and all spans."""
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")

    def judge(batch: pa.RecordBatch):
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = spans_of(text.decode("utf-8", "replace"))
            said = [f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found]
            base = ",".join(x for x, (_, kind, _) in zip(said, found, strict=True) if kind < 3)
            kinds = [kind for _, kind, _ in found]
            rows.append((key, kinds.count(0), kinds.count(1), kinds.count(2),
                         hashlib.sha256(base.encode()).hexdigest(), ",".join(said), kinds.count(3) + kinds.count(4)))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return arrow_map(df.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")),
                     judge, SCHEMA)
