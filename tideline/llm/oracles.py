"""The results of those operators that SQL can express, in DuckDB's SQL. Others are tested against brute force."""

from __future__ import annotations

from tideline.llm import decontamination, licenses, line_dedup, secrets, substring_dedup

BLANK = r"\x20\x09-\x0D"
UPPER, LOWER = licenses.UPPER, licenses.LOWER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines() -> str:
    ends = f"'^[{BLANK}]+|[{BLANK}]+$'"
    return f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, {ends}, '', 'g'), '{UPPER}', '{LOWER}') AS key FROM lines),
repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {line_dedup.LEAST} GROUP BY key
             HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, n, line, coalesce(first <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _windows() -> str:
    size = substring_dedup.SIZE
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {size - 1}], ' ') AS k FROM places),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS p FROM windows JOIN firsts USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p)
         GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def _contaminated() -> str:
    span, window = decontamination.SPAN, decontamination.WINDOW
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

    def seeds(table: str, key: str) -> str:
        masks = " UNION ALL ".join(
            f"SELECT {key}, ws, pos, {m} AS mask, concat_ws(' ', {', '.join(f'ws[pos + {o + 1}]' for o in mask)}) AS seed FROM {table}"
            for m, mask in enumerate(decontamination.MASKS))
        return f"({masks})"

    return f"""
WITH d AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {span - 1})) AS pos FROM (SELECT doc_id, {words} AS ws FROM documents)),
i AS (SELECT item_id, ws, unnest(range(0, len(ws) - {span - 1})) AS pos FROM (SELECT item_id, {words} AS ws FROM benchmark)),
hits AS (SELECT doc_id, item_id, x.ws AS dw, y.ws AS iw, x.pos AS da, y.pos AS ia, least(x.pos, y.pos, {window - 1}) AS back,
  least(len(x.ws) - x.pos, len(y.ws) - y.pos, {span + window}) AS tail, least(len(y.ws), {window}) AS width
 FROM {seeds('d', 'doc_id')} x JOIN {seeds('i', 'item_id')} y ON x.mask = y.mask AND x.seed = y.seed),
compared AS (SELECT *, list_transform(range(-back, tail), lambda r: CAST(dw[da + r + 1] = iw[ia + r + 1] AS INT)) AS eq FROM hits)
SELECT doc_id, item_id, count(*) AS n_seeds, CAST(min(da) AS BIGINT) AS first_word, CAST(max(da) + {span - 1} AS BIGINT) AS last_word
FROM compared
WHERE len(list_filter(range(0, back + tail - width + 1),
 lambda s: list_sum(eq[s + 1:s + width]) >= width - CAST(floor(width * {decontamination.TOLERATED}) AS INT))) > 0
GROUP BY doc_id, item_id
"""


def _secrets() -> str:
    """Spans from the lengths of what lies between matches; runs of hex digits are asked for at their least length."""
    kinds = (
        (0, secrets.ASSIGN.pattern, f"length(part) >= {secrets.LEAST_ASSIGN}", 1),
        (1, secrets.ACCESS.pattern, f"length(part) >= {secrets.LEAST_ACCESS}", 0),
        (2, f"[0-9a-f]{{{secrets.LEAST_HEX},}}", "true", 0),
        (3, "(?:gh[opsur]|npm)_[0-9A-Za-z]+", "length(part) = 40 AND right(part, 6) = " + " || ".join(
            f"substr('{secrets.BASE62}', CAST(crc // {62 ** k} % 62 + 1 AS INT), 1)" for k in range(5, -1, -1)), 0),
    )
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {kind} AS kind, regexp_extract_all(t, {_quoted(pattern)}, 0) AS ms, regexp_extract_all(t, {_quoted(pattern)}, {group}) AS gs,"
        f" string_split_regex(t, {_quoted(pattern)}) AS ps FROM docs" for kind, pattern, _, group in kinds)
    keep = " OR ".join(f"kind = {kind} AND {rule}" for kind, _, rule, _ in kinds)
    bits = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    said = ", ".join(f"'{kind}'" for kind in secrets.KINDS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: {bits}, CAST(n AS BIGINT))) AS tab),
found AS ({parts}),
each AS (SELECT doc_id, kind, ms, ps, gs[i] AS part, i FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)),
placed AS (SELECT doc_id, kind, part, ms[i] AS hit,
  CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
  xor(list_reduce(list_transform(string_split(substr(part, 5, 30), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
 FROM each, steps),
spans AS (SELECT doc_id, start, CASE WHEN kind = 3 AND hit LIKE 'npm%' THEN 4 ELSE kind END AS kind, start + length(hit) AS stop
 FROM placed WHERE {keep}),
named AS (SELECT *, [{said}][kind + 1] || ':' || start || ':' || stop AS said FROM spans)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
 count(*) FILTER (WHERE kind = 2) AS n_hex,
 sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
 coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (WHERE kind > 2) AS n_checked
FROM docs LEFT JOIN named USING (doc_id) GROUP BY doc_id
"""


ORACLES = {
    "op1_decontamination": _contaminated(),
    "op2_secrets": _secrets(),
    "op3_line_dedup": _lines(),
    "op5_licenses": licenses.oracle(),
    "op9_substring_dedup": _windows(),
}
