"""License scans: a text in canonical form is looked up whole, by its digest, among known licenses.

Canonical form: A-Z in lower case, typographic quotes and dashes as blanks, lines that start with a copyright mark left out,
all ASCII signs but letters and digits as one blank, equivalent spellings written one way. The digest of the whole text
meets the digests of whole licenses in a join; the digest of each whole line meets those of one-line notices in another.

Only columns and joins are used. Known licenses are a small table, but nothing relies on that: Spark joins by the sizes it
measures. What is joined are digests, never texts, and a document sends each different line once.

A null text is an empty text; it has the digest of the empty text and no license. Rows that repeat are judged as one id;
rows with a null id have no notices. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.license_texts import NOTICES, SPELLINGS, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "“”‘’„«»–—… ‑"
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*"
SIGNS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of a text, its lines still apart."""
    x = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BLANKS, LOWER + " " * len(BLANKS))
    x = F.regexp_replace(x, COPYRIGHT_LINE, "$1")
    x = F.regexp_replace(x, SIGNS, " ")
    for one, other in SPELLINGS:
        x = F.replace(x, F.lit(one), F.lit(other))
    return x


def _whole(lines: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(lines, "[ \n]+", " ")), 256)


def known(spark: SparkSession) -> DataFrame:
    """``license``, ``text`` and whether it is a one-line notice, of the licenses that come with this package."""
    rows = [(name, text, False) for name, text in TEXTS.items()]
    rows += [(name, text, True) for name, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "license string, text string, notice boolean")


def scan(df: DataFrame, licenses: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``digest``, ``license`` (of the whole text, or null) and ``notices`` (sorted names, joined by commas)."""
    digests = licenses.select("license", "notice", _whole(canonical_lines(F.col("text"))).alias("known"))
    whole = digests.where(~F.col("notice")).groupBy("known").agg(F.min("license").alias("license"))
    notice = digests.where("notice").groupBy("known").agg(F.min("license").alias("name"))
    rows = df.select(F.col(id_column).alias("doc_id"), canonical_lines(F.col(text_column)).alias("lines"))
    each = F.array_distinct(F.transform(F.split("lines", "\n"), lambda line: F.xxhash64(F.trim(line))))
    short = licenses.where("notice").select(F.xxhash64(F.trim(F.regexp_replace(canonical_lines(F.col("text")), "\n", " "))).alias("short"),
                                            _whole(canonical_lines(F.col("text"))).alias("known")).distinct()
    found = (rows.where("doc_id is not null").select("doc_id", F.explode(each).alias("short")).join(short, "short")
             .join(notice, "known").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices")))
    judged = rows.select("doc_id", _whole(F.col("lines")).alias("digest"))
    return (judged.join(whole, F.col("digest") == F.col("known"), "left").join(found, "doc_id", "left")
            .select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices")))


def oracle() -> str:
    """``scan`` of ``documents`` in DuckDB's SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canonical(column: str) -> str:
        blank = "' ' || " * (len(BLANKS) - 1) + "' '"
        x = f"translate(coalesce({column}, ''), {quoted(UPPER + BLANKS)}, {quoted(LOWER)} || {blank})"
        x = f"regexp_replace({x}, {quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
        x = f"regexp_replace({x}, {quoted(SIGNS)}, ' ', 'g')"
        for one, other in SPELLINGS:
            x = f"replace({x}, {quoted(one)}, {quoted(other)})"
        return x

    rows = [(name, text, "false") for name, text in TEXTS.items()]
    rows += [(name, text, "true") for name, texts in NOTICES.items() for text in texts]
    values = ", ".join(f"({quoted(name)}, {quoted(text)}, {notice})" for name, text, notice in rows)
    whole = "sha256(trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' '))"
    return f"""
WITH known AS (SELECT license, notice, {whole.format(canonical('text'))} AS digest
               FROM (VALUES {values}) AS v(license, text, notice)),
docs AS (SELECT doc_id, {canonical('text')} AS lines FROM documents),
lines AS (SELECT DISTINCT doc_id, sha256(trim(unnest(string_split(lines, chr(10))), ' ')) AS digest FROM docs),
found AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices
          FROM (SELECT DISTINCT doc_id, license FROM lines JOIN known USING (digest) WHERE notice) GROUP BY doc_id),
whole AS (SELECT digest, min(license) AS license FROM known WHERE NOT notice GROUP BY digest)
SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices
FROM (SELECT doc_id, {whole.format('lines')} AS digest FROM docs) d LEFT JOIN whole USING (digest) LEFT JOIN found USING (doc_id)
"""
