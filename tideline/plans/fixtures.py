"""Inputs of the registered queries: product events, payloads, catalog rows, metrics and runs.

Each is a view over the driver's tables, written once as SQL that Spark and DuckDB both run, so a query and its
check start from the same rows.  Every view reads its whole table and has a row or more per row of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# word in braces: (Spark, DuckDB)
_WORDS = {
    "S": ("STRING", "VARCHAR"),
    "MS": ("unix_millis(CAST(ts AS TIMESTAMP))", "epoch_us(ts)//1000"),
    "TS": ("timestamp_millis", "__millis_to_timestamp"),
    "DOUBLE_LIST": ("array(0, 1)", "[0, 1]"),
    "SINGLE_LIST": ("array(0)", "[0]"),
    "EXPLODE": ("explode", "unnest"),
    "NTZ": ("TIMESTAMP_NTZ", "TIMESTAMP"),
}

VIEWS: dict[str, str] = {}

# product events, one per driver event
VIEWS["be"] = """
SELECT md5(concat('7:', CAST(event_id AS {S}))) AS event_id,
 CASE event_type WHEN 'purchase' THEN 'review' WHEN 'signup' THEN 'search' WHEN 'error' THEN 'search' ELSE 'view' END AS event_type,
 CAST(1 + least(event_id * 7919 % 200, event_id * 104729 % 199) AS INT) AS product_id,
 CAST((1 + least(event_id * 7919 % 200, event_id * 104729 % 199)) * 10 + event_id % 6 AS INT) AS shade_id,
 CAST(user_id + 1 AS INT) AS user_id,
 CASE WHEN event_type = 'purchase' THEN CAST(1 + event_id * 31 % 5 AS SMALLINT) END AS rating,
 CAST({MS} AS BIGINT) AS ms,
 CASE event_id % 4 WHEN 1 THEN 'app' WHEN 2 THEN 'web' WHEN 3 THEN 'store' END AS channel,
 event_id AS src_id
FROM events
"""

# delivered at least once: every event, and a copy of each fifth
VIEWS["deliveries"] = """
SELECT event_id, event_type, product_id, shade_id, user_id, rating, {TS}(ms) AS event_ts, channel, src_id, ms,
 {EXPLODE}(CASE WHEN src_id % 5 = 0 THEN {DOUBLE_LIST} ELSE {SINGLE_LIST} END) AS again
FROM be
"""

# the same, where a copy differs, comes later and names another channel
VIEWS["conflicting"] = """
SELECT event_id, event_type, product_id, shade_id, user_id, rating, event_ts,
 CASE WHEN again = 1 THEN 'copy' ELSE channel END AS channel,
 CAST(src_id % 4 AS INT) AS part_no, src_id + again * 100000000 AS pos
FROM deliveries
"""

# what an earlier run stored: the first nine days
VIEWS["stored"] = """
SELECT event_id, event_type, product_id, shade_id, user_id, rating, {TS}(ms) AS event_ts, channel
FROM be WHERE ms < 1704844800000
"""

# payloads as they come from a topic: every third in version 2, some damaged
VIEWS["raw_events"] = """
SELECT src_id, CAST(product_id AS {S}) AS msg_key, CASE src_id % 101
  WHEN 0 THEN substr(p, 1, 60)
  WHEN 1 THEN replace(p, '"product_id"', '"prod"')
  WHEN 2 THEN replace(p, '"event_type":"', '"event_type":"x')
  WHEN 3 THEN concat('{{"schema_version":99,', substr(replace(p, '"schema_version":2,', ''), 2))
  WHEN 4 THEN replace(p, '"shade_id":', '"shade_id":1.5,"z":')
  WHEN 5 THEN '[1,2]'
  WHEN 6 THEN CAST(NULL AS {S})
  WHEN 7 THEN replace(replace(replace(replace(p, '"rating":null', '"rating":11'), '"event_type":"view"', '"event_type":"review"'), '"event_type":"search"', '"event_type":"review"'), '"rating":5', '"rating":6')
  WHEN 8 THEN replace(p, '"product_id":', '"product_id":"N/A","y":')
  WHEN 9 THEN replace(p, '"product_id":', '"product_id":-')
  WHEN 10 THEN concat(p, ' x')
  WHEN 11 THEN replace(p, '"event_id":"', '"event_id":"","w":"')
  WHEN 12 THEN replace(p, '"channel":"', '"channel":7,"v":"')
  ELSE p END AS raw
FROM (SELECT src_id, product_id, CASE WHEN src_id % 3 = 0
 THEN concat('{{"schema_version":2,"event_id":"', event_id, '","event_type":"', event_type, '","product_id":', CAST(product_id AS {S}), ',"shade_id":', CAST(shade_id AS {S}), ',"customer_id":', CAST(user_id AS {S}), ',"rating":', coalesce(CAST(rating AS {S}), 'null'), ',"occurred_at_ms":', CAST(ms AS {S}), ',"channel":"', coalesce(channel, 'app'), '"}}')
 ELSE concat('{{"event_id":"', event_id, '","event_type":"', event_type, '","product_id":', CAST(product_id AS {S}), ',"shade_id":', CAST(shade_id AS {S}), ',"user_id":', CAST(user_id AS {S}), ',"rating":', coalesce(CAST(rating AS {S}), 'null'), ',"produced_at_ms":', CAST(ms AS {S}), '}}') END AS p FROM be) q
"""

# messages with their place in the topic
VIEWS["messages"] = """
SELECT msg_key AS key, raw AS value, 'events' AS topic, CAST(src_id % 4 AS INT) AS part_no, src_id AS pos
FROM raw_events
"""

# dead letters of every message, each second one diverted twice; some do not say where they came from
VIEWS["dead_letters"] = """
SELECT key, value, CASE WHEN again = 1 THEN 'second_time' WHEN pos % 50 <> 49 THEN concat('class_', CAST(pos % 101 AS {S})) END AS reason,
 CASE WHEN pos % 3 <> 0 THEN topic END AS source_topic,
 CASE WHEN pos % 3 <> 0 THEN part_no END AS source_partition,
 CASE WHEN pos % 3 <> 0 THEN pos END AS source_offset,
 pos + again * 100000000 AS dlq_offset
FROM (SELECT *, {EXPLODE}(CASE WHEN pos % 2 = 0 THEN {DOUBLE_LIST} ELSE {SINGLE_LIST} END) AS again FROM messages) q
"""

# what is known of each partition, and what was consumed: all but the last part of it
VIEWS["high_watermarks"] = """
SELECT topic, part_no, max(pos) + 1 AS high FROM messages GROUP BY topic, part_no
"""
VIEWS["consumed"] = """
SELECT topic, part_no, max(CASE WHEN value IS NOT NULL AND length(value) < 200 THEN pos END) + 1 AS next_offset
FROM messages GROUP BY topic, part_no
"""

# shade names under independent distortions, each of which may meet each other: accents, blanks and signs, remarks, codes
VIEWS["shades_raw"] = """
SELECT CAST(p_partkey * 10 AS INT) AS shade_id, CAST(p_partkey AS INT) AS product_id,
 concat(
  CASE WHEN p_partkey % 5 = 2 THEN concat(CAST(100 + p_partkey % 700 AS {S}), ' ') ELSE '' END,
  CASE WHEN p_partkey % 7 = 3 THEN '(new shade) ' ELSE '' END,
  translate(CASE WHEN p_partkey % 3 = 1 THEN translate(p_name, 'aou', 'ăőů') ELSE p_name END, ' ', CASE WHEN p_partkey % 4 = 1 THEN '_' ELSE ' ' END),
  CASE WHEN p_partkey % 11 = 4 THEN ' [limited]' ELSE '' END,
  CASE WHEN p_partkey % 13 IN (5, 6) THEN concat('   ', CAST(p_partkey % 97 AS {S})) ELSE '' END) AS raw_name,
 '#000000' AS hex
FROM part
"""

# a product export with ingredient texts
VIEWS["catalog_raw"] = """
SELECT doc_id, lpad(CAST(doc_id AS {S}), 12, '0') AS code,
 CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' Lumière, Other ' WHEN 2 THEN 'LUMIERE' WHEN 3 THEN 'Dune & Co' ELSE 'Petal Lab' END AS brands,
 CASE doc_id % 7 WHEN 0 THEN 'Mascara Noir' WHEN 1 THEN 'Foundation SPF 30 245 Amber Rose' WHEN 2 THEN 'Vernis (No. 37)'
  WHEN 3 THEN 'Eye makeup remover' WHEN 4 THEN 'MASCARA  NOIR' WHEN 5 THEN 'Hair gel' ELSE 'Rouge Pur 03 Rose' END AS product_name,
 CASE doc_id % 4 WHEN 0 THEN 'en:cosmetics,en:makeup,en:lipstick' WHEN 1 THEN '' WHEN 2 THEN 'en:makeup,en:cosmetics' ELSE 'fr:vernis' END AS categories_tags,
 concat('Ingredients: ', replace(replace(text, '. ', '; '), ' and ', '/')) AS ingredients_text
FROM documents
"""
VIEWS["products_raw"] = """
SELECT CAST(doc_id AS INT) AS product_id, brands AS brand, concat(product_name, ' ', CAST(doc_id % 1000 AS {S})) AS raw_name,
 categories_tags AS category, ingredients_text
FROM catalog_raw
"""

# windows that consumers logged: three runs, one of which may hold any share
VIEWS["metric_windows"] = """
SELECT concat('run-', CAST(event_id % 3 AS {S})) AS scenario, CAST(event_id % 2 AS INT) AS consumer,
 CAST(1704067199.5 AS DOUBLE) + CAST(event_id AS DOUBLE) / CAST(8 AS DOUBLE) AS ts,
 CAST(1 AS DOUBLE) + CAST(event_id % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS dt,
 CASE WHEN event_id % 7 = 0 THEN CAST(0 AS BIGINT) ELSE event_id % 500 END AS processed,
 CASE WHEN event_id % 11 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS dlq,
 event_id * 37 % 12000 AS lag,
 CAST(event_id % 800 AS DOUBLE) / CAST(8 AS DOUBLE) AS e2e_p50_ms,
 CAST(event_id % 4000 AS DOUBLE) / CAST(8 AS DOUBLE) AS e2e_p99_ms,
 event_id % 5 AS sink_calls,
 CAST(event_id % 640 AS DOUBLE) / CAST(8 AS DOUBLE) AS sink_ms_total
FROM events
"""
VIEWS["scenarios"] = """
SELECT scenario, CAST(1704067200 AS DOUBLE) AS t0, CAST(1704067200 AS DOUBLE) + length_s AS produce_end
FROM (SELECT scenario, CAST(count(*) AS DOUBLE) / CAST(8 AS DOUBLE) AS length_s FROM metric_windows GROUP BY scenario) q
"""
VIEWS["refreshes"] = """
SELECT scenario, sink_ms_total / CAST(8 AS DOUBLE) AS duration_s FROM metric_windows WHERE consumer = 1
"""

# samples of many runs of 200 seconds; produced for 60 seconds, stored at a pace that differs by run
VIEWS["run_samples"] = """
SELECT concat('run-', CAST(r AS {S})) AS run, r, k, event_id, CAST(1704067200 AS DOUBLE) + CAST(r AS DOUBLE) * CAST(1000 AS DOUBLE) AS t0
FROM (SELECT event_id, CAST((event_id - event_id % 200) / 200 AS BIGINT) AS r, event_id % 200 AS k FROM events) q
"""
VIEWS["db_samples"] = """
SELECT run, r, t0 + CAST(k AS DOUBLE) AS ts, least(k, 60) * 1000 AS produced,
 CASE WHEN k < 15 + r % 4 THEN least(k * 1000, 14000) ELSE least(least(k, 60) * 1000, k * (650 + 50 * (r % 8))) END AS stored,
 1 + event_id % 3 AS pg_connections,
 CASE WHEN k >= 3 THEN CAST(event_id * 7 % 80 AS DOUBLE) / CAST(8 AS DOUBLE) END AS freshness_s
FROM run_samples
"""
VIEWS["k8s_samples"] = """
SELECT run, t0 + CAST(2 AS DOUBLE) * CAST(k AS DOUBLE) AS ts,
 CASE WHEN event_id % 53 <> 7 THEN 1 + k % 4 END AS ready,
 CASE WHEN event_id % 97 <> 5 THEN k * 250000 + k * k * 1000 END AS pg_usage_usec,
 CASE WHEN event_id % 97 <> 5 THEN k * 125000 END AS pg_throttled_usec
FROM run_samples
"""
VIEWS["runs"] = """
SELECT run, min(t0) AS t0, min(t0) + CAST(60 AS DOUBLE) AS produce_end, min(t0) + CAST(86 + min(r) % 7 AS DOUBLE) AS drain_end,
 CASE WHEN min(r) % 3 < 2 THEN min(t0) + CAST(15 AS DOUBLE) END AS killed_at,
 CAST(60000 AS BIGINT) AS sent, 60000 - min(r) * 237 % 5000 AS stored,
 CASE WHEN min(r) % 2 = 1 THEN min(r) * 237 % 5000 ELSE min(r) * 100 % 900 END AS dead,
 CASE WHEN min(r) % 4 = 2 THEN CAST(150 AS BIGINT) END AS redriven
FROM run_samples GROUP BY run
"""

# writes of a sink, timed
VIEWS["calls"] = """
SELECT scenario, scenario AS sink, e2e_p99_ms + CAST(1 AS DOUBLE) AS ms, processed AS events, ts AS seq FROM metric_windows
"""

_NEEDS = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def needed(name: str) -> list[str]:
    """Views that ``name`` builds on, in order, itself last."""
    found: list[str] = []
    for base in _NEEDS.findall(VIEWS[name]):
        if base in VIEWS:
            found += [view for view in needed(base) if view not in found]
    return [*found, name]


def _text(name: str, engine: int) -> str:
    text = VIEWS[name].format(**{word: pair[engine] for word, pair in _WORDS.items()}).strip()
    if engine == 1:
        text = re.sub(r"__millis_to_timestamp\(ms\)", "make_timestamp(ms*1000)", text)
    return text


def tables(text: str) -> set[str]:
    return {"events", "part", "documents"} & set(_NEEDS.findall(text))


def with_views(names: list[str], engine: int) -> str:
    """WITH clause that defines the given views and what they need."""
    order: list[str] = []
    for name in names:
        order += [view for view in needed(name) if view not in order]
    return ",\n".join(f"{view} AS (\n{_text(view, engine)}\n)" for view in order)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views above as a DataFrame over the Parquet tables in ``sf_dir``."""
    body = with_views([name], 0)
    sources = ", ".join(
        f"{table} AS (SELECT * FROM parquet.`{sf_dir}/{table}.parquet`)" for table in sorted(tables(body))
    )
    return spark.sql(f"WITH {sources}, {body} SELECT * FROM {name}")
