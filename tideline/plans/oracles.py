"""The same results in DuckDB SQL, query by query, over the same tables."""

from __future__ import annotations

from tideline import fixed_values as fixed
from tideline.plans.fixtures import with_views

# macro text shared by several checks; {x} is the text to work on
_FOLD = "strip_accents({x})"


def _fold(x: str) -> str:
    return _FOLD.format(x=x)


def _words(x: str) -> str:
    return f"trim(regexp_replace({x}, '{fixed.WORD_SEPARATORS}', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _shade(x: str) -> str:
    s = f"regexp_replace(lower({_fold(x)}), '{fixed.PARENTHESES}', ' ', 'g')"
    s = f"trim(regexp_replace({s}, '{fixed.SHADE_SEPARATORS}', ' ', 'g'))"
    s = f"trim(regexp_replace({s}, '{fixed.SHADE_HASH_CODE}', '', 'g'))"
    s = f"regexp_replace({s}, '{fixed.SHADE_LEADING_NO}', '')"
    s = f"regexp_replace({s}, '{fixed.SHADE_TRAILING_CODE}', '')"
    s = f"regexp_replace({s}, '^\\d{{1,3}}\\s+([a-z])', '\\1')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    return f"coalesce(nullif({s}, ''), {_words(f'lower({x})')})"


def _brand(x: str) -> str:
    return _words(f"lower({_fold(f'''split_part({x}, ',', 1)''')})")


def _key(brand: str, name: str) -> str:
    return f"{_brand(brand)} || '|' || {_words(f'lower({_fold(name)})')}"


# without the flags, which DuckDB takes as an argument
_MAKEUP, _NOT_MAKEUP = (pattern.removeprefix("(?iu)") for pattern in (fixed.MAKEUP, fixed.NOT_MAKEUP))


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}', 'i')"


def _category(x: str) -> str:
    tags = f"list_filter(string_split({x}, ','), lambda t: {_is('t', _MAKEUP)})"
    return f"string_split(coalesce({tags}[-1], 'makeup'), ':')[-1]"


def _extract(x: str) -> str:
    name = _strip(x)
    tail = f"nullif(regexp_extract({name}, '(\\d{{2,3}}\\s+[A-Z][\\w''’\\-]+(?:\\s+[A-Z][\\w''’\\-]+){{0,2}})\\s*$', 1), '')"
    number = f"nullif(regexp_extract({name}, '((?:No\\.?|#)\\s?\\d{{1,4}})\\)?\\s*$', 1, 'i'), '')"
    return f"coalesce({tail}, {number})"


# --------------------------------------------------------------------------------- further WITH parts
# one row per event: all copies are equal
_EVENTS = """
deduped AS (
SELECT event_id, any_value(event_type) AS event_type, any_value(product_id) AS product_id, any_value(shade_id) AS shade_id,
 any_value(user_id) AS user_id, any_value(rating) AS rating, any_value(event_ts) AS event_ts, any_value(channel) AS channel
FROM deliveries GROUP BY event_id)"""

_DECODED = """
docs AS (
SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS doc FROM messages),
typed AS (
SELECT *, json_type(doc) AS t_doc, json_type(doc, '$.schema_version') AS t_version, doc ->> '$.schema_version' AS version,
 json_type(doc, '$.event_id') AS t_id, doc ->> '$.event_id' AS v_id, json_type(doc, '$.event_type') AS t_type, doc ->> '$.event_type' AS v_type,
 json_type(doc, '$.product_id') AS t_product, doc ->> '$.product_id' AS v_product,
 json_type(doc, '$.shade_id') AS t_shade, doc ->> '$.shade_id' AS v_shade,
 json_type(doc, '$.user_id') AS t_user1, doc ->> '$.user_id' AS v_user1, json_type(doc, '$.customer_id') AS t_user2, doc ->> '$.customer_id' AS v_user2,
 json_type(doc, '$.produced_at_ms') AS t_time1, doc ->> '$.produced_at_ms' AS v_time1,
 json_type(doc, '$.occurred_at_ms') AS t_time2, doc ->> '$.occurred_at_ms' AS v_time2,
 json_type(doc, '$.rating') AS t_rating, doc ->> '$.rating' AS v_rating,
 json_type(doc, '$.channel') AS t_channel, doc ->> '$.channel' AS v_channel
FROM docs),
ready AS (
SELECT *, CASE WHEN value IS NULL THEN 'empty_payload' WHEN doc IS NULL THEN 'invalid_json' WHEN t_doc <> 'OBJECT' THEN 'not_an_object' END AS status,
 CASE WHEN t_version IS NULL THEN 1 WHEN version IN ('1', '2') AND t_version IN ('UBIGINT', 'BIGINT') THEN CAST(version AS INT) ELSE 0 END AS ver,
 CASE WHEN t_doc = 'OBJECT' THEN list_sort(json_keys(doc)) = list_sort(['event_id', 'event_type', 'product_id', 'shade_id', 'user_id', 'rating', 'produced_at_ms']) END AS exact
FROM typed),
picked AS (
SELECT *, CASE WHEN ver = 2 THEN t_user2 ELSE t_user1 END AS t_user, CASE WHEN ver = 2 THEN v_user2 ELSE v_user1 END AS v_user,
 CASE WHEN ver = 2 THEN t_time2 ELSE t_time1 END AS t_time, CASE WHEN ver = 2 THEN v_time2 ELSE v_time1 END AS v_time,
 CASE WHEN ver = 2 THEN 'customer_id' ELSE 'user_id' END AS n_user, CASE WHEN ver = 2 THEN 'occurred_at_ms' ELSE 'produced_at_ms' END AS n_time
FROM ready),
judged AS (
SELECT *, CASE
 WHEN coalesce(t_id, 'NULL') = 'NULL' THEN 'missing_field:event_id'
 WHEN coalesce(t_type, 'NULL') = 'NULL' THEN 'missing_field:event_type'
 WHEN coalesce(t_product, 'NULL') = 'NULL' THEN 'missing_field:product_id'
 WHEN coalesce(t_shade, 'NULL') = 'NULL' THEN 'missing_field:shade_id'
 WHEN coalesce(t_user, 'NULL') = 'NULL' THEN 'missing_field:' || n_user
 WHEN coalesce(t_time, 'NULL') = 'NULL' THEN 'missing_field:' || n_time
 WHEN t_id <> 'VARCHAR' OR v_id = '' THEN 'wrong_type:event_id'
 WHEN t_type <> 'VARCHAR' OR v_type NOT IN ('view', 'search', 'review') THEN 'unknown_event_type'
 WHEN t_product NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_type:product_id'
 WHEN t_shade NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_type:shade_id'
 WHEN t_user NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_type:' || n_user
 WHEN t_time NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_type:' || n_time
 WHEN CAST(v_product AS HUGEINT) <= 0 THEN 'out_of_range:product_id'
 WHEN v_type = 'review' AND coalesce(t_rating, 'NULL') NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong_type:rating'
 WHEN v_type = 'review' AND CAST(v_rating AS HUGEINT) NOT BETWEEN 1 AND 5 THEN 'out_of_range:rating' END AS fault
FROM picked),
reasons AS (
SELECT *, CASE WHEN status IS NOT NULL THEN status WHEN ver = 0 THEN 'unsupported_version'
  WHEN ver = 2 AND coalesce(t_channel, 'NULL') NOT IN ('NULL', 'VARCHAR') THEN 'wrong_type:channel' ELSE fault END AS reason,
 CASE WHEN status IS NOT NULL THEN status WHEN NOT exact THEN 'schema_mismatch' ELSE fault END AS strict_reason
FROM judged)"""


def _decoded(reason: str) -> str:
    return f"""
SELECT pos, CASE WHEN {reason} IS NULL THEN v_id END AS event_id, CASE WHEN {reason} IS NULL THEN v_type END AS event_type,
 CASE WHEN {reason} IS NULL THEN CAST(v_product AS INT) END AS product_id, CASE WHEN {reason} IS NULL THEN CAST(v_shade AS INT) END AS shade_id,
 CASE WHEN {reason} IS NULL THEN CAST(v_user AS INT) END AS user_id,
 CASE WHEN {reason} IS NULL AND v_type = 'review' THEN CAST(v_rating AS SMALLINT) END AS rating,
 CASE WHEN {reason} IS NULL THEN make_timestamp(CAST(v_time AS BIGINT) * 1000) END AS event_ts,
 CASE WHEN {reason} IS NULL AND ver = 2 THEN v_channel END AS channel, {reason} AS reason FROM reasons"""


_NEW = """
firsts AS (
SELECT event_id, event_type, product_id, shade_id, user_id, rating, event_ts, channel
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part_no, pos) AS rn FROM conflicting) q WHERE rn = 1),
fresh AS (
SELECT * FROM firsts WHERE event_id NOT IN (SELECT event_id FROM stored))"""


def _stats(source: str) -> str:
    return f"""SELECT product_id, CAST(count(*) FILTER (WHERE event_type = 'review') AS BIGINT) AS review_count,
 CAST(coalesce(sum(rating) FILTER (WHERE event_type = 'review'), 0) AS BIGINT) AS rating_sum,
 CAST(count(*) FILTER (WHERE event_type = 'search') AS BIGINT) AS search_count,
 CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS view_count, max(event_ts) AS last_event_ts
FROM {source} GROUP BY product_id"""


_CHECK = f"""
recount AS ({_stats('deduped')}),
kept AS ({_stats('deliveries')}),
wrong AS (
SELECT coalesce(r.product_id, p.product_id) AS product_id,
 r.review_count AS recount_review_count, r.rating_sum AS recount_rating_sum, r.search_count AS recount_search_count, r.view_count AS recount_view_count,
 p.review_count AS stored_review_count, p.rating_sum AS stored_rating_sum, p.search_count AS stored_search_count, p.view_count AS stored_view_count
FROM recount r FULL JOIN kept p ON p.product_id = r.product_id
WHERE r.review_count IS DISTINCT FROM p.review_count OR r.rating_sum IS DISTINCT FROM p.rating_sum
 OR r.search_count IS DISTINCT FROM p.search_count OR r.view_count IS DISTINCT FROM p.view_count)"""

_PARTS = """
chunks AS (
SELECT product_id, c.i AS i, string_split_regex(regexp_replace(ingredients_text, '^\\s*(?:ingredients?|ingr[eé]dients?|inci)\\s*:\\s*', '', 'i'), '[,;•\\n\\r]+')[c.i] AS chunk
FROM products_raw, unnest(range(1, 1 + len(string_split_regex(regexp_replace(ingredients_text, '^\\s*(?:ingredients?|ingr[eé]dients?|inci)\\s*:\\s*', '', 'i'), '[,;•\\n\\r]+')))) AS c(i)
WHERE ingredients_text <> ''),
pieces AS (
SELECT product_id, i, p.j AS j, string_split(regexp_replace(chunk, '[\\s.*†‡]+$', ''), '/')[p.j] AS piece
FROM chunks, unnest(range(1, 1 + len(string_split(regexp_replace(chunk, '[\\s.*†‡]+$', ''), '/')))) AS p(j)),
steps AS (
SELECT product_id, i, j, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(piece)),
  '\\b\\d+([.,]\\d+)?\\s*%', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9/ \\-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' -'), '^ci\\s*(\\d{5})$', 'ci \\1') AS name
FROM pieces),
named AS (
SELECT product_id, i, j, CASE WHEN name IN ('aqua', 'eau') THEN 'water' WHEN name IN ('parfum', 'perfume') THEN 'fragrance'
 WHEN name = 'cera alba' THEN 'beeswax' ELSE name END AS name FROM steps),
mentions AS (
SELECT product_id, name, min(i * 1000000 + j) AS first_at FROM named WHERE length(name) > 1 GROUP BY product_id, name),
ingredients AS (
SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY first_at) - 1 AS INT) AS position, name AS normalized FROM mentions)"""

_FILTERED = f"""
cleaned AS (
SELECT code, {_strip('product_name')} AS product_name, {_strip('brands')} AS brands, categories_tags, ingredients_text FROM catalog_raw),
makeup AS (
SELECT * FROM cleaned WHERE product_name <> '' AND brands <> ''
 AND ({_is('categories_tags', _MAKEUP)} OR {_is('product_name', _MAKEUP)})
 AND NOT ({_is('categories_tags', _NOT_MAKEUP)} OR {_is('product_name', _NOT_MAKEUP)})),
extract_rows AS (
SELECT code, product_name AS name, brands AS brand, {_category('categories_tags')} AS category, {_strip('ingredients_text')} AS ingredients_text
FROM makeup)"""


def _rank(q: float) -> str:
    return f"least(count(*) - 1, CAST(floor(CAST({q} AS DOUBLE) * count(*)) AS BIGINT))"


def _nearest(value: str, q: float) -> str:
    return f"list_sort(list({value}))[1 + {_rank(q)}]"


_SECONDS = """
per_second AS (
SELECT scenario, CAST(trunc(ts - t0) AS BIGINT) AS second, CAST(sum(processed) AS BIGINT) AS processed, sum(processed / greatest(dt, 0.001)) AS rate,
 CAST(sum(lag) AS BIGINT) AS lag, greatest(max(e2e_p99_ms), 0) AS p99_ms, sum(sink_ms_total) AS sink_ms, CAST(sum(sink_calls) AS BIGINT) AS sink_calls
FROM metric_windows JOIN scenarios USING (scenario) GROUP BY 1, 2)"""

_ACTIVE = """
active AS (
SELECT s.*, u.t0, u.killed_at, s.ts - u.t0 AS t, u.produce_end - u.t0 AS produce_s, greatest(u.drain_end - u.produce_end, 0) AS drain_s
FROM db_samples s JOIN runs u USING (run)
WHERE s.ts >= u.t0 - 1 AND s.ts - u.t0 <= (u.produce_end - u.t0) + greatest(u.drain_end - u.produce_end, 0) + 1)"""

_PAIRS = """
pairs AS (
SELECT s.*, u.t0, u.drain_end, lead(ts) OVER w AS next_ts, lead(pg_usage_usec) OVER w AS next_usage, lead(pg_throttled_usec) OVER w AS next_throttled
FROM k8s_samples s JOIN runs u USING (run) WHERE s.ts >= u.t0 - 1 WINDOW w AS (PARTITION BY run ORDER BY ts)),
rates AS (
SELECT run, next_ts - t0 AS t, (next_usage - pg_usage_usec) / 1e6 / (next_ts - ts) AS used, (next_throttled - pg_throttled_usec) / 1e6 / (next_ts - ts) AS throttled
FROM pairs WHERE next_ts IS NOT NULL AND pg_usage_usec IS NOT NULL AND next_usage IS NOT NULL)"""

ORACLES: dict[str, str] = {}


def _oracle(name: str, views: list[str], select: str, *parts: str) -> None:
    clauses = [with_views(views, 1)] if views else []
    clauses += [part.strip() for part in parts]
    ORACLES[name] = (f"WITH {', '.join(clauses)}\n" if clauses else "") + select.strip()


_EVENT_LIST = "event_id, event_type, product_id, shade_id, user_id, rating, event_ts, channel"
_STAT_LIST = "product_id, review_count, rating_sum, search_count, view_count, last_event_ts"

_oracle("event_key", [], "SELECT event_id, md5('7:' || CAST(event_id AS VARCHAR)) AS event_key FROM events")
_oracle("encode_v1", ["be"], """SELECT event_id, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","product_id":' || product_id
 || ',"shade_id":' || shade_id || ',"user_id":' || user_id || ',"rating":' || coalesce(CAST(rating AS VARCHAR), 'null')
 || ',"produced_at_ms":' || ms || coalesce(',"channel":"' || channel || '"', '') || '}' AS payload FROM be""")
_oracle("encode_v2", ["be"], """SELECT event_id, '{"schema_version":2,"event_id":"' || event_id || '","event_type":"' || event_type || '","product_id":'
 || product_id || ',"shade_id":' || shade_id || ',"customer_id":' || user_id || ',"rating":' || coalesce(CAST(rating AS VARCHAR), 'null')
 || ',"occurred_at_ms":' || ms || ',"channel":"' || coalesce(channel, 'app') || '"}' AS payload FROM be""")
_oracle("plain_decode", ["deliveries"], f"SELECT {_EVENT_LIST} FROM deduped", _EVENTS)
_oracle("decode_status", ["messages"], """SELECT pos, CASE WHEN value IS NULL THEN 'empty_payload' WHEN NOT json_valid(value) THEN 'invalid_json'
 WHEN json_type(value) <> 'OBJECT' THEN 'not_an_object' ELSE 'ok' END AS status FROM messages""")
_oracle("decode_strict", ["messages"], _decoded("strict_reason"), _DECODED)
_oracle("decode_versioned", ["messages"], _decoded("reason"), _DECODED)
_oracle("decode_reasons", ["messages"], "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM reasons GROUP BY 1", _DECODED)
_oracle("route_counts", ["messages"], """SELECT decoder, part_no, count(*) FILTER (WHERE reason IS NULL) AS stored, count(*) FILTER (WHERE reason IS NOT NULL) AS dead_letters
FROM (SELECT 'strict-v1' AS decoder, part_no, strict_reason AS reason FROM reasons UNION ALL SELECT 'versioned', part_no, reason FROM reasons) q GROUP BY 1, 2""", _DECODED)
_oracle("outcome_counts", ["messages"], """SELECT count(*) AS sent, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE strict_reason IS NULL) AS v1_valid,
 count(*) FILTER (WHERE reason IS NULL AND strict_reason IS NOT NULL) AS v2, count(*) FILTER (WHERE reason IS NOT NULL) AS bad FROM reasons""", _DECODED)

_oracle("insert_if_new", ["conflicting", "stored"], f"SELECT {_EVENT_LIST} FROM fresh", _NEW)
_oracle("product_stats_delta", ["conflicting", "stored"], _stats("fresh"), _NEW)
_oracle("product_stats_merge", ["conflicting", "stored"], _stats("(SELECT * FROM fresh UNION ALL SELECT * FROM stored) q"), _NEW)
_oracle("product_stats", ["deliveries"], f"SELECT {_STAT_LIST} FROM ({_stats('deduped')}) q", _EVENTS)
_oracle("rollup_mismatches", ["deliveries"], "SELECT * FROM wrong", _EVENTS, _CHECK)
_oracle("validation_summary", ["deliveries"], """SELECT (SELECT count(*) FROM deduped) AS events,
 CAST((SELECT coalesce(sum(review_count + search_count + view_count), 0) FROM kept) AS BIGINT) AS stats_total,
 (SELECT count(*) FROM wrong) AS mismatched_products""", _EVENTS, _CHECK)
_oracle("replay_check", ["conflicting", "stored"], """SELECT state, n AS events, CASE state WHEN 'redelivered' THEN CAST(0 AS BIGINT) ELSE n END AS stats_total, CAST(0 AS BIGINT) AS mismatched_products
FROM (SELECT 'before' AS state, count(DISTINCT event_id) AS n FROM (SELECT event_id FROM conflicting UNION ALL SELECT event_id FROM stored) a
 UNION ALL SELECT 'after', count(DISTINCT event_id) FROM (SELECT event_id FROM conflicting UNION ALL SELECT event_id FROM stored) b
 UNION ALL SELECT 'redelivered', count(*) FROM conflicting) q""")
_oracle("events_deduped", ["deliveries"], f"SELECT {_EVENT_LIST} FROM deduped", _EVENTS)
_oracle("compact_day", ["deliveries"], f"""SELECT dt, {_EVENT_LIST} FROM (SELECT *, CAST(event_ts AS DATE) AS dt,
 row_number() OVER (PARTITION BY CAST(event_ts AS DATE), event_id ORDER BY again) AS rn FROM deliveries) q WHERE rn = 1""")
_oracle("compaction_report", ["deliveries"], """SELECT count(*) AS rows_before, count(DISTINCT event_id) AS distinct_before,
 count(DISTINCT (event_id, CAST(event_ts AS DATE))) AS rows_after FROM deliveries""")
_oracle("answers_agree", ["deliveries"], """SELECT least(20, n) AS left_rows, least(20, n) AS right_rows, CAST(0 AS BIGINT) AS different_rows, true AS identical
FROM (SELECT count(DISTINCT product_id) AS n FROM deliveries WHERE event_type = 'review') q""")

_oracle("top_products", ["deliveries"], """SELECT product_id, count(*) AS reviews, round(avg(rating), 3) AS avg_rating FROM deduped
WHERE event_type = 'review' GROUP BY product_id ORDER BY reviews DESC, product_id LIMIT 20""", _EVENTS)
_oracle("hourly_counts", ["deliveries"], "SELECT CAST(epoch(date_trunc('hour', event_ts)) AS BIGINT) AS hour_epoch, event_type, count(*) AS n FROM deduped GROUP BY 1, 2", _EVENTS)
_oracle("distinct_users_by_shade", ["deliveries"], "SELECT shade_id, count(DISTINCT user_id) AS users FROM deliveries GROUP BY shade_id ORDER BY users DESC, shade_id LIMIT 20")
_oracle("recent_events", ["deliveries"], "SELECT event_id, event_type, event_ts FROM deduped WHERE product_id = 7 ORDER BY event_ts DESC, event_id LIMIT 20", _EVENTS)
_oracle("rollup_one", ["deliveries"], f"""SELECT review_count, round(rating_sum / nullif(review_count, 0), 3) AS avg_rating, 'rollup' AS source FROM ({_stats('deduped')}) q WHERE product_id = 7
UNION ALL SELECT count(*), round(avg(rating), 3), 'events' FROM deduped WHERE product_id = 7 AND event_type = 'review'""", _EVENTS)
_oracle("channel_counts", ["deliveries"], "SELECT coalesce(channel, 'none') AS channel, count(*) AS n FROM deduped GROUP BY 1", _EVENTS)
_oracle("freshness", ["deliveries"], "SELECT (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(event_ts))) / 1e6 AS freshness_s FROM deliveries")

_ORIGIN = "coalesce(source_topic, '') AS source_topic, coalesce(source_partition, -1) AS source_partition, coalesce(source_offset, -1) AS source_offset"
_oracle("dlq_inspect", ["dead_letters"], """SELECT reason, count(*) AS n FROM (SELECT coalesce(reason, 'unknown') AS reason, row_number() OVER (PARTITION BY source_topic, source_partition, source_offset ORDER BY dlq_offset DESC) AS rn
 FROM dead_letters) q WHERE rn = 1 GROUP BY reason""")
_oracle("dlq_redrive", ["dead_letters"], f"""SELECT {_ORIGIN}, key, value FROM (SELECT *, row_number() OVER (PARTITION BY source_topic, source_partition, source_offset ORDER BY dlq_offset) AS rn
 FROM dead_letters) q WHERE rn = 1""")
_oracle("redrive_reconciled", ["messages"], """SELECT count(*) AS sent, count(DISTINCT v_id) FILTER (WHERE strict_reason IS NULL) AS stored_first,
 count(*) FILTER (WHERE strict_reason IS NOT NULL) + count(*) FILTER (WHERE strict_reason IS NOT NULL AND part_no = 2) AS dead_letters,
 count(*) FILTER (WHERE strict_reason IS NOT NULL) AS redriven,
 count(DISTINCT v_id) FILTER (WHERE reason IS NULL) AS stored,
 count(*) FILTER (WHERE strict_reason IS NOT NULL AND reason IS NOT NULL) AS still_bad, CAST(0 AS BIGINT) AS mismatched,
 count(*) - count(DISTINCT v_id) FILTER (WHERE reason IS NULL) - count(*) FILTER (WHERE strict_reason IS NOT NULL AND reason IS NOT NULL) AS missing
FROM reasons""", _DECODED)

_oracle("fold_accents", ["shades_raw"], f"""SELECT 's' || shade_id AS id, {_fold('raw_name')} AS folded FROM shades_raw
UNION ALL SELECT 'd' || doc_id, {_fold('text')} FROM documents""")
_oracle("normalize_shades", ["shades_raw"], f"SELECT shade_id, {_shade('raw_name')} AS canonical_name FROM shades_raw")
_oracle("normalize_brands", ["catalog_raw"], f"SELECT code, {_brand('brands')} AS brand FROM catalog_raw")
_oracle("product_keys", ["products_raw"], f"SELECT product_id, {_key('brand', 'raw_name')} AS canonical_key FROM products_raw")
_oracle("product_ingredients", ["products_raw"], "SELECT * FROM ingredients", _PARTS)
_oracle("extract_shades", ["catalog_raw"], f"SELECT code, {_extract('product_name')} AS shade FROM catalog_raw")
_oracle("catalog_filter", ["catalog_raw"], "SELECT code, product_name, brands, categories_tags FROM makeup", _FILTERED)
_oracle("best_category", ["catalog_raw"], f"SELECT code, {_category('categories_tags')} AS category FROM catalog_raw")
_oracle("catalog_build", ["catalog_raw"], "SELECT * FROM extract_rows", _FILTERED)
_oracle("catalog_ids", ["catalog_raw"], f"""SELECT CAST(id AS INT) AS product_id, code, brand, name AS raw_name, category, CAST(id * 10 AS INT) AS shade_id,
 coalesce({_extract('name')}, 'unspecified') AS shade_name, '#000000' AS hex
FROM (SELECT *, row_number() OVER (ORDER BY code) AS id FROM extract_rows) q""", _FILTERED)
_oracle("refresh_shades", ["shades_raw"], f"""SELECT shade_id, product_id, raw_name, {_shade('raw_name')} AS canonical_name, hex,
 TIMESTAMP '2024-02-01 00:00:00' AS refreshed_at FROM shades_raw""")
_oracle("refresh_products", ["products_raw"], f"""SELECT product_id, brand, raw_name, category, {_key('brand', 'raw_name')} AS canonical_key,
 TIMESTAMP '2024-02-01 00:00:00' AS refreshed_at FROM products_raw""")
_oracle("refresh_report", ["shades_raw", "products_raw"], f"""SELECT (SELECT count(*) FROM shades_raw) AS shades, (SELECT count(DISTINCT {_shade('raw_name')}) FROM shades_raw) AS distinct_canonical_shades,
 (SELECT count(*) FROM products_raw) AS products, (SELECT count(DISTINCT {_key('brand', 'raw_name')}) FROM products_raw) AS distinct_products,
 (SELECT count(*) FROM ingredients) AS ingredient_rows, (SELECT count(DISTINCT normalized) FROM ingredients) AS distinct_ingredients""", _PARTS)
_oracle("duplicate_products", ["catalog_raw"], f"""SELECT canonical_key, count(*) AS entries FROM (SELECT {_key('brands', 'product_name')} AS canonical_key FROM catalog_raw) q
GROUP BY 1 HAVING count(*) > 1""")

_oracle("latency_percentiles", ["metric_windows"], f"""SELECT scenario, consumer, {_nearest('e2e_p99_ms', 0.5)} AS p50, {_nearest('e2e_p99_ms', 0.99)} AS p99
FROM metric_windows GROUP BY scenario, consumer""")
_oracle("ingest_windows", ["deliveries"], f"""SELECT window_s, count(*) FILTER (WHERE event_type <> 'search') AS processed, count(*) FILTER (WHERE event_type = 'search') AS dlq,
 count(*) AS sink_calls, sum(call_ms) AS sink_ms_total, coalesce(any_value(g.e2e_p50_ms), 0) AS e2e_p50_ms, coalesce(any_value(g.e2e_p99_ms), 0) AS e2e_p99_ms,
 {_nearest('call_ms', 0.5)} AS sink_call_p50_ms, {_nearest('call_ms', 0.99)} AS sink_call_p99_ms
FROM happened LEFT JOIN (SELECT window_s, {_nearest('e2e_ms', 0.5)} AS e2e_p50_ms, {_nearest('e2e_ms', 0.99)} AS e2e_p99_ms
 FROM happened WHERE event_type <> 'search' GROUP BY window_s) g USING (window_s) GROUP BY window_s""",
        """happened AS (SELECT event_type, CAST((ms + src_id * 37 % 4000) // 3600000 * 3600 AS BIGINT) AS window_s, CAST(src_id * 37 % 4000 AS DOUBLE) AS e2e_ms,
 product_id / 8 AS call_ms FROM deliveries)""")
_oracle("lag_by_partition", ["high_watermarks", "consumed"], """SELECT topic, part_no, greatest(coalesce(high, 0) - coalesce(next_offset, 0), 0) AS lag
FROM high_watermarks FULL JOIN consumed USING (topic, part_no)""")
_oracle("run_seconds", ["metric_windows", "scenarios"], "SELECT scenario, second, processed, round(rate, 6) AS rate, lag, p99_ms, sink_ms, sink_calls FROM per_second", _SECONDS)
_oracle("run_summary", ["metric_windows", "scenarios", "refreshes"], """SELECT scenario, produce_s, round(coalesce(during, 0) / greatest(produce_s, 1), 6) AS throughput, peak_lag,
 greatest(coalesce(busy, 0) - produce_s, 0) AS drain_s, round(sink / nullif(total, 0), 6) AS sink_ms_per_event, coalesce(n, 0) AS batch_refreshes, round(mean_s, 6) AS batch_mean_s
FROM (SELECT scenario, produce_end - t0 AS produce_s FROM scenarios) k
LEFT JOIN (SELECT scenario, sum(processed) FILTER (WHERE second >= 0 AND second <= produce_end - t0) AS during, max(lag) AS peak_lag, max(second) FILTER (WHERE processed > 0) AS busy,
  sum(sink_ms) AS sink, sum(processed) AS total FROM per_second JOIN scenarios USING (scenario) GROUP BY scenario) p USING (scenario)
LEFT JOIN (SELECT scenario, count(*) AS n, avg(duration_s) AS mean_s FROM refreshes GROUP BY scenario) b USING (scenario)""", _SECONDS)
_oracle("backlog", ["db_samples", "runs"], """SELECT run, coalesce(peak, 0) AS peak_backlog, greatest(drain_end - produce_end, 0) AS drain_s
FROM runs LEFT JOIN (SELECT run, max(produced - stored) AS peak FROM active GROUP BY run) q USING (run)""", _ACTIVE)
_oracle("backlog_series", ["db_samples", "runs"], "SELECT run, t, produced - stored AS backlog FROM active", _ACTIVE)
_oracle("staleness", ["db_samples", "k8s_samples", "runs"], """SELECT run, coalesce(stale, 0) AS peak_staleness_s, coalesce(connections, 0) AS peak_connections, coalesce(ready, 0) AS peak_ready
FROM runs LEFT JOIN (SELECT run, max(coalesce(freshness_s, 0)) FILTER (WHERE t <= produce_s + drain_s) AS stale, max(pg_connections) AS connections FROM active GROUP BY run) a USING (run)
LEFT JOIN (SELECT run, max(coalesce(ready, 0)) AS ready FROM k8s_samples JOIN runs USING (run) WHERE ts >= t0 - 1 GROUP BY run) b USING (run)""", _ACTIVE)
_oracle("counter_rates", ["k8s_samples", "runs"], "SELECT run, t, round(used, 6) AS used, round(throttled, 6) AS throttled FROM rates", _PAIRS)
_oracle("throttled_total", ["k8s_samples", "runs"], "SELECT run, round(coalesce(sum(throttled), 0), 6) AS throttled_s FROM rates GROUP BY run", _PAIRS)
_oracle("pod_seconds", ["k8s_samples", "runs"], """SELECT run, coalesce(area, 0) AS pod_seconds FROM runs LEFT JOIN
 (SELECT run, sum((next_ts - ts) * coalesce(ready, 0)) AS area FROM pairs WHERE next_ts IS NOT NULL AND ts <= drain_end GROUP BY run) q USING (run)""", _PAIRS)
_oracle("recovery_time", ["db_samples", "runs"], """SELECT k.run AS run, min(b.t) - any_value(k.kill_t) AS recovery_s
FROM (SELECT run, killed_at - t0 AS kill_t FROM runs WHERE killed_at IS NOT NULL) k
LEFT JOIN (SELECT run, min(t) AS peak_t FROM (SELECT *, max(produced - stored) OVER (PARTITION BY run) AS peak FROM active WHERE t >= killed_at - t0) s
 WHERE produced - stored = peak AND t > killed_at - t0 GROUP BY run) p ON p.run = k.run
LEFT JOIN (SELECT run, t, produced - stored AS backlog FROM active) b ON b.run = k.run AND b.backlog < 1000 AND b.t > k.kill_t + 1 AND b.t > p.peak_t
GROUP BY k.run""", _ACTIVE)
_oracle("worst_p99", ["metric_windows", "scenarios"], "SELECT scenario, second, p99_ms / 1000 AS p99_s FROM per_second", _SECONDS)
_oracle("peak_p99", ["metric_windows", "scenarios"], "SELECT scenario, max(p99_ms) / 1000 AS peak_p99_s FROM per_second GROUP BY scenario", _SECONDS)
_oracle("reconcile", ["runs"], """SELECT run, sent, stored, dead, coalesce(redriven, 0) AS redriven, sent - (stored + dead - coalesce(redriven, 0)) AS missing FROM runs""")
_oracle("compare_runs", ["runs"], """SELECT coalesce(a.run, b.run) AS run, CASE WHEN a.run IS NULL THEN 'not run' ELSE 'run' END AS a_outcome, a.sent AS a_sent, a.stored AS a_stored, a.dead AS a_dead,
 CASE WHEN b.run IS NULL THEN 'not run' ELSE 'run' END AS b_outcome, b.sent AS b_sent, b.stored AS b_stored, b.dead AS b_dead
FROM (SELECT * FROM runs WHERE killed_at IS NOT NULL) a FULL JOIN (SELECT * FROM runs WHERE dead > 500) b ON a.run = b.run""")
_oracle("call_summary", ["calls"], f"""SELECT sink, count(*) AS calls, round(sum(ms) / 1000, 6) AS total_s, round(avg(ms), 6) AS mean_ms,
 {_nearest('ms', 0.5)} AS p50_ms, {_nearest('ms', 0.99)} AS p99_ms, round(sum(events) / (sum(ms) / 1000), 6) AS events_per_s FROM calls GROUP BY sink""")
_oracle("query_times", ["calls"], "SELECT sink, count(*) AS n, median(ms) AS median_ms, min(ms) AS min_ms, arg_min(ms, seq) AS first_ms FROM calls GROUP BY sink")
_oracle("completion", ["db_samples", "runs"], """SELECT run, coalesce(p, 0) AS processed, coalesce(s, 0) AS stored, coalesce(p, 0) >= 400 AS drained, coalesce(s, -1) >= stored AS recovered
FROM runs LEFT JOIN (SELECT run, CAST(sum(pg_connections) AS BIGINT) AS p, arg_max(stored, ts) AS s FROM db_samples GROUP BY run) q USING (run)""")
