"""Explicit schemas of the tables and files the package reads and writes."""

from pyspark.sql import types as T

TEXT, BYTES, FLAG = T.StringType(), T.BinaryType(), T.BooleanType()
SHORT, INT, LONG, REAL = T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()
TIME, DAY = T.TimestampType(), T.DateType()


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def extended(base: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*base.fields, *schema(**columns).fields])


EVENTS = schema(
    event_id=TEXT, event_type=TEXT, product_id=INT, shade_id=INT, user_id=INT, rating=SHORT, event_ts=TIME, channel=TEXT
)
EVENT_COLUMNS = tuple(EVENTS.fieldNames())
LAKE_EVENTS = extended(EVENTS, dt=DAY)
MESSAGES = schema(
    key=BYTES, value=BYTES, topic=TEXT, partition=INT, offset=LONG, timestamp=TIME,
    headers=T.ArrayType(schema(key=TEXT, value=BYTES)),
)
COUNTERS = ("review_count", "rating_sum", "search_count", "view_count")
PRODUCT_STATS = schema(
    product_id=INT, review_count=LONG, rating_sum=LONG, search_count=LONG, view_count=LONG, last_event_ts=TIME
)
PRODUCTS = schema(
    product_id=INT, brand=TEXT, raw_name=TEXT, category=TEXT, ingredients_text=TEXT, canonical_key=TEXT,
    refreshed_at=TIME,
)
PRODUCT_INGREDIENTS = schema(product_id=INT, position=INT, normalized=TEXT)
SHADES = schema(shade_id=INT, product_id=INT, raw_name=TEXT, canonical_name=TEXT, hex=TEXT, refreshed_at=TIME)
DEAD_LETTERS = schema(
    key=BYTES, value=BYTES, reason=TEXT, source_topic=TEXT, source_partition=INT, source_offset=LONG
)
CATALOG_EXTRACT = schema(code=TEXT, name=TEXT, brand=TEXT, category=TEXT, ingredients_text=TEXT)
CATALOG_EXPORT = ("code", "product_name", "brands", "categories_tags", "ingredients_text")
METRIC_WINDOWS = schema(
    ts=REAL, dt=REAL, processed=LONG, dlq=LONG, lag=LONG, e2e_p50_ms=REAL, e2e_p99_ms=REAL, sink_calls=LONG,
    sink_ms_total=REAL, sink_call_p50_ms=REAL, sink_call_p99_ms=REAL,
)
SAMPLES = schema(
    kind=TEXT, ts=REAL, produced=LONG, stored=LONG, pg_connections=LONG, freshness_s=REAL, replicas=LONG, ready=LONG,
    pg_usage_usec=LONG, pg_throttled_usec=LONG, pg_nr_throttled=LONG,
)
REFRESH_LOG = schema(
    ts=REAL, shades=LONG, distinct_canonical_shades=LONG, products=LONG, distinct_products=LONG, ingredient_rows=LONG,
    distinct_ingredients=LONG, duration_s=REAL,
)
RUN_SUMMARY = schema(
    scenario=TEXT, experiment=TEXT, sent=LONG, t0=REAL, produce_start=REAL, produce_end=REAL, drain_end=REAL,
    drained=FLAG, killed=schema(pod=TEXT, at=REAL),
    producer_stats=schema(sent=LONG, valid=LONG, v1_valid=LONG, bad=LONG, v2=LONG),
    validation=schema(events=LONG, stats_total=LONG, mismatched_products=LONG),
    recovery=schema(redriven=LONG, recovered=FLAG, seconds=REAL),
    final_dlq=schema(total=LONG, by_reason=T.MapType(TEXT, LONG)), restarts=LONG,
)
