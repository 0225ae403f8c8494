"""Small event sets for tests."""

import json
from datetime import datetime, timezone

from tideline.functions import payload
from tideline.operators import agreement
from tideline.tables import EVENTS, MESSAGES

START = 1_700_000_000_000


def event_rows(n, first=0, seed=3, step_ms=1000, channel=None):
    """Deterministic events; every fourth is a review, ids depend on seed and index only."""
    rows = []
    for i in range(first, first + n):
        kind = ("view", "search", "view", "review")[i % 4]
        product = 1 + i * 7919 % 50
        rows.append((
            f"{seed:04d}-{i:08d}", kind, product, product * 10 + i % 6, 1 + i * 31 % 997,
            1 + i % 5 if kind == "review" else None,
            datetime.fromtimestamp((START + i * step_ms) / 1000, tz=timezone.utc),
            channel(i) if channel else None,
        ))
    return rows


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def document(version=1, **changes):
    doc = {"event_id": "e1", "event_type": "review", "product_id": 5, "shade_id": 51, "user_id": 9, "rating": 4,
           "produced_at_ms": START}
    if version == 2:
        doc["customer_id"], doc["occurred_at_ms"] = doc.pop("user_id"), doc.pop("produced_at_ms")
        doc = {"schema_version": 2, **doc, "channel": "web"}
    doc.update(changes)
    return {k: v for k, v in doc.items() if v is not ...}


def raw(version=1, **changes):
    return json.dumps(document(version, **changes)).encode()


def decoded(spark, payloads, decoder="versioned"):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, value binary")
    return [row.asDict() for row in payload.decode(df, decoder).orderBy("i").collect()]


def write_messages(spark, folder, payloads, first_offset=0, partition=0, topic="events"):
    """Append payloads to a folder of message files, as a topic partition would hold them."""
    rows = [(f"k{i}".encode(), value, topic, partition, first_offset + i,
             datetime.fromtimestamp(START / 1000, tz=timezone.utc), None) for i, value in enumerate(payloads)]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(folder)


def payloads(spark, rows, version=1):
    encode = payload.encode_v1() if version == 1 else payload.encode_v2()
    return [r[0].encode() for r in events(spark, rows).orderBy("event_id").select(encode.alias("value")).collect()]


def summary(df):
    return df.first().asDict()


def same(left, right):
    """Equal as bags of rows."""
    return agreement.agree(left, right).first()["identical"]
