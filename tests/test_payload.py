import json

import pytest
from helpers import START, decoded, document, event_rows, events, raw, same
from pyspark.sql import functions as F

from tideline.functions import payload


def reasons(spark, items, decoder="versioned"):
    return [row["reason"] for row in decoded(spark, items, decoder)]


def test_version_1_is_understood_by_both(spark):
    for decoder in payload.DECODERS:
        row = decoded(spark, [raw()], decoder)[0]
        assert row["reason"] is None
        assert (row["event_id"], row["product_id"], row["user_id"], row["rating"]) == ("e1", 5, 9, 4)
        assert int(row["event_ts"].timestamp() * 1000) == START and row["channel"] is None


def test_version_2_is_understood_by_versioned_only(spark):
    row = decoded(spark, [raw(2)])[0]
    assert row["reason"] is None and row["user_id"] == 9 and row["channel"] == "web"
    assert reasons(spark, [raw(2)], "strict-v1") == ["schema_mismatch"]


@pytest.mark.parametrize("decoder", payload.DECODERS)
def test_garbage(spark, decoder):
    items = [None, b"", b"[1,2]", b"\xff\xfe", b"{} x", b'"text"', b"null", b'1],[2', b'{"a":1},{"b":2}']
    assert reasons(spark, items, decoder) == [
        "empty_payload", "invalid_json", "not_an_object", "invalid_json", "invalid_json", "not_an_object",
        "not_an_object", "invalid_json", "invalid_json",
    ]


def test_rules_in_order(spark):
    view = {"event_type": "view", "rating": None}
    cases = [
        (raw(event_id=None, event_type="x"), "missing_field:event_id"),
        (raw(product_id=...), "missing_field:product_id"),
        (raw(user_id=...), "missing_field:user_id"),
        (raw(2, customer_id=...), "missing_field:customer_id"),
        (raw(2, occurred_at_ms=None), "missing_field:occurred_at_ms"),
        (raw(event_id=""), "wrong_type:event_id"),
        (raw(event_id=7), "wrong_type:event_id"),
        (raw(event_type="purchase", product_id="N/A"), "unknown_event_type"),
        (raw(event_type=["view"]), "unknown_event_type"),
        (raw(product_id="N/A"), "wrong_type:product_id"),
        (raw(product_id=True), "wrong_type:product_id"),
        (raw(product_id=5.0), "wrong_type:product_id"),
        (raw(shade_id=1.5, product_id=0), "wrong_type:shade_id"),
        (raw(2, customer_id="9"), "wrong_type:customer_id"),
        (raw(product_id=0), "out_of_range:product_id"),
        (raw(product_id=-10**25), "out_of_range:product_id"),
        (raw(rating=...), "wrong_type:rating"),
        (raw(rating=True), "wrong_type:rating"),
        (raw(rating=6), "out_of_range:rating"),
        (raw(rating=0), "out_of_range:rating"),
        (raw(rating=10**30), "out_of_range:rating"),
        (raw(2, channel=7, event_id=None), "wrong_type:channel"),
        (raw(2, channel=None), None),
        (raw(schema_version=99), "unsupported_version"),
        (raw(schema_version=None), "unsupported_version"),
        (raw(schema_version="1"), "unsupported_version"),
        (raw(schema_version=True), None),
        (raw(schema_version=1.0), None),
        (raw(channel=7), None),
        (raw(**view), None),
        (raw(event_type="view", rating="any"), None),
        (raw(product_id=2**31), "out_of_range:product_id"),
        (raw(product_id=2**31, rating=9), "out_of_range:rating"),
        (raw(user_id=10**20), "out_of_range:user_id"),
        (raw(produced_at_ms=10**17), "out_of_range:produced_at_ms"),
    ]
    assert reasons(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_a_repeated_key_keeps_its_last_value(spark):
    text = json.dumps(document()).replace('"product_id": 5', '"product_id": 4, "product_id": 6')
    assert decoded(spark, [text.encode()])[0]["product_id"] == 6


def test_rating_is_kept_for_reviews_only(spark):
    assert decoded(spark, [raw(event_type="search", rating=3)])[0]["rating"] is None


def test_strict_wants_exactly_the_seven_fields(spark):
    items = [raw(), raw(channel="web"), raw(rating=...), raw(rating=6)]
    assert reasons(spark, items, "strict-v1") == [None, "schema_mismatch", "schema_mismatch", "out_of_range:rating"]


def test_encode_and_decode_round_trip(spark):
    given = events(spark, event_rows(40, channel=lambda i: "web" if i % 2 else None))
    for encode, decoder in ((payload.encode_v1(), "versioned"), (payload.encode_v2(), "versioned")):
        back = payload.decode(given.select(encode.alias("value")), decoder)
        assert back.where("reason is not null").count() == 0
        kept = ["event_id", "event_type", "product_id", "shade_id", "user_id", "rating", "event_ts"]
        assert same(back.select(kept), given.select(kept))
    plain = given.select(payload.plain_v1(payload.encode_v1()).alias("e")).select("e.*")
    assert same(plain, given)


def test_encoded_shape(spark):
    one, two = events(spark, event_rows(2, channel=lambda i: "web" if i else None)).orderBy("event_id").select(
        payload.encode_v1(), payload.encode_v2()
    ).collect()
    assert list(json.loads(one[0])) == list(document()) and json.loads(one[0])["rating"] is None
    assert list(json.loads(two[0]))[-1] == "channel" and json.loads(one[1])["channel"] == "app"
    assert list(json.loads(two[1])) == ["schema_version", "event_id", "event_type", "product_id", "shade_id",
                                        "customer_id", "rating", "occurred_at_ms", "channel"]


def test_a_condition_on_the_result_does_not_decode_twice(spark):
    df = spark.createDataFrame([(b"{}",)], "value binary")
    plan = payload.decode(df).where("reason is null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_unknown_decoder(spark):
    with pytest.raises(ValueError):
        payload.decode(spark.range(1).select(F.lit("").alias("value")), "v3")
