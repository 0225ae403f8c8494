"""Event payloads: encode, decode and validate with built-in expressions.

A payload is parsed once into a VARIANT, which keeps the JSON type of every field apart, and one CASE
chain names the first rule that fails.  ``reason`` is null for a valid event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import fixed_values as fixed

DECODERS = ("strict-v1", "versioned")
_EVENT = ("event_id", "event_type", "product_id", "shade_id", "user_id", "rating", "event_ts", "channel")


# ------------------------------------------------------------------------------------------ encode
def _v1_fields() -> list[Column]:
    return [
        F.col("event_id"), F.col("event_type"), F.col("product_id"), F.col("shade_id"), F.col("user_id"),
        F.col("rating"), F.unix_millis("event_ts").alias("produced_at_ms"),
    ]


def encode_v1() -> Column:
    """Version 1 text of an event row: a null rating is written, a null channel is left out."""
    keep_nulls = {"ignoreNullFields": "false"}
    return F.when(F.col("channel").isNull(), F.to_json(F.struct(*_v1_fields()), keep_nulls)).otherwise(
        F.to_json(F.struct(*_v1_fields(), F.col("channel")), keep_nulls)
    )


def encode_v2() -> Column:
    """Version 2 text of an event row, with the renamed fields and a channel that is never empty."""
    channel = F.coalesce(F.nullif(F.col("channel"), F.lit("")), F.lit(fixed.DEFAULT_CHANNEL))
    return F.to_json(
        F.struct(
            F.lit(2).alias("schema_version"), F.col("event_id"), F.col("event_type"), F.col("product_id"),
            F.col("shade_id"), F.col("user_id").alias("customer_id"), F.col("rating"),
            F.unix_millis("event_ts").alias("occurred_at_ms"), channel.alias("channel"),
        ),
        {"ignoreNullFields": "false"},
    )


def plain_v1(value: Column) -> Column:
    """Version 1 text back to an event struct, without any validation."""
    doc = F.from_json(
        value.cast("string"),
        "event_id string, event_type string, product_id int, shade_id int, user_id int, rating smallint, "
        "produced_at_ms bigint, channel string",
    )
    return F.struct(
        *[doc[name].alias(name) for name in ("event_id", "event_type", "product_id", "shade_id", "user_id", "rating")],
        F.timestamp_millis(doc["produced_at_ms"]).alias("event_ts"), doc["channel"].alias("channel"),
    )


# ------------------------------------------------------------------------------------------ decode
def payload_text(value: Column) -> Column:
    """The payload as text; null when the bytes are not UTF-8. A byte order mark is dropped."""
    text = F.try_validate_utf8(value.cast("string"))
    return F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)


def _parse(df: DataFrame, value: str) -> DataFrame:
    """Add ``_text`` and ``_doc``.

    The parser stops at the end of the first value, so text after a document would go unseen.  Therefore the
    document is parsed as the first of two list elements, and the second must be the hash of the text.
    """
    mark = F.xxhash64("_text")
    pair = F.concat(F.lit("["), F.col("_text"), F.lit(","), mark.cast("string"), F.lit("]"))
    marked = F.try_variant_get("_pair", "$[1]", "bigint") == mark
    return (
        df.withColumn("_text", payload_text(F.col(value)))
        .withColumn("_pair", F.try_parse_json(pair))
        .withColumn("_doc", F.when(marked, F.try_variant_get("_pair", "$[0]", "variant")))
        .drop("_pair")
    )


def _status(value: str) -> Column:
    """Reason of the parse step, null for a JSON object."""
    return (
        F.when(F.col(value).isNull(), "empty_payload")
        .when(F.col("_doc").isNull(), "invalid_json")
        .when(~F.ltrim(F.col("_text"), F.lit(" \t\r\n")).startswith("{"), "not_an_object")
    )


def decode_status(df: DataFrame, value: str = "value") -> DataFrame:
    """``df`` with ``status``: ``ok``, ``empty_payload``, ``invalid_json`` or ``not_an_object``."""
    return _parse(df, value).withColumn("status", F.coalesce(_status(value), F.lit("ok"))).drop("_text", "_doc")


_WIRE = ("schema_version", *fixed.V1_FIELDS, "customer_id", "occurred_at_ms", "channel")
_INTEGERS = ("product_id", "shade_id", "user", "time", "rating")


def _version() -> Column:
    """1 or 2 for a version we read, 0 for any other. An absent version is 1; JSON null is not."""
    field = F.col("_wire.schema_version")
    kind, number = F.schema_of_variant(field), F.try_variant_get(field, "$", "double")
    return (
        F.when(kind.isNull(), 1)
        .when((kind == "BOOLEAN") & F.try_variant_get(field, "$", "boolean"), 1)
        .when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
              F.when(number == 1, 1).when(number == 2, 2).otherwise(0))
        .otherwise(0)
    )


def _first_of(*reasons: str) -> Column:
    """The first column with a reason. (Not ``coalesce``, so that each stays a step of its own in the plan.)"""
    chain = F.when(F.col(reasons[0]).isNotNull(), F.col(reasons[0]))
    for name in reasons[1:]:
        chain = chain.when(F.col(name).isNotNull(), F.col(name))
    return chain


def _step(df: DataFrame, keep: list[str], columns: list) -> DataFrame:
    """``df`` with ``columns`` passed through a list of one.

    The generated code of the two sides ends up in methods of its own, each small enough for the JIT compiler.
    A condition on the result is tested on it and not rewritten in terms of what came before, which would
    decode twice.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def decode(df: DataFrame, decoder: str = "versioned", value: str = "value", both: bool = False) -> DataFrame:
    """``df`` with the eight event columns and ``reason``.

    ``versioned`` reads versions 1 and 2.  ``strict-v1`` takes only documents with exactly the seven
    version 1 fields and calls all others ``schema_mismatch``.  Event columns are null where a
    reason is set.  Columns of ``df`` with the name of an event column are replaced.

    With ``both``, ``versioned`` adds ``strict_reason``, the reason of ``strict-v1``, from the same parsed document: a document
    with exactly the version 1 fields is judged alike by both.

    Texts that only some JSON parsers take are not JSON here: a bare NaN or Infinity, and UTF-16. An ``event_type`` that is a
    list or an object is an unknown type.

    The rules are laid out in two halves of moderate size, see :func:`_step`.
    """
    if decoder not in DECODERS:
        raise ValueError(f"unknown decoder {decoder!r}, expected one of {DECODERS}")
    strict = decoder == "strict-v1"
    keep = [name for name in df.columns if name not in (*_EVENT, "reason")]

    # ---- fields by their wire name, each with its JSON type
    parsed = _parse(df, value).withColumns({
        "_status": _status(value),
        "_wire": F.col("_doc").try_cast("struct<" + ",".join(f"{name}:variant" for name in _WIRE) + ">"),
    })
    names = F.array_sort(F.map_keys(F.col("_doc").try_cast("map<string,variant>")))
    exact = F.coalesce(names == F.array(*[F.lit(name) for name in sorted(fixed.V1_FIELDS)]), F.lit(False))
    if strict:
        mismatch = F.when(~exact, "schema_mismatch")
        parsed = parsed.withColumns({"_status": F.coalesce("_status", mismatch), "_v": F.lit(1)})
    else:
        parsed = parsed.withColumn("_v", _version())
        if both:
            parsed = parsed.withColumn("_exact", exact)
    two = F.col("_v") == 2

    def either(new: Column, old: Column) -> Column:
        return old if strict else F.when(two, new).otherwise(old)

    def wire(name: str) -> Column:
        return F.col(f"_wire.{name}")

    wire_names = {part: F.lit(part) for part in ("event_id", "event_type", "product_id", "shade_id", "rating")}
    wire_names["user"] = either(F.lit("customer_id"), F.lit("user_id"))
    wire_names["time"] = either(F.lit("occurred_at_ms"), F.lit("produced_at_ms"))
    fields = {part: wire(part) for part in ("event_id", "event_type", "product_id", "shade_id", "rating", "channel")}
    fields["user"] = either(wire("customer_id"), wire("user_id"))
    fields["time"] = either(wire("occurred_at_ms"), wire("produced_at_ms"))
    picked = parsed.withColumns({f"_f_{part}": field for part, field in fields.items()}).drop("_wire", "_doc")
    typed = picked.withColumns({
        f"_k_{part}": F.nullif(F.schema_of_variant(f"_f_{part}"), F.lit("VOID")) for part in fields
    })

    typed = _step(typed, keep, [name for name in typed.columns if name not in df.columns])

    def kind(part: str) -> Column:
        return F.col(f"_k_{part}")

    # ---- integers: 1.0, 1e3 and true are none; one beyond 64 bits arrives as DECIMAL or DOUBLE, so its text decides
    def token(part: str) -> Column:
        if part == "user":
            return either(F.get_json_object("_text", "$.customer_id"), F.get_json_object("_text", "$.user_id"))
        if part == "time":
            return either(F.get_json_object("_text", "$.occurred_at_ms"), F.get_json_object("_text", "$.produced_at_ms"))
        return F.get_json_object("_text", f"$.{part}")

    def is_integer(part: str) -> Column:
        other = kind(part).startswith("DECIMAL") | (kind(part) == "DOUBLE")
        return F.when(kind(part) == "BIGINT", True).when(other, token(part).rlike(r"^-?[0-9]+$")).otherwise(False)

    tested = typed.withColumns({f"_i_{part}": F.coalesce(is_integer(part), F.lit(False)) for part in _INTEGERS})
    valued = tested.withColumns({
        **{f"_n_{part}": F.when(F.col(f"_i_{part}"), F.try_variant_get(f"_f_{part}", "$", "bigint")) for part in _INTEGERS},
        "_negative": F.try_variant_get("_f_product_id", "$", "double") <= 0,
        **{f"_t_{part}": F.when(kind(part) == "STRING", F.try_variant_get(f"_f_{part}", "$", "string"))
           for part in ("event_id", "event_type", "channel")},
    })

    # ---- the first rule that fails
    def because(word: str, part: str) -> Column:
        return F.concat(F.lit(word + ":"), wire_names[part])

    def number(part: str) -> Column:
        return F.col(f"_n_{part}")

    def outside(part: str, low: int, high: int) -> Column:
        return ~F.coalesce(number(part).between(low, high), F.lit(False))

    shape = F.when(F.col("_status").isNotNull(), F.col("_status"))
    if not strict:
        shape = shape.when(F.col("_v") == 0, "unsupported_version")
        shape = shape.when(two & kind("channel").isNotNull() & (kind("channel") != "STRING"), "wrong_type:channel")
    missing = F.lit(None).cast("string")
    for part in reversed(("event_id", "event_type", "product_id", "shade_id", "user", "time")):
        missing = F.when(kind(part).isNull(), because("missing_field", part)).otherwise(missing)
    wrong = F.when(F.coalesce(F.col("_t_event_id"), F.lit("")) == "", "wrong_type:event_id")
    wrong = wrong.when(~F.coalesce(F.col("_t_event_type").isin(*fixed.EVENT_TYPES), F.lit(False)), "unknown_event_type")
    for part in ("product_id", "shade_id", "user", "time"):
        wrong = wrong.when(~F.col(f"_i_{part}"), because("wrong_type", part))
    review = F.col("_t_event_type") == "review"
    limits = F.when(F.col("_negative"), "out_of_range:product_id")
    limits = limits.when(review & ~F.col("_i_rating"), "wrong_type:rating")
    limits = limits.when(review & outside("rating", fixed.RATING_MIN, fixed.RATING_MAX), "out_of_range:rating")
    for part in ("product_id", "shade_id", "user"):
        limits = limits.when(outside(part, fixed.INT_MIN, fixed.INT_MAX), because("out_of_range", part))
    limits = limits.when(outside("time", fixed.MS_MIN, fixed.MS_MAX), because("out_of_range", "time"))
    judged = valued.withColumns({"_shape": shape, "_missing": missing}).withColumn("_wrong", wrong)
    judged = judged.withColumn("_limits", limits)
    judged = judged.withColumn("_reason", _first_of("_shape", "_missing", "_wrong", "_limits"))

    def valid(column: Column) -> Column:
        return F.when(F.col("_reason").isNull(), column)

    event = {
        "event_id": valid(F.col("_t_event_id")),
        "event_type": valid(F.col("_t_event_type")),
        "product_id": valid(number("product_id").cast("int")),
        "shade_id": valid(number("shade_id").cast("int")),
        "user_id": valid(number("user").cast("int")),
        "rating": valid(F.when(review, number("rating").cast("smallint"))),
        "event_ts": valid(F.timestamp_millis(number("time"))),
        "channel": valid(F.when(two, F.col("_t_channel"))),
        "reason": F.col("_reason"),
    }
    if both and not strict:
        alike = F.col("_exact") | F.col("_status").isNotNull()
        event["strict_reason"] = F.when(alike, F.col("_reason")).otherwise("schema_mismatch")
    return _step(judged, keep, [column.alias(name) for name, column in event.items()])
