import pathlib
import shutil

import pytest
from helpers import event_rows, events, payloads, raw, summary, write_messages
from pyspark.sql import functions as F

from tideline.operators import analytics, deadletters, metrics, rollup
from tideline.sources import claims, id_index, lake, store, topics
from tideline.streaming import ingest
from tideline.streaming.ingest import BadEvent, Ingest


@pytest.fixture
def place(tmp_path):
    return {name: str(tmp_path / name) for name in ("topic", "store", "check", "check2", "check3", "lake")}


def run(spark, job, place, checkpoint="check", max_files=None):
    query = job.start(topics.file_stream(spark, place["topic"], max_files), place[checkpoint])
    query.awaitTermination()


def counts(spark, place):
    return summary(store.validate(spark, place["store"]))


def test_overlap_and_replay(spark, place):
    data = payloads(spark, event_rows(300))
    for part in (data, data[100:250], data):
        write_messages(spark, place["topic"], part)
    job = Ingest(place["store"], run="a")
    run(spark, job, place, max_files=1)
    expected = {"events": 300, "stats_total": 300, "mismatched_products": 0}
    assert counts(spark, place) == expected
    assert store.commits(spark, place["store"]).count() == 3
    # a fresh reader of the whole topic changes nothing
    run(spark, Ingest(place["store"], run="b"), place, checkpoint="check2")
    assert counts(spark, place) == expected
    log = store.commits(spark, place["store"]).groupBy("run").agg(F.sum("processed"), F.sum("inserted")).collect()
    assert sorted(map(tuple, log)) == [("a", 750, 300), ("b", 750, 0)]
    # and neither does folding the deltas
    assert store.fold(spark, place["store"]) == 1
    assert counts(spark, place) == expected
    write_messages(spark, place["topic"], payloads(spark, event_rows(20, first=400)))
    run(spark, job, place)
    assert counts(spark, place)["stats_total"] == 320 and store.fold(spark, place["store"]) == 2
    expected = {"events": 320, "stats_total": 320, "mismatched_products": 0}
    assert counts(spark, place) == expected and store.fold(spark, place["store"]) == 2
    assert {r["batch_id"] for r in store.events(spark, place["store"]).collect()} == {0, 3}
    # folded batches are not needed any more, and still count as stored
    for table in ("events", "deltas", "commits"):
        shutil.rmtree(f"{place['store']}/{table}")
    assert counts(spark, place) == expected
    run(spark, Ingest(place["store"], run="c"), place, checkpoint="check3")
    assert counts(spark, place) == expected


@pytest.mark.parametrize("table", ["events", "deltas", "commits"])
def test_a_crash_between_writes_leaves_no_trace(spark, place, monkeypatch, table):
    write_messages(spark, place["topic"], payloads(spark, event_rows(60)))
    job = Ingest(place["store"], run="a")
    original = store.batch_folder

    def failing(root, name, run_name, batch_id):
        if name == table:
            raise RuntimeError("executor lost")
        return original(root, name, run_name, batch_id)

    monkeypatch.setattr(store, "batch_folder", failing)
    with pytest.raises(Exception, match="executor lost"):
        run(spark, job, place)
    monkeypatch.undo()
    assert counts(spark, place) == {"events": 0, "stats_total": 0, "mismatched_products": 0}
    # an other run in between must not take the unfinished rows for stored ones
    run(spark, Ingest(place["store"], run="b"), place, checkpoint="check2")
    assert counts(spark, place)["stats_total"] == 60
    run(spark, job, place)
    assert counts(spark, place) == {"events": 60, "stats_total": 60, "mismatched_products": 0}


def test_first_write_wins(spark, place):
    write_messages(spark, place["topic"], [raw(rating=1), raw(rating=2)], first_offset=10)
    write_messages(spark, place["topic"], [raw(rating=5)], first_offset=3)
    run(spark, Ingest(place["store"], run="a"), place)
    assert [r["rating"] for r in store.events(spark, place["store"]).collect()] == [5]


def test_fail_policy_stores_nothing_of_the_batch(spark, place):
    write_messages(spark, place["topic"], [raw(), b"{", raw(event_id="e2")])
    with pytest.raises(Exception, match=r"invalid_json at events\[0\]@1"):
        run(spark, Ingest(place["store"], run="a", on_bad="fail"), place)
    assert counts(spark, place)["events"] == 0
    # the offsets did not advance: the same checkpoint goes on when the reader is fixed
    run(spark, Ingest(place["store"], run="a", on_bad="dlq"), place)
    assert counts(spark, place)["events"] == 2


def test_skip_policy_still_counts(spark, place):
    write_messages(spark, place["topic"], [raw(), b"{", None])
    run(spark, Ingest(place["store"], run="a", on_bad="skip"), place)
    assert store.commits(spark, place["store"]).select("processed", "inserted", "dlq").collect() == [(1, 1, 2)]
    assert store.dead_letters(spark, place["store"]).count() == 0


def test_strict_reader_then_redrive(spark, place):
    one, two = payloads(spark, event_rows(40)), payloads(spark, event_rows(60, first=40), version=2)
    write_messages(spark, place["topic"], [*one, *two])
    run(spark, Ingest(place["store"], run="strict", decoder="strict-v1"), place)
    letters = store.dead_letters(spark, place["store"])
    assert counts(spark, place)["events"] == 40
    totals = deadletters.inspect_totals(letters).first()
    assert (totals["total"], totals["by_reason"]) == (60, {"schema_mismatch": 60})
    again = deadletters.redrive(letters).orderBy("source_offset").collect()
    assert [bytes(r["value"]) for r in again] == two and bytes(again[0]["key"]) == b"k40"
    write_messages(spark, place["topic"], [bytes(r["value"]) for r in again], first_offset=100)
    run(spark, Ingest(place["store"], run="versioned"), place, checkpoint="check2")
    assert counts(spark, place) == {"events": 100, "stats_total": 100, "mismatched_products": 0}


def test_dedupe_by_days(spark, place):
    data = payloads(spark, event_rows(100))
    write_messages(spark, place["topic"], [*data, b"{", *data[:50]])
    write_messages(spark, place["topic"], [*data[20:60], b"["], first_offset=500)
    run(spark, Ingest(place["store"], run="a", dedupe="days"), place, max_files=1)
    assert counts(spark, place) == {"events": 100, "stats_total": 100, "mismatched_products": 0}
    assert store.dead_letters(spark, place["store"]).count() == 2


def test_noop_and_lake_sinks(spark, place):
    write_messages(spark, place["topic"], [*payloads(spark, event_rows(30)), b"{"])
    ingest.start_noop(topics.file_stream(spark, place["topic"]), place["check"]).awaitTermination()
    ingest.start_lake(topics.file_stream(spark, place["topic"]), place["lake"], place["check2"]).awaitTermination()
    assert lake.read_events(spark, place["lake"]).count() == 30


def test_late_and_far_future_events_are_accounted_for(spark, place):
    far = raw(event_id="far", produced_at_ms=250_000_000_000_000)
    write_messages(spark, place["topic"], [*payloads(spark, event_rows(5)), far])
    run(spark, Ingest(place["store"], run="a"), place)
    write_messages(spark, place["topic"], [*payloads(spark, event_rows(50, first=100)), *[b"junk"] * 7], first_offset=50)
    run(spark, Ingest(place["store"], run="a", dedupe="days"), place)
    assert counts(spark, place) == {"events": 56, "stats_total": 56, "mismatched_products": 0}
    assert store.dead_letters(spark, place["store"]).count() == 7
    done = store.commits(spark, place["store"]).agg(F.sum("processed"), F.sum("dlq")).first()
    assert tuple(done) == (56, 7)


def test_lake_keeps_rejected_messages(spark, place):
    write_messages(spark, place["topic"], [*payloads(spark, event_rows(9)), b"{", None])
    ingest.start_lake(topics.file_stream(spark, place["topic"]), place["lake"], place["check"]).awaitTermination()
    letters = store.dead_letters(spark, place["lake"])
    assert {r["reason"] for r in deadletters.inspect(letters).collect()} == {"invalid_json", "empty_payload"}
    assert store.commits(spark, place["lake"]).select("processed", "dlq").collect() == [(9, 2)]
    with pytest.raises(Exception, match="invalid_json"):
        ingest.start_lake(topics.file_stream(spark, place["topic"]), place["lake"], place["check2"], on_bad="fail").awaitTermination()
    assert lake.read_events(spark, place["lake"], dedupe=False).count() == 9


def test_a_message_diverted_by_two_runs(spark, place):
    write_messages(spark, place["topic"], payloads(spark, event_rows(3), version=2) + [b"{"])
    run(spark, Ingest(place["store"], run="z-first", decoder="strict-v1"), place)
    run(spark, Ingest(place["store"], run="a-second"), place, checkpoint="check2")
    letters = store.dead_letters(spark, place["store"])
    assert letters.count() == 5
    assert {tuple(r) for r in deadletters.inspect(letters).collect()} == {("schema_mismatch", 3), ("invalid_json", 1)}
    assert deadletters.redrive(letters).count() == 4


def test_the_store_feeds_the_ingest_windows(spark, place):
    write_messages(spark, place["topic"], [*payloads(spark, event_rows(30)), b"{", b"["])
    write_messages(spark, place["topic"], payloads(spark, event_rows(20, first=40)), first_offset=90)
    run(spark, Ingest(place["store"], run="a"), place, max_files=1)
    windows = metrics.ingest_windows(*store.ingest_inputs(spark, place["store"]))
    got = windows.agg(F.sum("processed"), F.sum("dlq"), F.sum("sink_calls"), F.min("e2e_p50_ms")).first()
    assert tuple(got)[:3] == (50, 2, 2) and got[3] >= 0


def test_days_are_utc_in_any_session(spark, place):
    before = spark.conf.get("spark.sql.session.timeZone")
    from tideline.functions.columns import event_day

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        days = spark.sql("SELECT timestamp_millis(1704074400000) AS t UNION ALL SELECT timestamp_millis(-1)").select(
            event_day(F.col("t")).cast("string").alias("d")).collect()
        assert {r["d"] for r in days} == {"2024-01-01", "1969-12-31"}
        write_messages(spark, place["topic"], [raw(produced_at_ms=1704074400000)])
        ingest.start_lake(topics.file_stream(spark, place["topic"]), place["lake"], place["check"]).awaitTermination()
        assert str(lake.read_events(spark, place["lake"]).first()["dt"]) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dead_letter_headers_round_trip(spark):
    letters = spark.createDataFrame(
        [(b"k", b"v", "invalid_json", "events", 2, 7)],
        "key binary, value binary, reason string, source_topic string, source_partition int, source_offset bigint")
    messages = topics.dead_letter_messages(letters).withColumn("offset", F.lit(0))
    assert topics.dead_letters_of(messages).drop("dlq_offset").collect() == letters.collect()
    bare = messages.withColumn("headers", F.lit(None).cast("array<struct<key:string,value:binary>>"))
    assert topics.dead_letters_of(bare).select("reason", "source_topic").first() == (None, None)


def test_letters_without_an_origin_collapse(spark):
    rows = [(b"a", b"1", None, None, None, None, 5), (b"b", b"2", "x", None, None, None, 9), (b"c", b"3", "y", "t", 0, 1, 7)]
    letters = spark.createDataFrame(rows, "key binary, value binary, reason string, source_topic string, "
                                          "source_partition int, source_offset bigint, dlq_offset bigint")
    assert {tuple(r) for r in deadletters.inspect(letters).collect()} == {("x", 1), ("y", 1)}
    assert {bytes(r["value"]) for r in deadletters.redrive(letters).collect()} == {b"1", b"3"}
    totals = deadletters.inspect_totals(letters.limit(0)).first()
    assert totals["total"] == 0 and totals["by_reason"] == {}


def test_kafka_options():
    options = topics.kafka_options("host:1", "t", startingOffsets="earliest")
    assert options["subscribe"] == "t" and options["startingOffsets"] == "earliest"


def test_last_event_ts_is_not_compared(spark):
    given = events(spark, event_rows(20))
    stats = rollup.product_stats(given)
    assert rollup.mismatches(given, stats.withColumn("last_event_ts", F.lit(None).cast("timestamp"))).count() == 0
    assert rollup.mismatches(given, stats.withColumn("view_count", F.col("view_count") + 1)).count() == stats.count()


def test_wrong_settings():
    with pytest.raises(ValueError):
        Ingest("x", "r", on_bad="ignore")
    with pytest.raises(ValueError):
        Ingest("x", "r", dedupe="watermark")
    assert issubclass(BadEvent, Exception)


def test_a_run_name_used_again_with_a_new_checkpoint(spark, place):
    write_messages(spark, place["topic"], payloads(spark, event_rows(10)))
    run(spark, Ingest(place["store"], run="a"), place)
    write_messages(spark, place["lake"], payloads(spark, event_rows(10, first=50)))
    query = Ingest(place["store"], run="a").start(topics.file_stream(spark, place["lake"]), place["check2"])
    query.awaitTermination()
    assert counts(spark, place) == {"events": 20, "stats_total": 20, "mismatched_products": 0}
    assert sorted(r["processed"] for r in store.commits(spark, place["store"]).collect()) == [10, 10]
    assert len({r["run"] for r in store.commits(spark, place["store"]).collect()}) == 2
    # each checkpoint goes on under its own name
    write_messages(spark, place["topic"], payloads(spark, event_rows(5, first=80)))
    run(spark, Ingest(place["store"], run="a"), place)
    write_messages(spark, place["lake"], payloads(spark, event_rows(5, first=90)))
    Ingest(place["store"], run="a").start(topics.file_stream(spark, place["lake"]), place["check2"]).awaitTermination()
    assert counts(spark, place) == {"events": 30, "stats_total": 30, "mismatched_products": 0}


def test_dead_letters_of_a_lake_survive_a_new_checkpoint(spark, place):
    write_messages(spark, place["topic"], [b"{"] * 10)
    ingest.start_lake(topics.file_stream(spark, place["topic"]), place["lake"], place["check"]).awaitTermination()
    write_messages(spark, place["store"], [b"["] * 10)
    ingest.start_lake(topics.file_stream(spark, place["store"]), place["lake"], place["check2"]).awaitTermination()
    assert store.dead_letters(spark, place["lake"]).count() == 20
    assert store.commits(spark, place["lake"]).agg(F.sum("dlq")).first()[0] == 20


def test_two_runs_at_once_insert_each_id_once(spark, place, monkeypatch):
    """The second run commits while the first one is between its writes and its note."""
    write_messages(spark, place["topic"], payloads(spark, event_rows(40)))
    original, met = store.commit, []

    def commit(session, root, now, name, batch_id, attempt):
        if not met:
            met.append(name)
            run(spark, Ingest(place["store"], run="second"), place, checkpoint="check2")
        return original(session, root, now, name, batch_id, attempt)

    monkeypatch.setattr(store, "commit", commit)
    run(spark, Ingest(place["store"], run="first"), place)
    assert met == ["first"]
    assert counts(spark, place) == {"events": 40, "stats_total": 40, "mismatched_products": 0}
    log = {r["run"]: (r["processed"], r["inserted"]) for r in store.commits(spark, place["store"]).collect()}
    assert log == {"first": (40, 0), "second": (40, 40)}


def test_one_of_two_processes_wins_a_batch(spark, place, monkeypatch):
    """Another process commits the same batch of the same stream first; what this one wrote does not count."""
    write_messages(spark, place["topic"], [*payloads(spark, event_rows(30)), b"{"])
    original, met = store.commit, []

    def commit(session, root, now, name, batch_id, attempt):
        met.append(attempt)
        for folder in pathlib.Path(root).glob(f"*/run={name}/batch_id={batch_id}/attempt={attempt}"):
            shutil.copytree(folder, folder.with_name("attempt=a-stranger"))
        assert original(session, root, now, name, batch_id, "a-stranger")
        return original(session, root, now, name, batch_id, attempt)

    monkeypatch.setattr(store, "commit", commit)
    run(spark, Ingest(place["store"], run="a"), place)
    assert len(met) == 1 and store.progress(spark, place["store"]).version == 1
    assert counts(spark, place) == {"events": 30, "stats_total": 30, "mismatched_products": 0}
    assert store.dead_letters(spark, place["store"]).count() == 1 and store.commits(spark, place["store"]).count() == 1


def test_a_note_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/notes/{claims.number(7)}"
    assert claims.names(spark, f"{tmp_path}/notes") == []
    assert claims.create(spark, path, {"a": [1, "ü"]}) and not claims.create(spark, path, {"a": 2})
    assert claims.read(spark, path) == {"a": [1, "ü"]} and claims.names(spark, f"{tmp_path}/notes") == [claims.number(7)]


def test_a_batch_reads_the_prefixes_of_its_ids(spark, place):
    for part in range(4):
        write_messages(spark, place["topic"], payloads(spark, event_rows(300, first=300 * part)), first_offset=300 * part)
    job = Ingest(place["store"], run="a", fold_every=2)
    run(spark, job, place, max_files=1)
    now = store.progress(spark, place["store"])
    assert now.fold == 2 and not now.notes and sum(n for _, n in now.ids) == 1200
    three = id_index.lookup(spark, place["store"], now.ids, [3, 5, 8])
    every = id_index.lookup(spark, place["store"], now.ids)
    assert {f.split("/prefix=")[1].split("/")[0] for f in three.inputFiles()} <= {"3", "5", "8"}
    assert 0 < len(three.inputFiles()) <= 3 * len(now.ids) and three.count() == every.where(id_index.prefix().isin(3, 5, 8)).count()
    named = store.known_ids(spark, place["store"], now, [3]).where(F.col("event_id").isin(["a", "b"]))
    assert "PushedFilters: [In(event_id, [a,b])]" in named._jdf.queryExecution().executedPlan().toString()
    # a replay by a new reader and the next batches meet all that is stored
    run(spark, Ingest(place["store"], run="b", fold_every=None), place, checkpoint="check2")
    write_messages(spark, place["topic"], payloads(spark, event_rows(150, first=1100)), first_offset=2000)
    run(spark, job, place)
    assert counts(spark, place) == {"events": 1250, "stats_total": 1250, "mismatched_products": 0}


def test_the_index_keeps_few_versions(spark, tmp_path):
    alive, total = [], 0
    for step in range(12):
        ids = spark.range(total, total + 50).select(F.concat(F.lit("id"), F.col("id")).alias("event_id"))
        alive, total = id_index.add(spark, str(tmp_path), alive, ids), total + 50
        assert sum(n for _, n in alive) == total and len(alive) <= 4
    assert id_index.lookup(spark, str(tmp_path), alive).distinct().count() == total
    assert id_index.add(spark, str(tmp_path), alive, ids.limit(0)) == alive
    assert id_index.lookup(spark, str(tmp_path), alive, []).count() == 0 == id_index.lookup(spark, str(tmp_path), []).count()


def hours(df):
    return {(r["hour_epoch"], r["event_type"]): r["n"] for r in df.collect()}


def test_late_events_change_the_hours_they_belong_to(spark, place):
    rows = event_rows(60, step_ms=400_000)
    write_messages(spark, place["topic"], payloads(spark, rows[20:]))
    job = Ingest(place["store"], run="a")
    run(spark, job, place)
    first = hours(store.hourly_counts(spark, place["store"]))
    assert first == hours(analytics.hourly_counts(events(spark, rows[20:])))
    store.fold(spark, place["store"])
    # events of hours that were over long ago, and copies of those that are stored
    write_messages(spark, place["topic"], payloads(spark, rows[:30]), first_offset=100)
    run(spark, job, place)
    got = hours(store.hourly_counts(spark, place["store"]))
    assert got == hours(analytics.hourly_counts(events(spark, rows))) and min(got) < min(first)
    assert store.fold(spark, place["store"]) == 2 and hours(store.hourly_counts(spark, place["store"])) == got
    assert counts(spark, place) == {"events": 60, "stats_total": 60, "mismatched_products": 0}


def test_a_check_reads_the_batches_since_the_last_fold(spark, place):
    write_messages(spark, place["topic"], payloads(spark, event_rows(200)))
    job = Ingest(place["store"], run="a")
    run(spark, job, place)
    store.fold(spark, place["store"])
    write_messages(spark, place["topic"], payloads(spark, event_rows(20, first=300)), first_offset=500)
    run(spark, job, place)
    checked = store.validate(spark, place["store"])
    files = checked.inputFiles()
    assert not [f for f in files if "/folded_events/" in f] and {f.split("batch_id=")[1].split("/")[0] for f in files if "/events/" in f} == {"1"}
    expected = {"events": 220, "stats_total": 220, "mismatched_products": 0}
    assert summary(checked) == expected == summary(store.validate(spark, place["store"], full=True))
    # a wrong delta of one product: its bucket is counted again
    folder = next(p for p in pathlib.Path(place["store"], "deltas").rglob("batch_id=1/attempt=*"))
    wrong = spark.read.parquet(str(folder)).collect()
    schema = spark.read.parquet(str(folder)).schema
    product = next(r["product_id"] for r in wrong if r["product_id"] is not None)
    changed = [r if r["product_id"] != product else type(r)(**{**r.asDict(), "view_count": r["view_count"] + 2}) for r in wrong]
    spark.createDataFrame([tuple(r[f] for f in schema.fieldNames()) for r in changed], schema).coalesce(1).write.mode("overwrite").parquet(str(folder))
    assert counts(spark, place) == {"events": 220, "stats_total": 222, "mismatched_products": 1}
    assert summary(store.validate(spark, place["store"], full=True)) == counts(spark, place)


def test_checksums_of_parts(spark):
    given = events(spark, event_rows(300))
    whole = rollup.product_stats(given)
    parts = rollup.product_stats(given.where("user_id % 3 = 0")).unionByName(rollup.product_stats(given.where("user_id % 3 <> 0")))
    assert rollup.differing_buckets(whole, parts).count() == 0
    swapped = whole.withColumns({"view_count": F.col("search_count"), "search_count": F.col("view_count")})
    assert rollup.differing_buckets(whole, swapped).count() > 0 and rollup.differing_buckets(whole.limit(0), whole.limit(0)).count() == 0
    assert {r[0] for r in rollup.differing_buckets(whole, whole.where("product_id <> 7")).collect()} == {
        whole.where("product_id = 7").select(rollup.bucket()).first()[0]}


def test_one_product_reads_one_shelf(spark, place):
    rows = event_rows(400)
    write_messages(spark, place["topic"], payloads(spark, rows[:300]))
    job = Ingest(place["store"], run="a")
    run(spark, job, place)
    store.fold(spark, place["store"])
    write_messages(spark, place["topic"], payloads(spark, rows[300:]), first_offset=500)
    run(spark, job, place)
    found = store.product_one(spark, place["store"], 7)
    assert len({f for f in found.inputFiles() if "/rollup/" in f}) == 1
    expected = rollup.product_stats(events(spark, rows)).where("product_id = 7").collect()
    assert found.select(*expected[0].asDict()).collect() == expected
    assert analytics.rollup_one(found, 7).count() == 1 and store.product_one(spark, place["store"], 10**6).count() == 0
