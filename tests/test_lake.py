from helpers import event_rows, events, same
from pyspark.sql import functions as F

from tideline.operators import analytics, rollup
from tideline.sources import claims, lake

DAY_MS = 86_400_000


def test_redelivery_is_deduplicated_on_read(spark, tmp_path):
    root, rows = str(tmp_path), event_rows(300)
    lake.append_events(events(spark, rows[:200]), root)
    lake.append_events(events(spark, rows[100:]), root)
    assert lake.read_events(spark, root, dedupe=False).count() == 400
    assert lake.read_events(spark, root).count() == 300


def test_compaction(spark, tmp_path):
    root, rows = str(tmp_path), event_rows(500)
    for start in range(0, 500, 100):
        lake.append_events(events(spark, rows[start:start + 100]), root)
    lake.append_events(events(spark, rows[50:250]), root)
    report = lake.compact(spark, root)
    assert (report["rows_before"], report["distinct_before"], report["rows_after"]) == (700, 500, 500)
    assert report["files_before"] > report["files_after"] == 1
    products = [r[0] for r in lake.read_events(spark, root, compacted=True, dedupe=False).select("product_id").collect()]
    assert products == sorted(products)
    assert lake.compact(spark, root)["rows_after"] == 500  # again, over what is there


def test_compaction_splits_a_large_day_and_keeps_other_days(spark, tmp_path):
    root = str(tmp_path)
    lake.append_events(events(spark, event_rows(2000, step_ms=10)), root)
    lake.append_events(events(spark, event_rows(50, first=3000, step_ms=DAY_MS // 1000)), root)
    assert lake.compact(spark, root, rows_per_file=300)["files_after"] > 5
    compacted = lake.read_events(spark, root, compacted=True, dedupe=False)
    ranges = compacted.groupBy("dt", F.col("_metadata.file_path").alias("f")).agg(
        F.min("product_id").alias("lo"), F.max("product_id").alias("hi")).orderBy("dt", "lo", "hi").collect()
    for a, b in zip(ranges, ranges[1:]):
        assert a["dt"] != b["dt"] or a["hi"] <= b["lo"]
    days = sorted(r[0] for r in compacted.select(F.col("dt").cast("string")).distinct().collect())
    lake.append_events(events(spark, event_rows(10, seed=9)), root)
    report = lake.compact(spark, root, days=(days[0], days[0]))
    assert report["rows_after"] == 2010
    assert lake.read_events(spark, root, compacted=True).count() == 2060


def test_no_task_of_a_compaction_sorts_more_than_a_million_rows(spark, tmp_path):
    root, (row,) = str(tmp_path), event_rows(1)
    many = spark.range(1_300_000).join(F.broadcast(events(spark, [row]).drop("event_id", "product_id")))
    many = many.select("*", F.col("id").cast("string").alias("event_id"), (F.col("id") % 3).cast("int").alias("product_id"))
    lake.append_events(many, root)
    assert lake.compact(spark, root)["files_after"] == 2
    compacted = lake.read_events(spark, root, compacted=True, dedupe=False)
    files = [r["count"] for r in compacted.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(files) == 1_300_000 and max(files) <= 1_000_000


def test_scopes_of_dedupe_differ_across_days(spark, tmp_path):
    root, rows = str(tmp_path), event_rows(10)
    moved = [(*r[:6], r[6].replace(year=2024), r[7]) for r in rows[:4]]
    lake.append_events(events(spark, rows + moved), root)
    assert lake.read_events(spark, root).count() == 10
    assert lake.compact(spark, root)["rows_after"] == 14
    counts = lake.compaction_counts(lake.read_events(spark, root, dedupe=False)).first().asDict()
    assert counts == {"rows_before": 14, "distinct_before": 10, "rows_after": 14}


def test_values_round_trip(spark, tmp_path):
    given = events(spark, event_rows(20, step_ms=1, channel=lambda i: "web" if i % 2 else None))
    lake.append_events(given, str(tmp_path))
    assert same(lake.read_events(spark, str(tmp_path)).drop("dt"), given)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_filter_reaches_the_scan_through_the_dedupe(spark, tmp_path):
    root = str(tmp_path)
    lake.append_events(events(spark, event_rows(100)), root)
    assert "EqualTo(product_id,7)" in plan(lake.read_events(spark, root, where=F.col("product_id") == 7))
    pruned = plan(lake.read_events(spark, root, dedupe=False, where=F.col("dt") == "2023-11-14"))
    assert "PartitionFilters: [isnotnull(dt" in pruned
    top = plan(analytics.top_products(lake.read_events(spark, root, dedupe=False)))
    assert "TakeOrderedAndProject" in top and "ReadSchema: struct<event_type:string,product_id:int,rating:smallint>" in top


def test_point_lookups(spark):
    given = events(spark, event_rows(400))
    stats = rollup.product_stats(given)
    product = given.where("rating is not null").first()["product_id"]
    assert analytics.rollup_one(stats, product).first() == analytics.recount_one(given, product).first()
    assert analytics.rollup_one(stats, 10**6).count() == 0
    assert analytics.recount_one(given, 10**6).first().asDict() == {"review_count": 0, "avg_rating": None}
    assert analytics.freshness(given.limit(0)).first()[0] is None
    empty = rollup.validation_summary(given.limit(0), stats.limit(0)).first().asDict()
    assert empty == {"events": 0, "stats_total": 0, "mismatched_products": 0}


def test_channels(spark):
    given = events(spark, event_rows(40, channel=lambda i: "web" if i % 2 else None))
    assert {r[0]: r[1] for r in analytics.channel_counts(given).collect()} == {"web": 20, "none": 20}




def test_only_days_with_new_files_are_rewritten(spark, tmp_path):
    root, rows = str(tmp_path), event_rows(90, step_ms=DAY_MS // 30)
    lake.append_events(events(spark, rows), root)
    first = lake.compact(spark, root)
    assert len(first["days"]) == 4 and first["rows_after"] == 90
    assert lake.compact(spark, root)["days"] == [] and lake.snapshot(spark, root)["number"] == 1
    lake.append_events(events(spark, rows[:3] + event_rows(2, seed=8)), root)
    again = lake.compact(spark, root)
    assert again["days"] == first["days"][:1]
    assert (again["rows_before"], again["distinct_before"], again["rows_after"]) == (95, 92, 92)
    notes = lake.snapshot(spark, root)["days"]
    assert len({day["version"] for day in notes.values()}) == 2 and lake.read_events(spark, root, compacted=True, dedupe=False).count() == 92
    # versions that a snapshot names stay
    assert lake.clean(spark, root, keep=2) == []
    lake.append_events(events(spark, rows), root)
    assert lake.compact(spark, root)["days"] == first["days"] and len(lake.clean(spark, root, keep=1)) == 2
    assert same(lake.read_events(spark, root, compacted=True, dedupe=False), lake.read_events(spark, root))


def test_a_reader_sees_a_compaction_as_a_whole(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path), event_rows(60, step_ms=DAY_MS // 20)
    lake.append_events(events(spark, rows[:40]), root)
    lake.compact(spark, root)
    before = lake.read_events(spark, root, compacted=True, dedupe=False)
    lake.append_events(events(spark, rows), root)
    seen, original = [], claims.create

    def create(session, path, note):
        if "/snapshots/" in path:  # all is written, the note is not
            seen.append(lake.read_events(spark, root, compacted=True, dedupe=False).count())
        return original(session, path, note)

    monkeypatch.setattr(claims, "create", create)
    assert lake.compact(spark, root)["rows_after"] == 60
    assert seen == [40] and before.count() == 40
    assert lake.read_events(spark, root, compacted=True, dedupe=False).count() == 60


def test_of_two_compactions_the_second_starts_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    lake.append_events(events(spark, event_rows(30)), root)
    original, met = claims.create, []

    def create(session, path, note):
        if not met:
            met.append(path)
            lake.append_events(events(spark, event_rows(10, first=20)), root)
            assert lake.compact(spark, root)["rows_after"] == 30
        return original(session, path, note)

    monkeypatch.setattr(claims, "create", create)
    report = lake.compact(spark, root)
    assert (report["rows_before"], report["rows_after"], report["days"]) == (40, 30, [])
    assert lake.snapshot(spark, root)["number"] == 1
