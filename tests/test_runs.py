import json
import random
import statistics

import pytest

from tideline.operators import agreement, metrics, runs
from tideline.sources import logs

T0 = 1_700_000_000.0


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")


def window(ts, processed, lag=0, **more):
    return {"ts": ts, "dt": 1.0, "processed": processed, "lag": lag, "e2e_p50_ms": 1.0, "e2e_p99_ms": 5.0,
            "sink_calls": 2, "sink_ms_total": 10.0, **more}


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "a" / "consumer-0.jsonl", [window(T0 - 0.5, 5), window(T0 + 0.2, 100, 40), "{broken",
                                                 window(T0 + 1.7, 50, 10, e2e_p99_ms=80.0), window(T0 + 4.1, 0)])
    write(tmp_path / "a" / "consumer-1.jsonl", [window(T0 + 0.9, 200, 60, dt=2.0), window(T0 + 3.5, 30)])
    write(tmp_path / "a" / "samples.jsonl", [
        {"kind": "db", "ts": T0 - 3, "produced": 9, "stored": 0, "pg_connections": 9, "freshness_s": 99.0},
        *[{"kind": "db", "ts": T0 + t, "produced": p, "stored": s, "pg_connections": 2, "freshness_s": f}
          for t, p, s, f in [(0, 0, 0, None), (1, 3000, 500, 1.5), (2, 6000, 800, 2.5), (3, 6000, 5500, 3.5), (4, 6000, 6000, 9.0), (50, 6000, 0, 1.0)]],
        *[{"kind": "k8s", "ts": T0 + t, "replicas": 2, "ready": r, "pg_usage_usec": u, "pg_throttled_usec": h, "pg_nr_throttled": 0}
          for t, r, u, h in [(0, 1, 0, 0), (2, None, 1_000_000, 500_000), (4, 2, None, None), (6, 2, 5_000_000, 900_000), (7, 2, 6_000_000, 1_000_000)]],
        {"kind": "k8s_error", "ts": T0, "error": "x"}, ""])
    summary = {"experiment": "a", "sent": 6000, "t0": T0, "produce_end": T0 + 2, "drain_end": T0 + 4, "drained": True,
               "killed": {"pod": "p", "at": T0 + 1}, "validation": {"events": 5900, "stats_total": 5900, "mismatched_products": 0},
               "producer_stats": {"sent": 6000, "valid": 5950}, "recovery": {"redriven": 20, "recovered": True, "seconds": 1.0},
               "final_dlq": {"total": 70, "by_reason": {"invalid_json": 70}}, "restarts": 1}
    (tmp_path / "a" / "summary.json").write_text(json.dumps(summary, indent=2))
    return tmp_path


def test_readers(spark, folder):
    assert logs.metric_windows(spark, f"{folder}/*/consumer-*.jsonl").where("scenario = 'a' and ts is not null").count() == 6
    assert logs.samples(spark, f"{folder}/*/samples.jsonl", "k8s").count() == 5
    assert logs.samples(spark, f"{folder}/missing/samples.jsonl", "db").count() == 0
    row = logs.run_summaries(spark, f"{folder}/*/summary.json").first()
    assert row["run"] == "a" and row["final_dlq"]["by_reason"] == {"invalid_json": 70}
    assert logs.refresh_log(spark, f"{folder}/*/batchjob.jsonl").count() == 0


def test_log_lines_keep_other_spellings(spark, tmp_path):
    write(tmp_path / "b" / "consumer-7.jsonl", [
        window(T0, 6), json.dumps(window(T0, 6)).replace('"processed": 6', '"processed": 6.0'), window(T0, 6, e2e_p99_ms="x"),
        "{broken", "[1]", "", json.dumps(window(T0, 6)).replace('"processed": 6', '"processed": 6e0')])
    rows = logs.metric_windows(spark, f"{tmp_path}/*/consumer-*.jsonl").collect()
    assert [r["processed"] for r in rows] == [6, 6, 6, 6]
    assert {(r["scenario"], r["consumer"]) for r in rows} == {("b", "consumer-7")}
    assert sum(r["e2e_p99_ms"] is None for r in rows) == 1


def test_seconds_and_summary(spark, folder):
    windows = logs.metric_windows(spark, f"{folder}/*/consumer-*.jsonl").where("ts is not null")
    starts = spark.createDataFrame([("a", T0, T0 + 2.0)], "scenario string, t0 double, produce_end double")
    seconds = {r["second"]: r for r in metrics.run_seconds(windows, starts).collect()}
    # half a second before the start counts into second 0
    assert (seconds[0]["processed"], seconds[0]["lag"], seconds[0]["rate"]) == (305, 100, 205.0)
    assert seconds[1]["p99_ms"] == 80.0
    row = metrics.run_summary(metrics.run_seconds(windows, starts), starts).first()
    assert (row["throughput"], row["peak_lag"], row["drain_s"]) == (355 / 2, 100, 1.0)
    assert row["sink_ms_per_event"] == pytest.approx(60 / 385)
    empty = metrics.run_summary(metrics.run_seconds(windows.limit(0), starts), starts).first()
    assert (empty["throughput"], empty["peak_lag"], empty["drain_s"], empty["sink_ms_per_event"]) == (0, 0, 0, None)


def test_run_operators(spark, folder):
    table = logs.run_table(logs.run_summaries(spark, f"{folder}/*/summary.json"))
    samples = logs.samples(spark, f"{folder}/*/samples.jsonl", "db")
    pods = logs.samples(spark, f"{folder}/*/samples.jsonl", "k8s")
    assert tuple(runs.backlog(samples, table).first()) == ("a", 5200, 2.0)
    assert tuple(runs.staleness(samples, pods, table).first()) == ("a", 9.0, 2, 2)
    rates = runs.counter_rates(pods, table)
    assert [tuple(r) for r in rates.orderBy("t").collect()] == [("a", 2.0, 0.5, 0.25), ("a", 7.0, 1.0, 0.1)]
    assert runs.throttled_total(rates).first()["throttled_s"] == pytest.approx(0.35)
    assert runs.pod_seconds(pods, table).first()["pod_seconds"] == 2 * 1 + 0 + 2 * 2
    assert runs.recovery_time(samples, table).first()["recovery_s"] == 2.0
    assert runs.reconcile(table).first()["missing"] == 6000 - (5900 + 70 - 20)
    never = samples.where(f"ts < {T0 + 3}")
    assert runs.recovery_time(never, table).first()["recovery_s"] is None
    assert tuple(runs.backlog(samples.limit(0), table).first()) == ("a", 0, 2.0)


def test_compare_runs(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "run string, sent int")
    right = spark.createDataFrame([("b", 3), ("c", 4)], "run string, sent int")
    got = {tuple(r) for r in runs.compare_runs(left, right, ["sent"]).collect()}
    assert got == {("a", "run", 1, "not run", None), ("b", "run", 2, "run", 3), ("c", "not run", None, "run", 4)}


def test_lag(spark):
    high = spark.createDataFrame([("t", 0, 10), ("t", 1, 5), ("t", 2, 7)], "topic string, partition int, high long")
    used = spark.createDataFrame([("t", 0, 4), ("t", 1, 9), ("t", 3, 2)], "topic string, partition int, next_offset long")
    assert {r["partition"]: r["lag"] for r in metrics.lag_by_partition(high, used).collect()} == {0: 6, 1: 0, 2: 7, 3: 0}


def test_query_times(spark):
    rng = random.Random(2)
    data = {name: [round(rng.random() * 9, 2) for _ in range(n)] for name, n in (("q1", 1), ("q2", 4), ("q3", 5))}
    rows = [(name, ms, i) for name, values in data.items() for i, ms in enumerate(values)]
    got = metrics.query_times(spark.createDataFrame(rows, "q string, ms double, seq int"), "q").collect()
    assert {r["q"]: (pytest.approx(r["median_ms"]), r["min_ms"], r["first_ms"]) for r in got} == {
        name: (statistics.median(v), min(v), v[0]) for name, v in data.items()}


def test_agree(spark):
    a = spark.createDataFrame([(1, 2.001), (2, 3.0), (2, 3.0)], "k int, v double")
    b = spark.createDataFrame([(2, 3.0), (1, 2.0), (2, 3.004)], "k int, v double")
    assert agreement.agree(a, b).first()["identical"]
    assert not agreement.agree(a, b, digits=3).first()["identical"]
    assert tuple(agreement.agree(a, b.limit(0)).first()) == (3, 0, 3, False)
    ranked = agreement.with_rank(a, "k", "v").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3]


def test_completion(spark):
    windows = spark.createDataFrame([("a", 5), ("a", 6)], "run string, processed long")
    samples = spark.createDataFrame([("a", 1.0, 9), ("a", 2.0, 3)], "run string, ts double, stored long")
    table = spark.createDataFrame([("a", 11, 4), ("b", 1, 0)], "run string, sent long, target long")
    got = {tuple(r) for r in metrics.completion(windows, samples, table).collect()}
    assert got == {("a", 11, 3, True, False), ("b", 0, 0, False, False)}


def test_log_lines_with_bare_nan(spark, tmp_path):
    write(tmp_path / "n" / "consumer-0.jsonl", [window(T0, 3, e2e_p50_ms=float("nan"), e2e_p99_ms=float("inf")), window(T0 + 1, 4),
                                                 '{"ts": NaN, "processed": 5, "lag":-Infinity}'])
    rows = {r["processed"]: r for r in logs.metric_windows(spark, f"{tmp_path}/*/consumer-*.jsonl").collect()}
    assert set(rows) == {3, 4, 5}
    assert rows[3]["e2e_p50_ms"] != rows[3]["e2e_p50_ms"] and rows[3]["e2e_p99_ms"] == float("inf") and rows[3]["ts"] == T0
    assert rows[5]["ts"] != rows[5]["ts"] and rows[4]["e2e_p50_ms"] == 1.0
