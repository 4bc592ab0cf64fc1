import json
import os

import pytest
from pyspark.sql import functions as F

from flowspark.plans import scoring
from flowspark.streaming import panels
from flowspark.streaming.monitor import FlowMonitor, Stager

SCORER = scoring.expression_scorer("flow / 10D")


def monitor(spark, root):
    return FlowMonitor(
        spark, f"{root}/watched", f"{root}/alerts", f"{root}/processed", f"{root}/failed", ["flow"], SCORER, 0.5, "v1"
    )


def drop(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as handle:
        handle.write("\n".join(lines) + "\n")


def run(watch, root):
    watch.start(f"{root}/checkpoint", availableNow=True).awaitTermination()


def names(folder):
    return sorted(n for n in os.listdir(folder) if not n.startswith("."))


def test_file_moves_after_two_unchanged_listings(spark, tmp_path):
    incoming, watched = str(tmp_path / "incoming"), str(tmp_path / "watched")
    stager = Stager(spark, incoming, watched)
    drop(incoming, "flows.csv", "flow", "1")
    assert stager.scan_once() == []
    drop(incoming, "flows.csv", "flow", "1", "22")
    assert stager.scan_once() == []
    assert len(stager.scan_once()) == 1
    assert names(watched) == ["flows.csv"] and names(incoming) == []
    drop(incoming, "flows.csv", "flow", "3")
    stager.scan_once()
    stager.scan_once()
    assert names(watched) == ["flows.csv", "flows_1.csv"]


def test_vanished_file_is_forgotten(spark, tmp_path):
    stager = Stager(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    drop(str(tmp_path / "in"), "a.csv", "flow", "1")
    stager.scan_once()
    os.rename(tmp_path / "in" / "a.csv", tmp_path / "gone.csv")
    assert stager.scan_once() == [] and stager.seen == {}


def test_too_few_checks(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        Stager(spark, str(tmp_path / "in"), str(tmp_path / "out"), checks=1)


def test_stream_scores_archives_and_sets_aside(spark, tmp_path):
    root = str(tmp_path)
    watch = monitor(spark, root)
    drop(watch.watched, "good.csv", "flow", "9", "1", "oops")
    drop(watch.watched, "bad.csv", "other", "9")
    drop(watch.watched, "empty.csv", "flow")
    run(watch, root)
    rows = sorted(watch.scores().collect(), key=lambda r: r.source_row)
    assert [(r.prediction, r.is_alert, r.score_status) for r in rows] == [
        (1, True, "scored"), (0, False, "scored"), (None, False, "invalid_input"),
    ]
    assert names(watch.processed) == ["good.csv"]
    assert names(watch.failed) == ["bad.csv", "bad.csv.error.json", "empty.csv", "empty.csv.error.json"]
    note = json.loads((tmp_path / "failed" / "bad.csv.error.json").read_text())
    assert "missing features: flow" in note["error"]

    # A later export may reuse the name; earlier evidence stays.
    drop(watch.watched, "good2.csv", "flow", "7")
    run(watch, root)
    assert watch.scores().count() == 4
    assert names(watch.watched) == []


def test_repeated_batch_changes_nothing(spark, tmp_path):
    watch = monitor(spark, str(tmp_path))
    drop(watch.watched, "a.csv", "flow", "9")
    batch = spark.createDataFrame([(f"file:{watch.watched}/a.csv",)], "path string")
    watch.process(batch, 0)
    assert watch.scores().count() == 1
    watch.process(batch, 0)
    assert watch.scores().count() == 1 and names(watch.processed) == ["a.csv"]


def test_new_checkpoint_does_not_take_old_results_for_its_own(spark, tmp_path):
    watch = monitor(spark, str(tmp_path))
    drop(watch.watched, "my flows+1%20.csv", "flow", "9")
    run(watch, f"{tmp_path}/first")
    assert names(watch.processed) == ["my flows+1%20.csv"] and names(watch.failed) == []
    drop(watch.watched, "two.csv", "flow", "1", "2")
    run(watch, f"{tmp_path}/second")
    assert watch.scores().count() == 3
    assert names(watch.processed) == ["my flows+1%20.csv", "two.csv"]


def test_repeated_batch_archives_only_what_was_published(spark, tmp_path):
    watch = monitor(spark, str(tmp_path))
    drop(watch.watched, "a.csv", "flow", "9")
    drop(watch.watched, "b.csv", "flow", "1")
    first = spark.createDataFrame([(f"file:{watch.watched}/a.csv",)], "path string")
    watch.process(first, 0)
    both = spark.createDataFrame([(f"file:{watch.watched}/{n}.csv",) for n in "ab"], "path string")
    watch.process(both, 0)
    assert names(watch.processed) == ["a.csv"] and "b.csv" in names(watch.failed)


def test_unreadable_file_is_set_aside_and_others_proceed(spark, tmp_path, monkeypatch):
    from flowspark.streaming import monitor as module

    watch = monitor(spark, str(tmp_path))
    drop(watch.watched, "good.csv", "flow", "9")
    drop(watch.watched, "broken.csv", "flow", "1")
    real = module.read_flows

    def fail(session, paths, features):
        if any(p.endswith("broken.csv") for p in paths):
            raise OSError("bad block")
        return real(session, paths, features)

    monkeypatch.setattr(module, "read_flows", fail)
    run(watch, str(tmp_path))
    assert watch.scores().count() == 1 and names(watch.processed) == ["good.csv"]
    assert names(watch.failed) == ["broken.csv", "broken.csv.error.json"]
    assert "bad block" in (tmp_path / "failed" / "broken.csv.error.json").read_text()


def test_rows_with_too_many_fields_are_invalid(spark, tmp_path):
    watch = monitor(spark, str(tmp_path))
    drop(watch.watched, "a.csv", "flow,label", "9,x", "9,x,EXTRA,1", "1", "9,y")
    run(watch, str(tmp_path))
    rows = sorted(watch.scores().collect(), key=lambda r: r.source_row)
    assert [r.score_status for r in rows] == ["scored", "invalid_input", "scored", "scored"]


def test_archive_failure_is_recorded(spark, tmp_path, monkeypatch):
    from flowspark.streaming import monitor as module

    watch = monitor(spark, str(tmp_path))
    drop(watch.watched, "a.csv", "flow", "9")
    real = module.rename

    def refuse(session, source, target):
        if "/processed/" in target:
            raise OSError("no space")
        real(session, source, target)

    monkeypatch.setattr(module, "rename", refuse)
    watch.process(spark.createDataFrame([(f"file:{watch.watched}/a.csv",)], "path string"), 0)
    assert watch.scores().count() == 1
    note = json.loads((tmp_path / "failed" / "a.csv.error.json").read_text())
    assert note["error"].startswith("scored_archive_failed")


def test_panels_serve_batch_and_stream(spark, tmp_path):
    events = spark.sql(
        "SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 50) AS ts, "
        "id % 3 = 0 AS is_alert, concat('m', id % 2) AS model_version FROM range(200)"
    )
    events.write.parquet(str(tmp_path / "events"))
    stream = panels.event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "ts")
    for make, keys in (
        (lambda d: panels.alert_volume(d, "ts"), ["window_start"]),
        (lambda d: panels.flow_volume(d, "ts"), ["window_start", "model_version"]),
        (lambda d: panels.error_ratio(d, "ts", "is_alert"), ["window_start"]),
    ):
        batch = make(events)
        streamed = panels.run_to_table(make(stream), keys, "panel").select(*batch.columns)
        assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_batch_size_buckets(spark):
    df = spark.sql("SELECT CASE WHEN id = 0 THEN 'one' ELSE 'many' END AS b FROM range(51)")
    got = {r.le: r.batches for r in panels.batch_size_histogram(df, "b").collect()}
    assert got == {"1": 1, "10": 1, "100": 2, "1000": 2, "10000": 2, "+Inf": 2}


def test_latency_panel_is_close_to_exact(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    panel = panels.latency_panel(events, "ts", "event_type", "value", "365 days")
    for r in panel.collect():
        own = events.where((F.col("event_type") == r.event_type) & (F.window("ts", "365 days")["start"] == r.window_start))
        values = sorted(x.value for x in own.select("value").collect())
        assert len(values) == r.requests
        for q, v in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            low, high = max(0, int((q - 0.03) * len(values)) - 1), min(len(values) - 1, int((q + 0.03) * len(values)) + 1)
            assert values[low] <= v <= values[high]
    empty = panels.latency_panel(events.withColumn("value", F.lit(None).cast("double")), "ts", "event_type", "value")
    assert all(r.p50 is None and r.requests == 0 for r in empty.collect())
