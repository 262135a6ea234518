from datetime import datetime, timedelta

import pytest

from siftgate import OptionError
from siftgate.operators import events as ev

NOW = datetime(2024, 3, 1, 12, 0, 0)
SCHEMA = (
    "id long, ts {kind}, layer string, verdict string, source_id string, detail string, "
    "duration_ms double, metadata string"
)


def log(spark, rows, kind="timestamp"):
    data = [
        (i, NOW - timedelta(**ago), layer, verdict, "s", "d", 1.0, "{}")
        for i, (ago, layer, verdict) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA.format(kind=kind))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_bucket_edges_are_half_open(spark, kind):
    rows = [({"hours": 2}, "a", "blocked"), ({"hours": 1}, "a", "modified"), ({"hours": 0}, "a", "passed"),
            ({"hours": 2, "microseconds": 1}, "a", "passed"), ({"hours": 1, "microseconds": 1}, "b", "passed")]
    got = ev.timeseries(log(spark, rows, kind), NOW, hours=2, buckets=2).orderBy("bucket").collect()
    assert [(r["total"], r["blocked"], r["modified"]) for r in got] == [(2, 1, 0), (1, 0, 1)]
    assert got[0]["t"] == 1709287200
    only = ev.timeseries(log(spark, rows, kind), NOW, hours=2, buckets=2, layer="b").orderBy("bucket").collect()
    assert [r["total"] for r in only] == [1, 0]


def test_empty_log(spark):
    empty = log(spark, [])
    assert [r["total"] for r in ev.timeseries(empty, NOW, buckets=3).collect()] == [0, 0, 0]
    assert [(r["level"], r["total"]) for r in ev.metrics(empty, NOW).collect()] == [("all", 0)]
    assert ev.incident(empty, NOW).first()["incident"] is False
    assert ev.layer_sparks(empty, NOW).count() == 56


def test_query_bounds_are_inclusive_and_ties_break_on_id(spark):
    rows = [({"hours": 1}, "a", "x")] * 3 + [({"hours": 3}, "a", "x")]
    got = ev.query_events(log(spark, rows), start=NOW - timedelta(hours=1), until=NOW - timedelta(hours=1))
    assert [r["id"] for r in got.collect()] == [2, 1, 0]
    assert [r["id"] for r in ev.query_events(log(spark, rows), limit=2, offset=1).collect()] == [1, 0]
    with pytest.raises(OptionError):
        ev.query_events(log(spark, rows), limit=1001)


def test_incident_window_is_open_at_its_start(spark):
    assert ev.incident(log(spark, [({"minutes": 30}, "a", "blocked")]), NOW).first()["incident"] is False
    assert ev.incident(log(spark, [({"minutes": 29}, "a", "blocked")]), NOW).first()["incident"] is True


def test_normal_layers_and_sparks(spark):
    rows = [({"seconds": 30}, "detection:x", "blocked"), ({"minutes": 13, "seconds": 59}, "trust_boundary", "p"),
            ({"minutes": 14}, "canary", "p"), ({"seconds": 0}, "analysis_guard", "p")]
    got = {(r["layer"], r["bucket"]): r["n"] for r in ev.layer_sparks(log(spark, rows), NOW).collect() if r["n"]}
    assert got == {("detection", 13): 1, ("boundary", 0): 1, ("canary", 13): 1}


def test_reshape_fills_defaults(spark):
    df = spark.createDataFrame(
        [(1, NOW, None, None, None, None, None, None)], SCHEMA.format(kind="timestamp")
    )
    row = ev.reshape(df).first()
    assert (row["layer"], row["verdict"], row["source"], row["detail"], row["duration_ms"]) == (
        "sanitizer", "passed", "api:clean", "", 0,
    )


def test_time_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, [({"hours": h}, "a", "blocked") for h in range(50)]).write.parquet(path)
    stored = spark.read.parquet(path)
    for df in (ev.metrics(stored, NOW), ev.timeseries(stored, NOW), ev.stat_tiles(stored, NOW), ev.prune(stored, NOW)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan
    narrow = ev.metrics(stored, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "metadata" not in narrow


def test_metadata(spark):
    df = spark.createDataFrame(
        [(1, NOW, "a", "b", "c", "d", 1.0, '{"k": 5}'), (2, NOW, "a", "b", "c", "d", 1.0, "")],
        SCHEMA.format(kind="timestamp"),
    )
    rows = ev.decode_metadata(df, "k long").orderBy("id").collect()
    assert rows[0]["metadata"]["k"] == 5 and rows[1]["metadata"]["k"] is None


def test_date_folders_are_pruned(spark, tmp_path):
    from siftgate.sources.corpora import append_events

    path = str(tmp_path / "dated")
    append_events(log(spark, [({"days": d}, "a", "blocked") for d in range(5)]), path)
    stored = spark.read.parquet(path)
    recent = ev.stat_tiles(stored, NOW)
    assert "PartitionFilters: [isnotnull(date" in recent._jdf.queryExecution().executedPlan().toString()
    assert recent.first()["processed"] == 2
    assert ev.prune(stored, NOW, days=2).count() == 3
