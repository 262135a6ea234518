import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftgate import OptionError
from siftgate.operators import events as ev
from siftgate.sources.event_store import EventStore
from siftgate.sources.storage import delete_folder, folder_names

NOW = datetime(2024, 3, 9, 12, 0, 31, 500_001)
SCHEMA = "id long, ts timestamp, layer string, verdict string, source_id string, detail string, duration_ms double"
DETAILS = ["Straße STRASSE", "İstanbul", "ΟΔΟΣ", "plain detail", "50% off_x", "\U0001f600 smile", None, ""]


def events(spark, rng, n, days=12, first=0):
    rows = []
    for i in range(n):
        at = NOW - timedelta(days=rng.random() * days) if rng.random() < 0.7 else NOW - timedelta(minutes=rng.randrange(40), seconds=rng.choice([0, 31]), microseconds=500_001 * rng.randrange(2))
        rows.append((first + i, at if rng.random() < 0.99 else None, rng.choice(["canary", "detection:x", "sanitizer", "trust_boundary", None]), rng.choice(["blocked", "passed", "modified"]), rng.choice([None, "", "user:1", "api:x"]), rng.choice(DETAILS), 1.0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng, kept = random.Random(17), EventStore(spark, str(tmp_path_factory.mktemp("store") / "s"))
    for k in range(4):
        kept.append(events(spark, rng, 300, first=1000 * k).coalesce(2))
        if k == 2:
            kept.roll_up()
    return kept


def rows(df):
    return sorted(map(str, df.collect()))


ANSWERS = {
    "metrics": (lambda s: s.metrics(NOW), lambda log: ev.metrics(log, NOW)),
    "timeseries": (lambda s: s.timeseries(NOW), lambda log: ev.timeseries(log, NOW)),
    "odd buckets": (lambda s: s.timeseries(NOW, 2.7, 7, "canary"), lambda log: ev.timeseries(log, NOW, 2.7, 7, "canary")),
    "facets": (lambda s: s.verdict_facets(), ev.verdict_facets),
    "timeline": (lambda s: s.timeline(NOW), lambda log: ev.timeline(log, NOW)),
    "sparks": (lambda s: s.layer_sparks(NOW), lambda log: ev.layer_sparks(log, NOW)),
    "sparks on a minute": (lambda s: s.layer_sparks(NOW.replace(second=0, microsecond=0)), lambda log: ev.layer_sparks(log, NOW.replace(second=0, microsecond=0))),
    "incident": (lambda s: s.incident(NOW), lambda log: ev.incident(log, NOW)),
    "layers": (lambda s: s.layer_counts(NOW), lambda log: ev.layer_counts(log, NOW)),
    "tiles": (lambda s: s.stat_tiles(NOW), lambda log: ev.stat_tiles(log, NOW)),
}


@pytest.mark.parametrize("name", ANSWERS)
def test_counts_answer_as_raw_rows_do(store, name):
    counted, raw = ANSWERS[name]
    assert rows(counted(store)) == rows(raw(store.log().drop("date", "seq")))


def test_only_counts_and_tail_are_read(spark, tmp_path):
    """With the counted days of the log gone but for the minutes that the question cuts, answers stay."""
    rng, kept = random.Random(3), EventStore(spark, str(tmp_path / "s"), searchable=False)
    kept.append(events(spark, rng, 400))
    kept.roll_up()
    kept.append(events(spark, rng, 50, first=1000))
    as_of = NOW.replace(hour=0, minute=0, second=0, microsecond=0)
    want = rows(ev.timeseries(kept.log(), as_of, hours=96, buckets=4)), rows(ev.verdict_facets(kept.log()))
    for day in folder_names(spark, f"{kept.path}/log"):
        if day.startswith("date="):
            delete_folder(spark, f"{kept.path}/log/{day}/seq=0")
    assert (rows(kept.timeseries(as_of, hours=96, buckets=4)), rows(kept.verdict_facets())) == want


def test_pruning_keeps_all_answers(spark, tmp_path):
    rng, kept = random.Random(5), EventStore(spark, str(tmp_path / "s"))
    for k in range(3):
        kept.append(events(spark, rng, 200, first=1000 * k))
        if k < 2:
            kept.roll_up()
    old = kept.log().where(F.col("ts") < ev.at(kept.log(), "ts", NOW - timedelta(days=4))).count()
    assert kept.prune(NOW, days=4) == old > 100
    assert kept.log().where(F.col("ts") < ev.at(kept.log(), "ts", NOW - timedelta(days=4))).count() == 0
    for counted, raw in (ANSWERS["facets"], ANSWERS["metrics"]):
        assert rows(counted(kept)) == rows(raw(kept.log()))
    long = (lambda s: s.timeseries(NOW, 24 * 6, 6), lambda log: ev.timeseries(log, NOW, 24 * 6, 6))
    assert rows(long[0](kept)) == rows(long[1](kept.log()))
    assert rows(kept.search(text="stra")) == rows(ev.search(ev.reshape(kept.log()), text="stra"))
    kept.append(events(spark, rng, 20, first=5000))
    kept.roll_up()
    assert rows(kept.verdict_facets()) == rows(ev.verdict_facets(kept.log()))


def test_a_crashed_append_is_invisible_and_replaced(spark, tmp_path):
    rng, kept = random.Random(6), EventStore(spark, str(tmp_path / "s"))
    kept.append(events(spark, rng, 30))
    half = events(spark, rng, 10, first=900).withColumn("date", F.lit("2024-01-01").cast("date")).withColumn("seq", F.lit(1))
    half.write.mode("append").partitionBy("date", "seq").parquet(f"{kept.path}/log")
    assert kept.log().count() == 30
    assert kept.append(events(spark, rng, 5, first=100)) == 1 and kept.log().count() == 35


def test_newest_events_open_few_days(store, spark, tmp_path):
    log = store.log()
    assert rows(store.latest(40)) == rows(ev.latest(log, 40))
    every = sum(n.startswith("date=") for n in folder_names(spark, f"{store.path}/log"))
    assert len(store.newest_days(40)) == 1 and len(store.newest_days(10**6)) == every
    for options in ({"layer": "canary", "verdict": "blocked"}, {"start": NOW - timedelta(days=3), "until": NOW - timedelta(days=1)}, {"limit": 1000}, {"limit": 7, "offset": 600}):
        assert rows(store.query(**options)) == rows(ev.query_events(log, **options))
    older = len(store.newest_days(10, until=NOW - timedelta(days=5)))
    assert older <= 2  # however long the log is after that day, and before it


def test_search_opens_files_that_may_match(spark, tmp_path):
    kept = EventStore(spark, str(tmp_path / "s"))
    for k, detail in enumerate(["Straße 1", "İstanbul", "ΟΔΟΣ x", "plain", None]):
        one = spark.createDataFrame([(k, NOW, "canary", "blocked", None if k else "user:é", detail, 1.0)], SCHEMA)
        kept.append(one)
    log = ev.reshape(kept.log())
    for needle, files in (("straße", 1), ("STRASSE", 0), ("İSTAN", 1), ("istan", 0), ("plain", 1), ("user:É", 1), ("api:clean", 4), ("zzzz", 0), ("x", None), ("  ", None)):
        assert rows(kept.search(text=needle)) == rows(ev.search(log, text=needle)), needle
        found = kept.files_with(needle)
        assert found is None if files is None else len(found) == files, needle


def test_empty_store_and_types(spark, tmp_path):
    with pytest.raises(OptionError):
        EventStore(spark, str(tmp_path / "none")).log()
    with pytest.raises(OptionError):
        EventStore(spark, str(tmp_path / "s")).append(spark.createDataFrame([(1, "x")], "id long, ts string"))
