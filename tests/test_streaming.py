import os
import random
import weakref
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from siftgate.operators import events as ev
from siftgate.streaming import jobs, stateful
from siftgate.streaming.stateful import stream_wide_sessions

START = datetime(2024, 3, 1)
SCHEMA = "id long, ts timestamp, layer string, verdict string, source_id string"


def events(spark, minutes, verdict="blocked"):
    rows = [(i, START + timedelta(minutes=m), "canary", verdict, "s") for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, SCHEMA)


class Feed:
    """A folder that grows, one file set per call, and a stream over it."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.mark = spark, str(tmp_path / "feed"), str(tmp_path / "mark")
        self.out = str(tmp_path / "out")

    def push(self, df):
        df.write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).parquet(self.path)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [0, 10, 59, 61, 300]))
    jobs.to_files(jobs.tumbling_counts(feed.stream()), feed.out, feed.mark).awaitTermination()
    feed.push(events(spark, [5, 299, 400]))  # 5 is behind the watermark, 299 is not
    query = jobs.to_files(jobs.tumbling_counts(feed.stream()), feed.out, feed.mark)
    query.awaitTermination()
    rows = spark.read.parquet(feed.out).orderBy("start").collect()
    assert [(r["start"].hour, r["total"]) for r in rows] == [(0, 3), (1, 1), (4, 1), (5, 1)]
    assert jobs.dropped_late(query) == 1


def test_sessions_match_gaps(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [0, 29, 58, 90, 91, 1000]))
    jobs.to_files(jobs.incident_sessions(feed.stream()), feed.out, feed.mark).awaitTermination()
    rows = spark.read.parquet(feed.out).orderBy("start").collect()
    assert [r["blocked"] for r in rows] == [3, 2]


def sessions_by_hand(minutes, gap=30):
    out = []
    for m in sorted(minutes):
        if out and m - out[-1][1] < gap:
            out[-1] = (out[-1][0], m, out[-1][2] + 1)
        else:
            out.append((m, m, 1))
    return [(a, b + gap, n) for a, b, n in out]


def test_sessions_over_many_buckets(spark, tmp_path):
    """Two-level sessions: some span three and more buckets, some end on an edge, rows come in any order and late."""
    rng = random.Random(13)
    minutes = [m for start, end in ((0, 400), (460, 470), (600, 1500), (1560, 1561)) for m in range(start, end, 7)] + [480 + 120 * k for k in range(1, 4)]
    minutes += [rng.randrange(2000, 5000) for _ in range(60)]
    first, second = [m for m in minutes if m < 1200], [m for m in minutes if m >= 1195]
    rng.shuffle(first)
    feed = Feed(spark, tmp_path)
    for part in (first, [1, 2, 1196, *second], [3, 20_000]):  # 1, 2 and 3 are behind the watermark by then
        feed.push(events(spark, part).repartition(3))
        out = stream_wide_sessions(feed.stream(), "30 minutes", "10 minutes", buckets="2 hours")
        jobs.to_files(jobs._edges(out), feed.out, feed.mark).awaitTermination()
    rows = spark.read.parquet(feed.out).orderBy("start").collect()
    at = [((r["start"] - START) // timedelta(minutes=1), (r["end"] - START) // timedelta(minutes=1), r["blocked"]) for r in rows]
    assert at == sessions_by_hand([*first, 1196, *second])


def test_stream_wide_sessions_are_dealt_by_bucket(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [0]))
    plan = jobs.incident_sessions(feed.stream())._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithState") == 2 and "SessionWindow" not in plan and "session_window" not in plan


def test_latest_feed_is_bounded_and_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    want, last = {}, None
    for k, minutes in enumerate(([1, 5, 3], [4, 2], [9], [1500, 8, 7], [5000])):
        layer = "even" if k % 2 == 0 else "odd"
        feed.push(events(spark, minutes).withColumn("layer", F.lit(layer)))
        want[layer] = sorted([*want.get(layer, []), *minutes], reverse=True)[:2]
        query = jobs.latest_feed(feed.stream(), feed.out, feed.mark, n=2, by=["layer"], idle="2 days")
        query.awaitTermination()
        last = query.lastProgress["batchId"]
    assert want["odd"] == [1500, 8]  # two days and more before the newest by now
    want["odd"] = []
    rows = jobs.read_latest(spark, feed.out, last).collect()
    got = {x: sorted(((r["ts"] - START) // timedelta(minutes=1) for r in rows if r["layer"] == x), reverse=True) for x in want}
    assert got == want
    assert sorted(os.listdir(feed.out)) == [f"v{last - 1}", f"v{last}"]


def test_rolling_state_is_a_row_per_pane(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [*range(0, 240)] * 5))
    query = jobs.to_files(jobs.rolling_metrics(feed.stream(), "4 hours", "1 hour"), feed.out, feed.mark)
    query.awaitTermination()
    inserted = [sum(p["stateOperators"][k]["numRowsUpdated"] for p in query.recentProgress) for k in (0, 1)]
    assert sorted(inserted)[0] <= 12 and sorted(inserted)[1] <= 16  # windows, panes of four hours; not 1200 rows, not 4800 copies
    rows = {(r["start"] - START) // timedelta(hours=1): r["total"] for r in spark.read.parquet(feed.out).collect()}
    assert rows == {-3: 300, -2: 600, -1: 900}


def test_rolling_with_odd_widths(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    minutes = [0, 10, 29, 30, 31, 59, 60, 75, 100, 400]
    feed.push(events(spark, minutes))
    jobs.to_files(jobs.rolling_metrics(feed.stream(), "45 minutes", "30 minutes"), feed.out, feed.mark).awaitTermination()
    rows = {(r["start"] - START) // timedelta(minutes=1): r["total"] for r in spark.read.parquet(feed.out).collect()}
    want = {s: n for s in range(-30, 346, 30) if (n := sum(s <= m < s + 45 for m in minutes))}
    assert rows == want


def test_latest_feed_equals_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    last = None
    for minutes in ([1, 5, 3], [4, 2], [9]):
        feed.push(events(spark, minutes))
        query = jobs.latest_feed(feed.stream(), feed.out, feed.mark, n=4)
        query.awaitTermination()
        last = query.lastProgress["batchId"]
    got = jobs.read_latest(spark, feed.out, last)
    want = ev.latest(spark.read.schema(SCHEMA).parquet(feed.path), n=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_task_passes_on_the_newest_of_each_key(monkeypatch):
    monkeypatch.setattr(stateful, "HELD_ROWS", 40)
    rng = random.Random(2)
    rows = [{"k": rng.choice(["a", "b", None]), "ts": rng.choice([None, *range(50)]), "id": i} for i in range(1000)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 17]) for i in range(0, 1000, 17)]
    out = [r for b in stateful.newest_of_task(["k"], ("ts", "id"), 5)(iter(batches)) for r in b.to_pylist()]
    rank = lambda r: (r["ts"] is not None, r["ts"] or 0, r["id"])
    want = [r for k in ("a", "b", None) for r in sorted((r for r in rows if r["k"] == k), key=rank, reverse=True)[:5]]
    assert sorted(r["id"] for r in out) == sorted(r["id"] for r in want)


def test_state_holder_reads_its_rows_one_by_one():
    holder = stateful.Newest(["ts", "id"], [], "ts long, id long", ("ts", "id"), 3, False)
    alive, most = weakref.WeakSet(), 0

    class Number(float):
        __hash__ = float.__hash__

    def rows():
        nonlocal most
        for i in range(2000):
            number = Number(i)
            alive.add(number)
            most = max(most, len(alive))
            yield {"ts": i, "id": number}
            del number

    class State:
        def get(self):
            return []

        def put(self, rows):
            self.kept = rows

    holder.events = State()
    list(holder.handleInputRows((), rows(), None))
    assert [e[0] for e in holder.events.kept] == [1999, 1998, 1997] and most < 10


def test_fan_out_and_callback(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [1, 2]).unionByName(events(spark, [3], "passed")))
    seen = []
    sinks = [lambda b, i: seen.append(("all", b.count())), lambda b, i: seen.append(("bad", b.where("verdict='blocked'").count()))]
    jobs.fan_out(feed.stream(), sinks, feed.mark).awaitTermination()
    assert seen == [("all", 3), ("bad", 2)]


def refuse(body):
    raise OSError("down")


def test_alert_feed_survives_a_dead_receiver(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [1, 2, 3]))
    failures = []
    jobs.alert_feed(feed.stream(), refuse, feed.mark, on_failures=lambda i, n: failures.append(n)).awaitTermination()
    assert failures == [3]


def test_running_totals(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [1, 2]))
    table = {}

    def land(batch, _):
        table.update({(r["layer"], r["verdict"]): r["n"] for r in batch.collect()})

    for extra in ([3], [4, 5]):
        writer = jobs.running_totals(feed.stream()).writeStream.outputMode("update").foreachBatch(land)
        jobs.drain(writer, feed.mark).awaitTermination()
        feed.push(events(spark, extra))
    writer = jobs.running_totals(feed.stream()).writeStream.outputMode("update").foreachBatch(land)
    jobs.drain(writer, feed.mark).awaitTermination()
    assert table == {("canary", "blocked"): 5}


def test_rolling_windows_overlap(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.push(events(spark, [0, 60 * 48]))
    jobs.to_files(jobs.rolling_metrics(feed.stream()), feed.out, feed.mark).awaitTermination()
    rows = spark.read.parquet(feed.out)
    assert rows.count() == 24 and rows.agg(F.sum("total")).first()[0] == 24


def streamed_documents(spark, tmp_path, build):
    """``build`` over a folder's documents as a stream and as a table: the rows, and how many parts the stream's are in."""
    from siftgate.plans.logs import _Streamed

    home = str(tmp_path)
    rows = [(i, "en", f"src{i % 3}", f"text {i} " * 5) for i in range(500)] + [(None, None, None, None)]
    schema = "doc_id long, lang string, source string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/documents.parquet")
    with_part = build(_Streamed(spark, home), home).withColumn("part", F.spark_partition_id())
    jobs.to_files(with_part, f"{home}/out", f"{home}/mark").awaitTermination()
    got = spark.read.schema(with_part.schema).parquet(f"{home}/out")
    texts = lambda df: sorted(map(str, df.select("doc_id", "lang", "source", "text").collect()))
    return texts(got), texts(build(spark, home)), got.select("part").distinct().count()


def test_planted_documents_stream(spark, tmp_path):
    from siftgate.plans.inputs import planted

    got, want, parts = streamed_documents(spark, tmp_path, planted)
    assert got == want and len(want) == 501 and parts >= spark.sparkContext.defaultParallelism


def test_documents_with_the_payload_in_front_stream(spark, tmp_path):
    from siftgate.plans.inputs import heads

    got, want, parts = streamed_documents(spark, tmp_path, heads)
    assert got == want and len(want) == 501 and parts >= spark.sparkContext.defaultParallelism
