"""Structured Streaming forms of the batch operators.

Screening and guarding are stateless: the batch functions apply to a stream unchanged, because a
document's variants and windows never leave its row. Counters keep bounded state behind a
watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftgate.operators import screening
from siftgate.operators.events import normal_layer
from siftgate.operators.guarding import guard
from siftgate.sources.corpora import blocked_only, post_events
from siftgate.sources.storage import delete_folder
from siftgate.streaming.stateful import microseconds, newest_per_key, stream_wide_sessions


def screen_stream(docs: DataFrame, **options) -> DataFrame:
    return screening.screen(docs, **options)


def guard_stream(outputs: DataFrame, **options) -> DataFrame:
    return guard(outputs, **options)


def _verdict_counts() -> list:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verdict") == "blocked").alias("blocked"),
        F.count_if(F.col("verdict") == "modified").alias("modified"),
    ]


def _edges(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *rest
    )


def tumbling_counts(
    events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Events per window and layer."""
    rows = events.withWatermark(ts, lateness)
    return _edges(
        rows.groupBy(F.window(ts, width), normal_layer(F.col("layer")).alias("layer")).agg(
            *_verdict_counts()
        )
    )


def _pane(width: str, slide: str) -> str:
    """The longest pane that windows of ``width``, begun every ``slide``, are made of."""
    return f"{gcd(microseconds(width), microseconds(slide))} microseconds"


def rolling_metrics(
    events: DataFrame,
    width: str = "24 hours",
    slide: str = "1 hour",
    lateness: str = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """Verdicts in windows of ``width``, one every ``slide``.

    Events are counted once, in panes; a closed pane (one row) goes into the windows that cover it.
    State holds a row per open pane and a row per open window, and no event is copied.
    """
    rows = events.withWatermark(ts, lateness)
    panes = rows.groupBy(F.window(ts, _pane(width, slide))).agg(*_verdict_counts())
    counts = [F.sum(c).alias(c) for c in ("total", "blocked", "modified")]
    return _edges(panes.groupBy(F.window(F.window_time("window"), width, slide)).agg(*counts))


def incident_sessions(
    events: DataFrame,
    by: Sequence[str] = (),
    gap: str = "30 minutes",
    lateness: str = "10 minutes",
    ts: str = "ts",
) -> DataFrame:
    """Runs of blocked events less than ``gap`` apart, over the whole stream or per ``by``.

    Stream-wide sessions are merged per time bucket, and then at the edges of buckets (see
    :mod:`siftgate.streaming.stateful`). Sessions per key first merge in each task, so a key's
    state holder gets sessions, not events.
    """
    if not by:
        return _edges(stream_wide_sessions(blocked_only(events), gap, lateness, ts))
    events.sparkSession.conf.set(
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"
    )
    rows = blocked_only(events).withWatermark(ts, lateness)
    out = rows.groupBy(F.session_window(ts, gap).alias("window"), *by).agg(
        F.count(F.lit(1)).alias("blocked")
    )
    return _edges(out)


def running_totals(events: DataFrame) -> DataFrame:
    """Totals per layer and verdict since the start (update mode; state is one row per pair)."""
    return events.groupBy(normal_layer(F.col("layer")).alias("layer"), "verdict").agg(
        F.count(F.lit(1)).alias("n")
    )


def fan_out(
    events: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str
) -> StreamingQuery:
    """Hand every micro-batch to several sinks, reading it once."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()

    return drain(events.writeStream.foreachBatch(deliver), checkpoint)


def alert_feed(
    events: DataFrame,
    post: Callable[[dict], None],
    checkpoint: str,
    batch_size: int = 1,
    on_failures: Callable[[int, int], None] | None = None,
) -> StreamingQuery:
    """Blocked events only, posted in chunks; failures are counted, not raised."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        failed = post_events(batch, post, batch_size).count()
        if on_failures is not None:
            on_failures(batch_id, failed)

    return drain(blocked_only(events).writeStream.foreachBatch(deliver), checkpoint)


def latest_feed(
    events: DataFrame,
    path: str,
    checkpoint: str,
    n: int = 500,
    ts: str = "ts",
    id: str = "id",
    by: Sequence[str] = (),
    idle: str | None = None,
    shards: int = 8,
) -> StreamingQuery:
    """Keep the newest ``n`` events, of the stream or of each ``by``, in a table.

    Keyed state holds ``n`` events per key (per shard of the ids without ``by``). A batch writes the
    table anew as a version of its own, from the version before it and the keys that changed, and
    removes the one before that: two versions are stored however long the stream runs, and a
    batch that is run again after a failure still finds what it reads. With ``idle``, keys without
    events for so long leave the table.
    """
    spark = events.sparkSession
    shard = F.pmod(F.xxhash64(id), F.lit(shards)).cast("int")
    keys = list(by) or ["_shard"]

    def keyed(df: DataFrame) -> DataFrame:
        return df if by else df.withColumn("_shard", shard)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        try:
            held = changed.select(F.inline("events"))
            if batch_id > 0:
                before = keyed(read_latest(spark, path, batch_id - 1, events.schema))
                same = [before[c].eqNullSafe(changed[c]) for c in keys]
                held = held.unionByName(before.join(changed, same, "left_anti").select(*held.columns))
            if not by:
                held = held.orderBy(F.col(ts).desc(), F.col(id).desc()).limit(n)
            held.write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        finally:
            changed.unpersist()
        if batch_id > 1:
            delete_folder(spark, f"{path}/v{batch_id - 2}")

    newest = newest_per_key(keyed(events), keys, n, ts, id, idle)
    if not by:
        newest = newest.withColumn("events", F.transform("events", lambda e: e.dropFields("_shard")))
    return drain(newest.writeStream.outputMode("update").foreachBatch(deliver), checkpoint)


def read_latest(spark, path: str, last_batch: int, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/v{last_batch}")


def to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Exactly-once Parquet sink."""
    return drain(df.writeStream.outputMode(mode).format("parquet").option("path", path), checkpoint)


def drain(writer, checkpoint: str) -> StreamingQuery:
    """Process everything available, then stop (a real deployment sets its own trigger)."""
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark and were left out, over all progress reports."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for p in query.recentProgress
        for op in p.get("stateOperators", [])
    )
