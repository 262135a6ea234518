"""Registered queries: event-log analytics and their streaming forms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from siftgate.operators import events as ev
from siftgate.plans.inputs import (
    AS_OF,
    AS_OF_US,
    HEADS,
    LOG,
    Plan,
    log_events,
    planted,
)
from siftgate.plans.detection import FULL, SCREENED
from siftgate.plans.texts import FOUND
from siftgate.sources.corpora import append_events
from siftgate.sources.storage import scratch
from siftgate.streaming import jobs

PLAN = Plan()
NOW = "TIMESTAMP '2024-01-30 12:00:00'"
EVENT = "id, epoch_us(ts) AS ts_us, layer, verdict, source_id, duration_ms"


def _event(df):
    return df.select(
        "id", ev.epoch_us(df, "ts").alias("ts_us"), "layer", "verdict", "source_id", "duration_ms"
    )


@PLAN.add(
    "V1_query_events",
    f"WITH {LOG} SELECT {EVENT} FROM log WHERE layer = 'canary' AND verdict = 'blocked' AND ts >= "
    f"{NOW} - INTERVAL 20 DAY AND ts <= {NOW} ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 5",
)
def query_events(spark, sf):
    return _event(
        ev.query_events(
            log_events(spark, sf),
            layer="canary",
            verdict="blocked",
            start=AS_OF - timedelta(days=20),
            until=AS_OF,
            offset=5,
        )
    )


@PLAN.add(
    "V2_metrics",
    f"WITH {LOG}, r AS (SELECT layer, verdict FROM log WHERE ts >= {NOW} - INTERVAL 24 HOUR) "
    "SELECT 'layer' AS \"level\", layer AS \"key\", count(*) AS total, count_if(verdict = 'blocked') AS "
    "blocked FROM r GROUP BY layer UNION ALL SELECT 'verdict', verdict, count(*), "
    "count_if(verdict = 'blocked') FROM r GROUP BY verdict UNION ALL SELECT 'all', 'all', count(*), "
    "count_if(verdict = 'blocked') FROM r",
)
def metrics(spark, sf):
    return ev.metrics(log_events(spark, sf), AS_OF)


def _series_sql(hours: int, buckets: int, where: str = "TRUE", columns: str = "") -> str:
    size = hours * 3600 // buckets
    return (
        f"WITH {LOG}, spine AS (SELECT i::BIGINT AS bucket, {NOW} - INTERVAL {hours} HOUR + "
        f"i * INTERVAL {size} SECOND AS s FROM range({buckets}) t(i)) "
        "SELECT bucket, " + (columns or "epoch_us(s) // 1000000 AS t, ")
        + "count(id) AS total, count(*) FILTER (verdict = 'blocked') AS blocked"
        + ("" if columns else ", count(*) FILTER (verdict = 'modified') AS modified")
        + f" FROM spine LEFT JOIN (SELECT * FROM log WHERE {where}) l ON ts >= s AND ts < s + "
        f"INTERVAL {size} SECOND GROUP BY bucket, s"
    )


@PLAN.add("V3_timeseries", _series_sql(24, 24))
def timeseries(spark, sf):
    return ev.timeseries(log_events(spark, sf), AS_OF)


@PLAN.add("V3_timeseries_layer", _series_sql(720, 60, "layer = 'detection:model'"))
def timeseries_layer(spark, sf):
    return ev.timeseries(
        log_events(spark, sf), AS_OF, hours=720, buckets=60, layer="detection:model"
    )


@PLAN.add(
    "V4_prune", f"WITH {LOG} SELECT id FROM log WHERE ts >= {NOW} - INTERVAL 7 DAY"
)
def prune(spark, sf):
    return ev.prune(log_events(spark, sf), AS_OF, days=7).select("id")


@PLAN.add(
    "V4_prune_counts",
    f"WITH {LOG} SELECT count_if(ts >= {NOW} - INTERVAL 7 DAY) AS kept, "
    f"count_if(ts < {NOW} - INTERVAL 7 DAY) AS deleted FROM log",
)
def prune_counts(spark, sf):
    return ev.prune_counts(log_events(spark, sf), AS_OF, days=7)


@PLAN.add(
    "V4_prune_stored",
    f"WITH {LOG} SELECT count_if(ts < {NOW} - INTERVAL 7 DAY) AS deleted, count_if(ts >= {NOW} - INTERVAL 7 DAY) "
    "AS left_over, min(CASE WHEN ts >= " + NOW + " - INTERVAL 7 DAY THEN id END) AS first_id FROM log",
)
def prune_stored(spark, sf):
    """The log is stored in date folders, pruned in place, and read again."""
    log = log_events(spark, sf)
    path = scratch(spark, "pruned-log")
    append_events(log.withColumn("ts", F.timestamp_micros(ev.epoch_us(log, "ts"))), path)
    deleted = ev.prune_stored(spark, path, AS_OF, days=7)
    return spark.read.parquet(path).agg(
        F.lit(deleted).cast("long").alias("deleted"),
        F.count(F.lit(1)).alias("left_over"),
        F.min("id").alias("first_id"),
    )


@PLAN.add(
    "V5_metadata",
    f"WITH {LOG} SELECT id, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM log",
)
def metadata(spark, sf):
    out = ev.decode_metadata(log_events(spark, sf), "k long")
    return out.select("id", F.col("metadata.k").alias("k"))


RESHAPED = (
    "shaped AS (SELECT id::VARCHAR AS id, CAST(floor(epoch_us(ts) / 1000.0 + 0.5) AS BIGINT) AS ts_ms, "
    "nlayer AS layer, verdict, source_id AS source, detail, CAST(floor(duration_ms + 0.5) AS BIGINT) "
    "AS duration_ms, layer AS raw_layer FROM log)"
)


@PLAN.add("V6_reshape", f"WITH {LOG}, {RESHAPED} SELECT * FROM shaped")
def reshape(spark, sf):
    return ev.reshape(log_events(spark, sf))


@PLAN.add(
    "V7_search",
    f"WITH {LOG}, {RESHAPED} SELECT id, layer, source FROM shaped WHERE verdict = 'blocked' AND "
    "layer = 'detection' AND (contains(lower(detail), 'user:1') OR contains(lower(source), 'user:1'))",
)
def search(spark, sf):
    shaped = ev.reshape(log_events(spark, sf))
    return ev.search(shaped, "blocked", "detection", " USER:1 ").select("id", "layer", "source")


@PLAN.add("V8_verdict_facets", f"WITH {LOG} SELECT verdict, count(*) AS n FROM log GROUP BY verdict")
def verdict_facets(spark, sf):
    return ev.verdict_facets(log_events(spark, sf))


@PLAN.add("V9_timeline", _series_sql(2, 24, columns=" "))
def timeline(spark, sf):
    return ev.timeline(log_events(spark, sf), AS_OF)


@PLAN.add(
    "V10_layer_sparks",
    f"WITH {LOG}, b AS (SELECT nlayer, 13 - CAST(floor(({AS_OF_US} - epoch_us(ts)) / 60000000.0) AS BIGINT) "
    f"AS bucket FROM log WHERE ts <= {NOW} AND {AS_OF_US} - epoch_us(ts) < 840000000) "
    "SELECT l.layer, g.i::BIGINT AS bucket, count(b.bucket) AS n FROM (VALUES ('sanitizer'), "
    "('boundary'), ('detection'), ('canary')) l(layer) CROSS JOIN range(14) g(i) LEFT JOIN b "
    "ON b.nlayer = l.layer AND b.bucket = g.i GROUP BY ALL",
)
def layer_sparks(spark, sf):
    return ev.layer_sparks(log_events(spark, sf), AS_OF)


@PLAN.add(
    "V11_incident",
    f"WITH {LOG} SELECT count(*) > 0 AS incident, count(*) AS blocked_recent FROM log WHERE verdict = "
    f"'blocked' AND ts > {NOW} - INTERVAL 30 MINUTE",
)
def incident(spark, sf):
    return ev.incident(log_events(spark, sf), AS_OF)


@PLAN.add("V12_latest", f"WITH {LOG} SELECT {EVENT} FROM log ORDER BY ts DESC, id DESC LIMIT 500")
def latest(spark, sf):
    return _event(ev.latest(log_events(spark, sf)))


@PLAN.add(
    "V13_layer_counts",
    f"WITH {LOG} SELECT nlayer AS layer, count(*) AS n FROM log WHERE ts > {NOW} - INTERVAL 24 HOUR "
    "GROUP BY nlayer",
)
def layer_counts(spark, sf):
    return ev.layer_counts(log_events(spark, sf), AS_OF)


@PLAN.add(
    "V14_stat_tiles",
    f"WITH {LOG} SELECT count(*) AS processed, count_if(verdict = 'blocked') AS blocked, "
    "count_if(verdict = 'blocked' AND nlayer = 'canary') AS canary, count_if(verdict = 'blocked' AND "
    f"nlayer = 'detection') AS detection FROM log WHERE ts >= {NOW} - INTERVAL 24 HOUR",
)
def stat_tiles(spark, sf):
    return ev.stat_tiles(log_events(spark, sf), AS_OF)


# --- streams: drain the table through a streaming query, then read what it wrote ------------------


def stream(spark, sf, name):
    """The driver table, one file or a folder of files, as a file stream (which takes one file by a pattern only)."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


class _Streamed:
    """Stand-in for ``spark.read`` in the shared input builders: same tables, as streams."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self.read = spark, sf, self

    def parquet(self, path):
        return stream(self.spark, self.sf, path.rsplit("/", 1)[1].removesuffix(".parquet"))


def streamed_log(spark, sf):
    log = log_events(_Streamed(spark, sf), sf)
    return log.withColumn("ts", F.timestamp_micros(ev.epoch_us(log, "ts")))


def drained(spark, df, name, mode="append"):
    """Run the stream to its end into a scratch table and read that back."""
    path, mark = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    jobs.to_files(df, path, mark, mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@PLAN.add(
    "R1_screen_stream",
    SCREENED + " SELECT doc_id, md5(result) AS digest, blocked, blocked_at, blocked_at_variant "
    "FROM screened",
)
def screen_stream(spark, sf):
    docs = planted(_Streamed(spark, sf), sf)
    out = jobs.screen_stream(docs, options=FULL, source=F.col("source"))
    out = out.select(
        "doc_id", F.md5("result").alias("digest"), "blocked", "blocked_at", "blocked_at_variant"
    )
    return drained(spark, out, "screened")


@PLAN.add(
    "R2_guard_stream",
    f"WITH {HEADS}, r AS (SELECT doc_id, {FOUND} AS reason FROM planted) SELECT doc_id, reason, "
    "reason IS NULL AS safe FROM r",
)
def guard_stream(spark, sf):
    from siftgate.plans.inputs import heads

    out = jobs.guard_stream(heads(_Streamed(spark, sf), sf))
    return drained(spark, out.select("doc_id", "reason", "safe"), "guarded")


def _edges(df, *rest):
    return df.select(
        F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), *rest
    )


COUNTS = (
    "count(*) AS total, count(*) FILTER (verdict = 'blocked') AS blocked, "
    "count(*) FILTER (verdict = 'modified') AS modified"
)
# append mode emits a window once the watermark (latest event minus ten minutes) has passed its end
CLOSED = "end_us <= (SELECT max(epoch_us(ts)) - 600000000 FROM log)"


@PLAN.add(
    "R3_tumbling_counts",
    f"WITH {LOG}, w AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, * FROM log), "
    f"g AS (SELECT start_us, start_us + 3600000000 AS end_us, nlayer AS layer, {COUNTS} FROM w "
    f"GROUP BY start_us, nlayer) SELECT * FROM g WHERE {CLOSED}",
)
def tumbling_counts(spark, sf):
    out = jobs.tumbling_counts(streamed_log(spark, sf))
    return _edges(
        drained(spark, out, "tumbling"), "layer", "total", "blocked", "modified"
    )


@PLAN.add(
    "R4_rolling_metrics",
    f"WITH {LOG}, w AS (SELECT (epoch_us(ts) // 3600000000 - t.i) * 3600000000 AS start_us, log.* "
    "FROM log, range(24) t(i)), "
    f"g AS (SELECT start_us, start_us + 86400000000 AS end_us, {COUNTS} FROM w GROUP BY start_us) "
    f"SELECT * FROM g WHERE {CLOSED}",
)
def rolling_metrics(spark, sf):
    out = jobs.rolling_metrics(streamed_log(spark, sf))
    return _edges(drained(spark, out, "rolling"), "total", "blocked", "modified")


def _sessions_sql(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return (
        f"WITH {LOG}, b AS (SELECT source_id, ts, epoch_us(ts) AS us FROM log WHERE verdict = 'blocked'), "
        f"g AS (SELECT *, CASE WHEN us - lag(us) OVER ({part}ORDER BY us) < 1800000000 THEN 0 ELSE 1 END "
        f"AS fresh FROM b), s AS (SELECT *, sum(fresh) OVER ({part}ORDER BY us) AS sid FROM g), "
        f"e AS (SELECT {keys}min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS blocked "
        f"FROM s GROUP BY {keys}sid) "
        "SELECT * FROM e WHERE end_us <= (SELECT max(us) - 600000000 FROM b)"
    )


@PLAN.add("R5_incident_sessions", _sessions_sql(""))
def incident_sessions(spark, sf):
    out = jobs.incident_sessions(streamed_log(spark, sf))
    return _edges(drained(spark, out, "sessions"), "blocked")


@PLAN.add("R5_incident_sessions_by_source", _sessions_sql("source_id"))
def incident_sessions_by_source(spark, sf):
    out = jobs.incident_sessions(streamed_log(spark, sf), by=["source_id"])
    return _edges(drained(spark, out, "sessions"), "source_id", "blocked")


def refusing_post(body: dict) -> None:
    """A receiver that refuses every fifth event."""
    if any(e["id"] % 5 == 0 for e in body["events"]):
        raise ConnectionError("refused")


@PLAN.add(
    "R6_alert_feed",
    f"WITH {LOG} SELECT count(*) AS failed FROM log WHERE verdict = 'blocked' AND id % 5 = 0",
)
def alert_feed(spark, sf):
    """Blocked events are posted one by one; what the receiver refuses is counted per batch."""
    refused: list[tuple[int, int]] = []
    events = streamed_log(spark, sf).drop("ts")
    query = jobs.alert_feed(
        events, refusing_post, scratch(spark, "alerts-checkpoint"), 1, lambda batch, n: refused.append((batch, n))
    )
    query.awaitTermination()
    batches = spark.createDataFrame(refused, "batch long, n long")
    return batches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed"))


@PLAN.add(
    "R7_running_totals",
    f"WITH {LOG} SELECT nlayer AS layer, verdict, count(*) AS n FROM log GROUP BY ALL",
)
def running_totals(spark, sf):
    """Update mode re-emits a total whenever it grows, so the newest (largest) one stands."""
    path, mark = scratch(spark, "totals"), scratch(spark, "totals-checkpoint")
    totals = jobs.running_totals(streamed_log(spark, sf))

    def land(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = totals.writeStream.outputMode("update").foreachBatch(land)
    jobs.drain(writer, mark).awaitTermination()
    out = spark.read.schema(totals.schema).parquet(path)
    return out.groupBy("layer", "verdict").agg(F.max("n").alias("n"))


@PLAN.add("R8_latest_feed", f"WITH {LOG} SELECT {EVENT} FROM log ORDER BY ts DESC, id DESC LIMIT 500")
def latest_feed(spark, sf):
    path, mark = scratch(spark, "latest"), scratch(spark, "latest-checkpoint")
    query = jobs.latest_feed(streamed_log(spark, sf), path, mark)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return _event(jobs.read_latest(spark, path, last))


@PLAN.add(
    "R8_latest_feed_by_layer",
    f"WITH {LOG} SELECT {EVENT} FROM log QUALIFY row_number() OVER (PARTITION BY layer ORDER BY ts DESC, id DESC) <= 50",
)
def latest_feed_by_layer(spark, sf):
    path, mark = scratch(spark, "latest"), scratch(spark, "latest-checkpoint")
    query = jobs.latest_feed(streamed_log(spark, sf), path, mark, n=50, by=["layer"])
    query.awaitTermination()
    return _event(jobs.read_latest(spark, path, query.lastProgress["batchId"]))


@PLAN.add(
    "R9_late_events",
    f"WITH {LOG}, m AS (SELECT max(epoch_us(ts)) AS top FROM log), "
    "late AS (SELECT count(*) AS n FROM log, m WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= "
    "top - 600000000) SELECT (SELECT count(*) FROM log) + (SELECT count(*) FROM log) - (SELECT n FROM late) "
    "AS counted, (SELECT n FROM late) AS behind_watermark",
)
def late_events(spark, sf):
    """The log arrives twice, one file after the other: the second copy of every window that the
    first copy has closed is too late and must not be counted again."""
    feed, mark = scratch(spark, "replay"), scratch(spark, "replay-checkpoint")
    log = log_events(spark, sf)
    plain = log.select(
        F.timestamp_micros(ev.epoch_us(log, "ts")).alias("ts"), "layer", "verdict"
    )
    path = scratch(spark, "replay-out")
    schema = plain.schema
    for _ in range(2):
        plain.write.mode("append").parquet(feed)
        rows = spark.readStream.schema(schema).parquet(feed)
        out = jobs.tumbling_counts(rows)
        writer = out.writeStream.outputMode("update").foreachBatch(_land(path))
        jobs.drain(writer, mark).awaitTermination()
    # update mode repeats a window as it grows: the newest batch that names it stands
    emitted = spark.read.parquet(path)
    final = emitted.groupBy("start", "layer").agg(F.max("total").alias("total"))
    both = final.select(F.col("total").alias("counted"), F.lit(0).alias("arrived")).unionByName(
        log.select(F.lit(0).alias("counted"), F.lit(2).alias("arrived"))
    )
    return both.agg(
        F.sum("counted").alias("counted"),
        (F.sum("arrived") - F.sum("counted")).alias("behind_watermark"),
    )


def _land(path):
    def land(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return land
