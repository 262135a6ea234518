"""Event-log analytics.

"Now" is always the ``as_of`` argument. Time cutoffs are built as literals of the log's own
timestamp type, so they reach the file scan; bucket arithmetic is done on integer microseconds.
Each report is one scan and one aggregation.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgate.functions.text import WHITESPACE
from siftgate.options import OptionError
from siftgate.sources.storage import delete_folder, drop_scratch, scratch

LAYERS = ("sanitizer", "boundary", "detection", "canary")
US = 1_000_000
MAX_LIMIT = 1000


def at(df: DataFrame, ts: str, when: datetime) -> Column:
    """A cutoff literal of the column's own type: no cast stands between it and the scan."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(when.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        epoch = (when - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        return F.timestamp_micros(F.lit(epoch))
    raise OptionError(f"column {ts!r} must be a timestamp, got {kind.simpleString()}")


def since(df: DataFrame, ts: str, when: datetime, inclusive: bool = True) -> Column:
    """Rows from ``when`` on. A log stored by UTC ``date`` folders is also cut by folder, which a
    filter on the timestamp alone would not do."""
    cutoff = at(df, ts, when)
    rows = F.col(ts) >= cutoff if inclusive else F.col(ts) > cutoff
    if "date" in df.columns and isinstance(df.schema["date"].dataType, T.DateType):
        rows = (F.col("date") >= F.lit(when.date())) & rows
    return rows


def epoch_us(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch (zone-less values are read as UTC)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts))
        return F.unix_micros(utc.cast("timestamp"))
    return F.unix_micros(ts)


def micros(when: datetime) -> int:
    return (when - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def tally(weight: str | None, when: Column | None = None) -> Column:
    """Rows, or what the column ``weight`` says rows stand for, where ``when`` holds."""
    if weight is None:
        return F.count(F.lit(1)) if when is None else F.count_if(when)
    return F.coalesce(F.sum(weight if when is None else F.when(when, F.col(weight))), F.lit(0).cast("long"))


def query_events(
    log: DataFrame,
    layer: str | None = None,
    verdict: str | None = None,
    start: datetime | None = None,
    until: datetime | None = None,
    limit: int = 100,
    offset: int = 0,
    ts: str = "ts",
    id: str = "id",
) -> DataFrame:
    """Filtered events, newest first. Both time bounds are inclusive; ties break on id."""
    if not 0 <= limit <= MAX_LIMIT:
        raise OptionError(f"limit must be 0..{MAX_LIMIT}")
    out = log
    if layer:
        out = out.where(F.col("layer") == layer)
    if verdict:
        out = out.where(F.col("verdict") == verdict)
    if start:
        out = out.where(since(log, ts, start))
    if until:
        out = out.where(F.col(ts) <= at(log, ts, until))
    return out.orderBy(F.col(ts).desc(), F.col(id).desc()).offset(offset).limit(limit)


def _recent(log: DataFrame, as_of: datetime, hours: float, ts: str) -> DataFrame:
    return log.where(since(log, ts, as_of - timedelta(hours=hours)))


def metrics(log: DataFrame, as_of: datetime, hours: float = 24, ts: str = "ts", weight: str | None = None) -> DataFrame:
    """Counts by layer, by verdict and overall from one pass: ``(level, key, total, blocked)``.

    Here and below ``weight`` names a column that says how many events a row stands for.
    """
    rows = _recent(log, as_of, hours, ts).select("layer", "verdict", *([weight] if weight else []))
    out = rows.groupingSets([["layer"], ["verdict"], []], "layer", "verdict").agg(
        F.grouping("layer").alias("_gl"),
        F.grouping("verdict").alias("_gv"),
        tally(weight).alias("total"),
        tally(weight, F.col("verdict") == "blocked").alias("blocked"),
    )
    counted = out.select(
        F.when(F.col("_gl") == 0, "layer")
        .when(F.col("_gv") == 0, "verdict")
        .otherwise("all")
        .alias("level"),
        F.when(F.col("_gl") == 0, F.col("layer"))
        .when(F.col("_gv") == 0, F.col("verdict"))
        .otherwise("all")
        .alias("key"),
        "total",
        "blocked",
    )
    # grouping sets of an empty period give no total row at all; the report still has one
    zero = F.lit(0).cast("long")
    floor = log.sparkSession.range(1).select(
        F.lit("all").alias("level"), F.lit("all").alias("key"), zero.alias("total"), zero.alias("blocked")
    )
    return counted.unionByName(floor).groupBy("level", "key").agg(
        F.sum("total").alias("total"), F.sum("blocked").alias("blocked")
    )


def _spine(log: DataFrame, start: int, size: float, buckets: int) -> DataFrame:
    spark = log.sparkSession
    return spark.range(buckets).select(
        F.col("id").cast("int").alias("bucket"),
        (F.lit(start) + F.col("id") * F.lit(size)).alias("start_us"),
    )


def timeseries(
    log: DataFrame,
    as_of: datetime,
    hours: float = 24,
    buckets: int = 24,
    layer: str | None = None,
    ts: str = "ts",
    weight: str | None = None,
) -> DataFrame:
    """``buckets`` equal half-open buckets up to ``as_of``, zero-filled.

    The bucket of an event is arithmetic, so there is one aggregate however many buckets are
    asked for; the spine it is joined to holds one row per bucket.
    """
    if buckets < 1:
        raise OptionError("buckets must be positive")
    span = int(hours * 3600 * US)
    start = micros(as_of) - span
    size = span / buckets
    rows = _recent(log, as_of, hours, ts).where(F.col(ts) < at(log, ts, as_of))
    if layer:
        rows = rows.where(F.col("layer") == layer)
    slot = F.floor((epoch_us(log, ts) - F.lit(start)) / F.lit(size)).cast("int")
    counts = rows.groupBy(slot.alias("bucket")).agg(
        tally(weight).alias("total"),
        tally(weight, F.col("verdict") == "blocked").alias("blocked"),
        tally(weight, F.col("verdict") == "modified").alias("modified"),
    )
    zero = F.lit(0).cast("long")
    return _spine(log, start, size, buckets).join(counts, "bucket", "left").select(
        "bucket",
        F.bround(F.col("start_us") / US, 0).cast("long").alias("t"),
        *[F.coalesce(c, zero).alias(c) for c in ("total", "blocked", "modified")],
    )


def prune(log: DataFrame, as_of: datetime, days: int = 30, ts: str = "ts") -> DataFrame:
    """Events to keep."""
    return log.where(since(log, ts, as_of - timedelta(days=days)))


def prune_counts(log: DataFrame, as_of: datetime, days: int = 30, ts: str = "ts") -> DataFrame:
    keep = F.col(ts) >= at(log, ts, as_of - timedelta(days=days))
    return log.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("deleted"))


def prune_stored(spark, path: str, as_of: datetime, days: int = 30, ts: str = "ts") -> int:
    """Delete what is older than ``days`` from a log in UTC date folders; returns how many events went.

    Whole folders are dropped; only the folder that holds the cutoff is rewritten, by way of a
    scratch copy, so that nothing reads what it overwrites.
    """
    log = spark.read.parquet(path)
    cutoff = as_of - timedelta(days=days)
    keep, edge = F.col(ts) >= at(log, ts, cutoff), F.lit(cutoff.date())
    old = log.where(F.col("date") <= edge)
    gone = old.groupBy("date").agg(F.count_if(~keep).alias("n"), F.count_if(keep).alias("left")).collect()
    for row in gone:
        folder = f"{path}/date={row['date']}"
        if row["n"] and row["left"]:
            kept, copy = log.where((F.col("date") == row["date"]) & keep), scratch(spark, "pruned")
            kept.write.parquet(copy)
            spark.read.schema(log.schema).parquet(copy).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("date").parquet(path)
            drop_scratch(spark, copy)
        elif row["n"]:
            delete_folder(spark, folder)
    return sum(row["n"] for row in gone)


def decode_metadata(log: DataFrame, schema: str, metadata: str = "metadata") -> DataFrame:
    """Replace the metadata text by a typed struct; empty text reads as an empty object."""
    body = F.coalesce(F.nullif(metadata, F.lit("")), F.lit("{}"))
    return log.withColumn(metadata, F.from_json(body, schema))


def normal_layer(layer: Column) -> Column:
    return (
        F.when(layer.isNull() | (layer == ""), "sanitizer")
        .when(layer.startswith("detection:"), "detection")
        .when(layer == "trust_boundary", "boundary")
        .when(layer.isin("analysis_guard", "canary"), "canary")
        .otherwise(layer)
    )


def reshape(log: DataFrame, ts: str = "ts", *keep: str) -> DataFrame:
    """Events as the dashboard reads them: epoch milliseconds, normal layer, filled defaults."""
    blank = F.lit("")
    return log.select(
        F.col("id").cast("string").alias("id"),
        F.round(epoch_us(log, ts) / 1000, 0).cast("long").alias("ts_ms"),
        normal_layer(F.col("layer")).alias("layer"),
        F.coalesce(F.nullif("verdict", blank), F.lit("passed")).alias("verdict"),
        F.coalesce(F.nullif("source_id", blank), F.lit("api:clean")).alias("source"),
        F.coalesce("detail", blank).alias("detail"),
        F.round(F.coalesce("duration_ms", F.lit(0.0)), 0).cast("long").alias("duration_ms"),
        F.coalesce("layer", blank).alias("raw_layer"),
        *keep,
    )


def search(
    events: DataFrame, verdict: str = "all", layer: str = "all", text: str = ""
) -> DataFrame:
    """Facets and a case-folded substring of detail or source."""
    out = events
    if verdict != "all":
        out = out.where(F.col("verdict") == verdict)
    if layer != "all":
        out = out.where(F.col("layer") == layer)
    needle = text.strip(WHITESPACE).lower()
    if needle:
        hit = F.contains(F.lower("detail"), F.lit(needle)) | F.contains(
            F.lower("source"), F.lit(needle)
        )
        out = out.where(hit)
    return out


def verdict_facets(events: DataFrame, weight: str | None = None) -> DataFrame:
    return events.groupBy("verdict").agg(tally(weight).alias("n"))


def timeline(log: DataFrame, as_of: datetime, ts: str = "ts") -> DataFrame:
    """Twenty-four five-minute buckets up to ``as_of``: all and blocked."""
    return timeseries(log, as_of, hours=2, buckets=24, ts=ts).select("bucket", "total", "blocked")


def layer_sparks(log: DataFrame, as_of: datetime, ts: str = "ts", weight: str | None = None) -> DataFrame:
    """Counts per normal layer over the last fourteen minutes, on a full layer x minute grid.

    Ages run from ``as_of`` backwards: age 0 belongs to the last minute, fourteen is outside.
    """
    rows = log.where(
        since(log, ts, as_of - timedelta(minutes=14), inclusive=False)
        & (F.col(ts) <= at(log, ts, as_of))
    )
    age = F.lit(micros(as_of)) - epoch_us(log, ts)
    counts = rows.groupBy(
        normal_layer(F.col("layer")).alias("layer"),
        (F.lit(13) - F.floor(age / F.lit(60 * US))).cast("int").alias("bucket"),
    ).agg(tally(weight).alias("n"))
    grid = log.sparkSession.range(14).select(
        F.explode(F.array(*[F.lit(x) for x in LAYERS])).alias("layer"),
        F.col("id").cast("int").alias("bucket"),
    )
    return grid.join(counts, ["layer", "bucket"], "left").select(
        "layer", "bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def incident(log: DataFrame, as_of: datetime, ts: str = "ts", weight: str | None = None) -> DataFrame:
    """Whether anything was blocked in the last thirty minutes, and how much."""
    window = since(log, ts, as_of - timedelta(minutes=30), inclusive=False)
    recent = log.where((F.col("verdict") == "blocked") & window)
    return recent.agg(tally(weight).alias("blocked_recent")).select(
        (F.col("blocked_recent") > 0).alias("incident"), "blocked_recent"
    )


def latest(log: DataFrame, n: int = 500, ts: str = "ts", id: str = "id") -> DataFrame:
    return log.orderBy(F.col(ts).desc(), F.col(id).desc()).limit(n)


def layer_counts(
    log: DataFrame, as_of: datetime, hours: float = 24, ts: str = "ts", weight: str | None = None
) -> DataFrame:
    rows = log.where(since(log, ts, as_of - timedelta(hours=hours), inclusive=False))
    return rows.groupBy(normal_layer(F.col("layer")).alias("layer")).agg(tally(weight).alias("n"))


def stat_tiles(log: DataFrame, as_of: datetime, hours: float = 24, ts: str = "ts", weight: str | None = None) -> DataFrame:
    layer = normal_layer(F.col("layer"))
    bad = F.col("verdict") == "blocked"
    return _recent(log, as_of, hours, ts).agg(
        tally(weight).alias("processed"),
        tally(weight, bad).alias("blocked"),
        tally(weight, bad & (layer == "canary")).alias("canary"),
        tally(weight, bad & (layer == "detection")).alias("detection"),
    )
