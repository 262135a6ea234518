"""A stored event log with what its readers would otherwise scan it for.

Layout below one folder::

    log/date=D/seq=S        events, by UTC day and by append
    minutes/date=D/upto=S   counts per minute, raw layer and verdict of the appends up to S
    grams/date=D/seq=S      hashed trigrams of what a search looks at, per file
    commits/S, rolled/S     empty files: append S is complete; the counts cover appends up to S

An append is visible once its commit exists; what a crashed one has left is removed by the next. The
counts may lag behind: answers are the counts of covered appends, plus the raw rows of later ones
(the tail), plus the raw rows of covered minutes that a bound of the question cuts in two. So every
answer is that of the raw rows, while files read are counts, tail and a few minutes. One writer.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgate.functions.text import WHITESPACE
from siftgate.operators import events as ev
from siftgate.options import OptionError
from siftgate.sources.storage import delete_folder, drop_scratch, empty_file, folder_names, scratch

MINUTE = 60 * ev.US
UNDATED = "__HIVE_DEFAULT_PARTITION__"


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


@dataclass(frozen=True)
class EventStore:
    spark: SparkSession
    path: str
    ts: str = "ts"
    searchable: bool = True

    # --- writing ----------------------------------------------------------------------------------

    def append(self, events: DataFrame) -> int:
        """Add events and, if the store is searchable, the trigrams of their files. Returns the append's number."""
        if not isinstance(events.schema[self.ts].dataType, T.TimestampType):
            raise OptionError(f"column {self.ts!r} must be a timestamp")
        seq = self.last() + 1
        for kind, name in (("log", "seq"), ("grams", "seq")):
            self._drop(kind, f"{name}={seq}")
        day = F.date_from_unix_date(F.floor(ev.epoch_us(events, self.ts) / 86_400_000_000).cast("int"))
        rows = events.withColumn("date", day).withColumn("seq", F.lit(seq))
        rows.write.mode("append").partitionBy("date", "seq").parquet(f"{self.path}/log")
        if self.searchable:
            self._index(self._log().where(F.col("seq") == seq))
        empty_file(self.spark, f"{self.path}/commits/{seq}")
        return seq

    def roll_up(self) -> int:
        """Count the appends that are not counted yet. Returns the last one that is."""
        covered, last = self.covered(), self.last()
        if covered < last:
            self._drop("minutes", f"upto={last}")
            self._count(self.log().where(F.col("seq") > covered), last)
            empty_file(self.spark, f"{self.path}/rolled/{last}")
        return last

    def prune(self, as_of: datetime, days: int = 30) -> int:
        """Delete events older than ``days``, with their counts and trigrams. Returns how many went.

        Days before the cutoff go as folders; the day of the cutoff is written anew by way of a
        scratch copy.
        """
        cutoff = as_of - timedelta(days=days)
        edge, log = cutoff.date(), self.log()
        keep = F.col(self.ts) >= ev.at(log, self.ts, cutoff)
        gone = log.where((F.col("date") < F.lit(edge)) | ((F.col("date") == F.lit(edge)) & ~keep)).count()
        for kind in ("log", "minutes", "grams"):
            for day in self._days(kind):
                if day != UNDATED and date.fromisoformat(day) < edge:
                    delete_folder(self.spark, f"{self.path}/{kind}/date={day}")
        if edge.isoformat() in self._days("log"):
            copy, covered = scratch(self.spark, "pruned"), self.covered()
            log.where((F.col("date") == F.lit(edge)) & keep).write.parquet(copy)
            kept = self.spark.read.schema(log.schema).parquet(copy)
            for kind in ("log", "minutes", "grams"):
                delete_folder(self.spark, f"{self.path}/{kind}/date={edge}")
            kept.write.mode("append").partitionBy("date", "seq").parquet(f"{self.path}/log")
            self._count(kept.where(F.col("seq") <= covered), covered)
            if self.searchable:
                self._index(self._log().where(F.col("date") == F.lit(edge)))
            drop_scratch(self.spark, copy)
        return gone

    def _count(self, rows: DataFrame, upto: int) -> None:
        minute = F.floor(ev.epoch_us(rows, self.ts) / MINUTE).cast("long")
        counts = rows.groupBy("date", minute.alias("minute"), "layer", "verdict").agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("upto", F.lit(upto)).write.mode("append").partitionBy("date", "upto").parquet(f"{self.path}/minutes")

    def _index(self, rows: DataFrame) -> None:
        """``(file, gram)`` hashes of what :func:`siftgate.operators.events.search` compares, per file."""
        seen = ev.reshape(rows.withColumn("_file", F.regexp_extract("_metadata.file_path", r"date=[^/]*/seq=[^/]*/[^/]*$", 0)), self.ts, "date", "seq", "_file")
        found = [F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(...))"), F.lit(1)) for c in ("detail", "source")]
        grams = seen.select("date", "seq", F.col("_file").alias("file"), F.explode(F.array_distinct(F.concat(*found))).alias("g"))
        hashed = grams.select("date", "seq", "file", F.xxhash64("g").alias("gram")).distinct()
        hashed.sortWithinPartitions("date", "seq", "gram").write.mode("append").partitionBy("date", "seq").parquet(f"{self.path}/grams")

    # --- what is there ----------------------------------------------------------------------------

    def last(self) -> int:
        return max(map(int, folder_names(self.spark, f"{self.path}/commits")), default=-1)

    def covered(self) -> int:
        return max(map(int, folder_names(self.spark, f"{self.path}/rolled")), default=-1)

    def _days(self, kind: str) -> list[str]:
        return [n.removeprefix("date=") for n in folder_names(self.spark, f"{self.path}/{kind}") if n.startswith("date=")]

    def _drop(self, kind: str, part: str) -> None:
        for day in self._days(kind):
            delete_folder(self.spark, f"{self.path}/{kind}/date={day}/{part}")

    def _log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")

    def log(self) -> DataFrame:
        """All committed events, with ``date`` and ``seq``."""
        last = self.last()
        if last < 0:
            raise OptionError(f"no events in {self.path!r}")
        return self._log().where(F.col("seq") <= last)

    # --- counts -----------------------------------------------------------------------------------

    def cells(self, cuts: Iterable[int] = (), start: datetime | None = None) -> DataFrame:
        """``(ts, layer, verdict, n)``: counted minutes, and single events of the tail and of minutes that hold a cut.

        ``cuts`` are microseconds: a minute in which one lies is read from the log. ``start`` leaves
        out days before it.
        """
        covered, log = self.covered(), self.log()
        minutes = sorted({c // MINUTE for c in cuts})
        since = F.lit(True) if start is None else F.col("date") >= F.lit(start.date())
        own = F.floor(ev.epoch_us(log, self.ts) / MINUTE).cast("long")
        raw = F.col("seq") > covered
        if minutes:
            days = sorted({datetime(1970, 1, 1) + timedelta(minutes=m) for m in minutes})
            first, after = (F.timestamp_micros(F.lit(m * MINUTE)) for m in (minutes[0], minutes[-1] + 1))
            inside = F.col("date").isin([F.lit(d) for d in sorted({d.date() for d in days})]) & (F.col(self.ts) >= first) & (F.col(self.ts) < after)
            raw = raw | (inside & own.isin(minutes))
        events = log.where(raw & since).select(F.col(self.ts).alias("ts"), "layer", "verdict", F.lit(1).cast("long").alias("n"))
        if covered < 0:
            return events
        counts = self.spark.read.parquet(f"{self.path}/minutes").where((F.col("upto") <= covered) & since)
        if minutes:
            counts = counts.where(F.col("minute").isNull() | ~F.col("minute").isin(minutes))
        return events.unionByName(counts.select(F.timestamp_micros(F.col("minute") * MINUTE).alias("ts"), "layer", "verdict", "n"))

    def _recent(self, as_of: datetime, **back: float) -> DataFrame:
        start = as_of - timedelta(**back)
        return self.cells([ev.micros(start), ev.micros(as_of)], start)

    def metrics(self, as_of: datetime, hours: float = 24) -> DataFrame:
        return ev.metrics(self._recent(as_of, hours=hours), as_of, hours, weight="n")

    def timeseries(self, as_of: datetime, hours: float = 24, buckets: int = 24, layer: str | None = None) -> DataFrame:
        span = int(hours * 3600 * ev.US)
        first, size = ev.micros(as_of) - span, span / buckets
        edges = [first + size * k for k in range(buckets + 1)]
        # an edge on a full minute cuts none, unless rounding may move it
        cuts = [int(e) + d for e in edges for d in (-1, 0, 1) if e != int(e) or int(e) % MINUTE]
        return ev.timeseries(self.cells(cuts, as_of - timedelta(hours=hours)), as_of, hours, buckets, layer, weight="n")

    def timeline(self, as_of: datetime) -> DataFrame:
        return self.timeseries(as_of, hours=2, buckets=24).select("bucket", "total", "blocked")

    def verdict_facets(self) -> DataFrame:
        return ev.verdict_facets(self.cells(), weight="n")

    def layer_sparks(self, as_of: datetime) -> DataFrame:
        start = as_of - timedelta(minutes=14)
        cuts = [ev.micros(start) + k * MINUTE for k in range(15)]  # its minutes are closed at their end
        return ev.layer_sparks(self.cells(cuts, start), as_of, weight="n")

    def incident(self, as_of: datetime) -> DataFrame:
        return ev.incident(self._recent(as_of, minutes=30), as_of, weight="n")

    def layer_counts(self, as_of: datetime, hours: float = 24) -> DataFrame:
        return ev.layer_counts(self._recent(as_of, hours=hours), as_of, hours, weight="n")

    def stat_tiles(self, as_of: datetime, hours: float = 24) -> DataFrame:
        return ev.stat_tiles(self._recent(as_of, hours=hours), as_of, hours, weight="n")

    # --- events -----------------------------------------------------------------------------------

    def newest_days(self, need: int, rows: Column | None = None, start: datetime | None = None, until: datetime | None = None) -> list[str]:
        """The newest day folders that hold ``need`` events, or all: from the newest on, doubling, until they do."""
        days = sorted((d for d in self._days("log") if d != UNDATED), reverse=True)
        days = [d for d in days if (start is None or d >= start.date().isoformat()) and (until is None or d <= until.date().isoformat())]
        if start is None and until is None and UNDATED in self._days("log"):
            days.append(UNDATED)
        taken = 1
        while taken < len(days):
            found = self._folders(days[:taken])
            if (found if rows is None else found.where(rows)).limit(need).count() >= need:
                break
            taken *= 2
        return days[:taken]

    def _folders(self, days: list[str]) -> DataFrame:
        log = self.log()
        if not days:
            return log.where("false")
        reader = self.spark.read.schema(log.schema).option("basePath", f"{self.path}/log")
        return reader.parquet(*[f"{self.path}/log/date={d}" for d in days]).where(F.col("seq") <= self.last())

    def latest(self, n: int = 500) -> DataFrame:
        """The newest ``n`` events, read from the newest days only."""
        return ev.latest(self._folders(self.newest_days(n)), n, self.ts)

    def query(self, layer: str | None = None, verdict: str | None = None, start: datetime | None = None, until: datetime | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """As :func:`siftgate.operators.events.query_events`, read from the newest days that hold enough."""
        log, fits = self.log(), F.lit(True)
        for column, value in (("layer", layer), ("verdict", verdict)):
            if value:
                fits = fits & (F.col(column) == value)
        if start:
            fits = fits & (F.col(self.ts) >= ev.at(log, self.ts, start))
        if until:
            fits = fits & (F.col(self.ts) <= ev.at(log, self.ts, until))
        days = self.newest_days(limit + offset, fits, start, until)
        return ev.query_events(self._folders(days), layer, verdict, start, until, limit, offset, self.ts)

    def files_with(self, text: str) -> list[str] | None:
        """Files that may hold ``text``, by their trigrams; None if it is too short to tell."""
        grams = trigrams(text.strip(WHITESPACE).lower())
        if not grams or not self.searchable:
            return None
        wanted = [F.xxhash64(F.lit(g)) for g in grams]
        known = self.spark.read.parquet(f"{self.path}/grams").where((F.col("seq") <= self.last()) & F.col("gram").isin(wanted))
        files = known.groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
        return sorted(r["file"] for r in files.collect())  # names only; the read below lists them anyway

    def search(self, verdict: str = "all", layer: str = "all", text: str = "") -> DataFrame:
        """As :func:`siftgate.operators.events.search` over the reshaped log; only files that may match are opened."""
        files, log = self.files_with(text), self.log()
        if files is not None:
            reader = self.spark.read.schema(log.schema).option("basePath", f"{self.path}/log")
            log = reader.parquet(*[f"{self.path}/log/{f}" for f in files]) if files else log.where("false")
        return ev.search(ev.reshape(log, self.ts), verdict, layer, text)
