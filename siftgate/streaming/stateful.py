"""Stream-wide sessions and newest-event lists as keyed state.

Both keep their state per key and need the RocksDB state store, which :func:`use_keyed_state` sets
for queries started later in the session.

**Sessions in two levels.** A stream-wide session has no key of its own. Level one is the time
bucket: each task first merges its rows of a micro-batch into pieces that stay inside a bucket, and
the bucket's state holder merges those. A piece that touches no edge of its bucket is a session as
soon as the watermark passes its end. Level two sees only pieces that touch an edge, two per bucket
at most, and links those of neighbouring buckets. Because a bucket also reports that a piece at its
left edge has begun, level two knows when a session goes on in the next bucket and when it is over;
no session waits longer for its end than the watermark makes it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftgate.options import OptionError
from siftgate.sources.storage import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EDGE = -(1 << 62)  # the key under which pieces at bucket edges meet; no bucket has this number
GAPS_PER_BUCKET = 24
HELD_ROWS = 50_000  # rows a task holds before it lets go of those that are not among the newest


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def microseconds(duration: str) -> int:
    return pd.Timedelta(duration) // pd.Timedelta(1, "us")


def overlapping(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, blocked)`` with those that begin before another ends made one, by start."""
    merged: list[tuple[int, int, int]] = []
    for start, end, blocked in sorted(pieces):
        if merged and start < merged[-1][1]:
            first, until, n = merged.pop()
            start, end, blocked = first, max(until, end), n + blocked
        merged.append((start, end, blocked))
    return merged


def pieces_of(us: np.ndarray, gap: int, width: int) -> np.ndarray:
    """Sorted times as rows ``(bucket, start, end, count)``: runs less than ``gap`` apart inside a bucket."""
    bucket = us // width
    cut = np.flatnonzero((np.diff(us) >= gap) | (np.diff(bucket) != 0)) + 1
    first, last = np.append(0, cut), np.append(cut, len(us))
    return np.stack([bucket[first], us[first], us[last - 1] + gap, last - first], axis=1)


class BucketSessions(StatefulProcessor):
    """Merges the pieces of one bucket; gives ``session``, ``piece`` (touches an edge) and ``open`` rows."""

    def __init__(self, gap: int, width: int):
        self.gap, self.width = gap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "start long, end long, blocked long")
        self.told = handle.getValueState("told", "start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (bucket,) = key
        held = overlapping([*map(tuple, self.pieces.get()), *[(r.start, r.end, r.blocked) for r in rows]])
        self.pieces.put(held)
        for _, end, _ in held:
            self.handle.registerTimer(-(-end // 1000))
        self.handle.registerTimer(self.over(bucket))
        first = held[0][0]
        if first < bucket * self.width + self.gap and (not self.told.exists() or first < self.told.get()[0]):
            self.told.update((first,))
            yield self.row("open", bucket, (first, first, 0), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (bucket,) = key
        now, held = timerValues.getCurrentWatermarkInMs() * 1000, list(map(tuple, self.pieces.get()))
        over, rest = [p for p in held if p[1] <= now], [p for p in held if p[1] > now]
        if now >= self.over(bucket) * 1000:
            self.told.clear()
        if rest:
            self.pieces.put(rest)
        else:
            self.pieces.clear()
        for piece in over:
            inside = piece[0] >= bucket * self.width + self.gap and piece[1] <= (bucket + 1) * self.width
            yield self.row("session" if inside else "piece", bucket, piece, timerValues)

    def over(self, bucket: int) -> int:
        """When nothing can come into the bucket any more."""
        return -(-((bucket + 1) * self.width + self.gap) // 1000)

    def row(self, kind: str, bucket: int, piece: tuple[int, int, int], timerValues) -> Row:
        seen = datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=max(0, timerValues.getCurrentWatermarkInMs()) + 1)
        return Row(seen=seen, chain=bucket if kind == "session" else EDGE, kind=kind, bucket=bucket, start=piece[0], end=piece[1], blocked=piece[2])

    def close(self) -> None:
        pass


class EdgeSessions(StatefulProcessor):
    """Passes sessions on, links pieces of neighbouring buckets, gives a chain once nothing can follow it."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "start long, end long, blocked long")
        self.begun = handle.getMapState("begun", "bucket long", "start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] != EDGE:
            for r in rows:
                yield Row(start=r.start, end=r.end, blocked=r.blocked)
            return
        held, begun = list(map(tuple, self.pieces.get())), {k[0]: v[0] for k, v in self.begun.iterator()}
        for r in sorted(rows, key=lambda r: r.kind != "open"):
            if r.kind == "open":
                begun[r.bucket] = min(r.start, begun.get(r.bucket, r.start))
            else:
                held.append((r.start, r.end, r.blocked))
                if begun.get(r.bucket, r.end) >= r.start:
                    begun.pop(r.bucket, None)
        waiting = []
        for start, end, blocked in overlapping(held):
            if any(start <= s < end for s in begun.values()):
                waiting.append((start, end, blocked))
            else:
                yield Row(start=start, end=end, blocked=blocked)
        self.pieces.clear()
        if waiting:
            self.pieces.put(waiting)
        self.begun.clear()
        for bucket, start in begun.items():
            self.begun.updateValue((bucket,), (start,))

    def close(self) -> None:
        pass


def stream_wide_sessions(rows: DataFrame, gap: str, lateness: str, ts: str = "ts", buckets: str | None = None) -> DataFrame:
    """``(window, blocked)``: runs of rows less than ``gap`` apart over the whole stream.

    Rows count as late as in a session window: when their time and the gap lie behind the
    watermark. ``buckets`` is the width of a time bucket, 24 gaps unless given.
    """
    use_keyed_state(rows.sparkSession)
    ship(rows.sparkSession)
    apart = microseconds(gap)
    width = microseconds(buckets) if buckets else GAPS_PER_BUCKET * apart
    wait = (microseconds(lateness) + apart) // 1000

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pieces_of(us, apart, width) for us in (np.sort(b.column(0).to_numpy(zero_copy_only=False)) for b in batches) if len(us)]
        if found:
            every = np.concatenate(found)
            merged = []
            for bucket in np.unique(every[:, 0]).tolist():
                merged += [(bucket, *p) for p in overlapping(every[every[:, 0] == bucket, 1:].tolist())]
            bucket, start, end, blocked = map(list, zip(*merged))
            columns = [pa.array(end, pa.int64()).cast(pa.timestamp("us", "UTC")), *(pa.array(c, pa.int64()) for c in (bucket, start, end, blocked))]
            yield pa.RecordBatch.from_arrays(columns, ["seen", "bucket", "start", "end", "blocked"])

    times = rows.where(F.col(ts).isNotNull()).select(F.unix_micros(ts).alias("us"))
    pieces = times.mapInArrow(merge, "seen timestamp, bucket long, start long, end long, blocked long").withWatermark("seen", f"{wait} milliseconds")
    told = pieces.groupBy("bucket").transformWithState(
        BucketSessions(apart, width), "seen timestamp, chain long, kind string, bucket long, start long, end long, blocked long", "Append", "EventTime", eventTimeColumnName="seen"
    )
    linked = told.groupBy("chain").transformWithState(EdgeSessions(width), "start long, end long, blocked long", "Append", "EventTime")
    return linked.select(F.struct(F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end")).alias("window"), "blocked")


# --- the newest events of each key --------------------------------------------------------------


class Newest(StatefulProcessor):
    """Holds the newest ``n`` events of a key and gives them all whenever they change; an idle key is let go."""

    def __init__(self, names: Sequence[str], keys: Sequence[str], schema: str, order: Sequence[str], n: int, idle: bool):
        self.names, self.keys, self.schema, self.order, self.n, self.idle = list(names), list(keys), schema, list(order), n, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.schema)

    def rank(self, event: tuple) -> tuple:
        at = [event[self.names.index(c)] for c in self.order]
        return tuple((v is not None, v) if v is not None else (False,) for v in at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = list(map(tuple, self.events.get()))
        came = (tuple(r[c] for c in self.names) for r in rows)
        kept = heapq.nlargest(self.n, chain(held, came), key=self.rank)
        if self.idle and (newest := self.newest(kept)) is not None:
            self.handle.registerTimer(newest + 1)
        if sorted(held, key=self.rank, reverse=True) != kept:
            self.events.put(kept)
            yield self.row(key, kept)

    def newest(self, events: list[tuple]) -> int | None:
        """Milliseconds since the epoch of the newest event."""
        at = events[0][self.names.index(self.order[0])] if events else None
        return None if at is None else at // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest = self.newest(list(map(tuple, self.events.get())))
        if newest is not None and newest < timerValues.getCurrentWatermarkInMs():
            self.events.clear()
            yield self.row(key, [])

    def row(self, key, events: list[tuple]) -> Row:
        return Row(*self.keys, "events")(*key, [Row(*self.names)(*e) for e in events])

    def close(self) -> None:
        pass


def newest_of(table: pa.Table, keys: Sequence[str], order: Sequence[str], n: int) -> pa.Table:
    """The ``n`` rows of each key that are largest by ``order``, nulls last."""
    codes = [table.column(k).combine_chunks().dictionary_encode("encode").indices for k in keys]
    sorting = pa.table([*codes, *[table.column(c) for c in order]], names=[str(k) for k in range(len(keys) + len(order))])
    ways = [(str(k), "ascending" if k < len(keys) else "descending") for k in range(len(keys) + len(order))]
    at = pc.sort_indices(sorting, sort_keys=ways, null_placement="at_end").to_numpy()
    first = np.ones(len(at), bool)
    first[1:] = False
    for code in codes:
        sorted_code = code.to_numpy()[at]
        first[1:] |= sorted_code[1:] != sorted_code[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return table.take(pa.array(at[np.arange(len(at)) - begin < n]))


def newest_of_task(keys: Sequence[str], order: Sequence[str], n: int):
    """A map of Arrow batches: each task passes on the newest ``n`` rows of each key, holding few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > HELD_ROWS:
                held = newest_of(pa.Table.from_batches(held), keys, order, n).to_batches()
                rows = sum(b.num_rows for b in held)
                if rows > HELD_ROWS // 2:  # keys so many that holding them gains nothing
                    yield from held
                    held, rows = [], 0
        if rows:
            yield from newest_of(pa.Table.from_batches(held), keys, order, n).to_batches()

    return run


def newest_per_key(events: DataFrame, by: Sequence[str], n: int = 500, ts: str = "ts", id: str = "id", idle: str | None = None) -> DataFrame:
    """``(by, events)`` in update mode: after a micro-batch, the newest ``n`` events of each key that changed, newest first.

    State is ``n`` events per key whatever the stream holds, and each task passes on only the newest
    ``n`` of a key among its own rows. With ``idle``, events that are so much
    older than the stream's newest are not taken in, and a key whose newest event has become as old
    is let go: its last row has an empty list.
    """
    use_keyed_state(events.sparkSession)
    ship(events.sparkSession)
    # times are kept as microseconds: Python's own are compared by zone
    times = [f.name for f in events.schema.fields if isinstance(f.dataType, T.TimestampType)]
    if ts not in times:
        raise OptionError(f"column {ts!r} must be a timestamp")
    # the newest event of all is among these, so the watermark is the same
    rows = events.mapInArrow(newest_of_task(list(by), (ts, id), n), events.schema)
    rows = rows if idle is None else rows.withWatermark(ts, f"{microseconds(idle)} microseconds")
    rows = rows.select(F.col(ts).alias("_seen"), *[F.unix_micros(c).alias(c) if c in times else c for c in events.columns])
    kinds = {c: rows.schema[c].dataType.simpleString() for c in events.columns}
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    held = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    given = ", ".join(f"`{c}`: {k}" for c, k in kinds.items())
    holder = Newest(events.columns, by, held, (ts, id), n, idle is not None)
    out = rows.groupBy(*by).transformWithState(holder, f"{keys}, events array<struct<{given}>>", "Update", "None" if idle is None else "EventTime")
    back = F.transform("events", lambda e: F.struct(*[(F.timestamp_micros(e[c]) if c in times else e[c]).alias(c) for c in events.columns]))
    return out.select(*[(F.timestamp_micros(c) if c in times else F.col(c)).alias(c) for c in by], back.alias("events"))
