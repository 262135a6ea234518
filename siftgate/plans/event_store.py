"""Registered queries: the same answers from a stored log with counts, trigrams and day folders."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from siftgate.operators import events as ev
from siftgate.plans import logs
from siftgate.plans.inputs import AS_OF, LOG, Plan, log_events
from siftgate.sources.event_store import EventStore
from siftgate.sources.storage import scratch

PLAN = Plan()
LATE = AS_OF + timedelta(seconds=7, microseconds=250_001)


def stored(spark, sf, searchable: bool = False) -> EventStore:
    """The log in three appends, each with events of all days; two are counted, the third is the tail."""
    store = EventStore(spark, scratch(spark, "events"), searchable=searchable)
    log = log_events(spark, sf)
    log = log.withColumn("ts", F.timestamp_micros(ev.epoch_us(log, "ts")))
    for part in range(3):
        store.append(log.where(F.pmod("id", F.lit(3)) == part))
        if part < 2:
            store.roll_up()
    return store


def _as(name: str, raw: str, answer) -> None:
    """Register ``answer(store)`` under the SQL of the query that reads raw rows."""
    PLAN.add(name, logs.PLAN.sql[raw])(lambda spark, sf: answer(stored(spark, sf)))


_as("V2_metrics_counted", "V2_metrics", lambda s: s.metrics(AS_OF))
_as("V3_timeseries_counted", "V3_timeseries", lambda s: s.timeseries(AS_OF))
_as("V3_timeseries_layer_counted", "V3_timeseries_layer", lambda s: s.timeseries(AS_OF, hours=720, buckets=60, layer="detection:model"))
_as("V8_verdict_facets_counted", "V8_verdict_facets", lambda s: s.verdict_facets())
_as("V9_timeline_counted", "V9_timeline", lambda s: s.timeline(AS_OF))
_as("V10_layer_sparks_counted", "V10_layer_sparks", lambda s: s.layer_sparks(AS_OF))
_as("V11_incident_counted", "V11_incident", lambda s: s.incident(AS_OF))
_as("V13_layer_counts_counted", "V13_layer_counts", lambda s: s.layer_counts(AS_OF))
_as("V14_stat_tiles_counted", "V14_stat_tiles", lambda s: s.stat_tiles(AS_OF))
_as("V12_latest_stored", "V12_latest", lambda s: logs._event(s.latest()))
_as(
    "V1_query_stored",
    "V1_query_events",
    lambda s: logs._event(s.query(layer="canary", verdict="blocked", start=AS_OF - timedelta(days=20), until=AS_OF, offset=5)),
)


@PLAN.add("V7_search_stored", logs.PLAN.sql["V7_search"])
def search(spark, sf):
    return stored(spark, sf, searchable=True).search("blocked", "detection", " USER:1 ").select("id", "layer", "source")


@PLAN.add(
    "V4_prune_counted",
    f"WITH {LOG} SELECT verdict, count(*) AS n, (SELECT count(*) FROM log WHERE ts < {logs.NOW} + INTERVAL 7250001 "
    f"MICROSECOND - INTERVAL 7 DAY) AS deleted FROM log WHERE ts >= {logs.NOW} + INTERVAL 7250001 MICROSECOND - INTERVAL 7 DAY GROUP BY verdict",
)
def prune(spark, sf):
    """Counts follow when old events go; the cutoff lies inside a minute."""
    store = stored(spark, sf)
    deleted = store.prune(LATE, days=7)
    return store.verdict_facets().withColumn("deleted", F.lit(deleted).cast("long"))
