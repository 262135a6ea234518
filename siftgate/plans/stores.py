"""Registered queries: sources and sinks. What a sink wrote is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgate.operators import evaluating as ev
from siftgate.operators.events import epoch_us
from siftgate.plans.evaluation import OUTCOMES, RATE, outcomes
from siftgate.plans.inputs import LOG, Plan, log_events, registry, table
from siftgate.plans.logs import streamed_log
from siftgate.sources import corpora
from siftgate.sources.storage import scratch
from siftgate.streaming import jobs

PLAN = Plan()


@PLAN.add("S1_read_corpus", "SELECT doc_id, lang, length(text) AS n FROM documents")
def read_corpus(spark, sf):
    docs = corpora.read_corpus(spark, f"{sf}/documents.parquet")
    return docs.select("doc_id", "lang", F.length("text").alias("n"))


@PLAN.add(
    "S2_admission",
    "SELECT page_id, strlen(html) AS bytes, strlen(html) <= 6000 AS admitted, CASE WHEN strlen(html) > "
    "6000 THEN 'content_too_large' END AS refusal FROM pages",
)
def admission(spark, sf):
    out = corpora.admission(table(spark, sf, "pages"), "html", cap=6000)
    return out.select("page_id", "bytes", "admitted", "refusal")


def _benign_lines(spark, sf):
    """Benign labelled documents as JSON lines, with every kind of blemish mixed in."""
    d = F.col("doc_id")
    good = F.to_json(
        F.struct(
            F.when(F.pmod(d, F.lit(50)) == 4, "twice")
            .otherwise(F.concat(F.lit("d"), d.cast("string")))
            .alias("id"),
            F.col("source").alias("category"),
            F.concat_ws(" ", "source", "lang").alias("subject"),
            F.when(F.pmod(d, F.lit(50)) != 3, F.col("text")).alias("body"),
        )
    )
    line = (
        F.when(F.pmod(d, F.lit(50)) == 0, "  ")
        .when(F.pmod(d, F.lit(50)) == 1, "# a note")
        .when(F.pmod(d, F.lit(50)) == 2, '{"id": "x')
        .otherwise(good)
    )
    labels = table(spark, sf, "labels").where(F.col("toxic") == 0).select("doc_id")
    return table(spark, sf, "documents").join(labels, "doc_id").select(line.alias("value"))


BENIGN = (
    "WITH b AS (SELECT d.doc_id, d.doc_id % 50 AS k, source, lang, text FROM documents d JOIN labels l "
    "USING (doc_id) WHERE l.toxic = 0) "
)


@PLAN.add(
    "S3_corpus_violations",
    BENIGN + "SELECT 'invalid JSON' AS problem, count(*) AS n FROM b WHERE k = 2 HAVING count(*) > 0 "
    "UNION ALL SELECT 'missing field', count(*) FROM b WHERE k = 3 HAVING count(*) > 0 "
    "UNION ALL SELECT 'duplicate id', 1 FROM b WHERE k = 4 HAVING count(*) > 1",
)
def corpus_violations(spark, sf):
    """Written as text, read back as text: the loader's own path."""
    path = scratch(spark, "benign")
    _benign_lines(spark, sf).write.text(path)
    parsed = corpora.parse_benign(spark.read.text(path))
    return corpora.benign_violations(parsed).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@PLAN.add(
    "S3_load_corpus",
    BENIGN + "SELECT 'd' || doc_id AS id, source AS category, md5('Subject: ' || source || ' ' || lang || "
    "chr(10) || chr(10) || text) AS digest FROM b WHERE k > 4",
)
def load_corpus(spark, sf):
    path = scratch(spark, "benign")
    lines = _benign_lines(spark, sf).where(
        (F.get_json_object("value", "$.body").isNotNull() & ~F.contains("value", F.lit('"id":"twice"')))
        | (F.trim("value") == "")
        | F.startswith("value", F.lit("#"))
    )
    lines.write.text(path)
    return corpora.load_benign(spark, path).select("id", "category", F.md5("text").alias("digest"))


@PLAN.add("S4_category_counts", BENIGN + "SELECT source AS category, count(*) AS n FROM b GROUP BY source")
def category_counts(spark, sf):
    labels = table(spark, sf, "labels").where(F.col("toxic") == 0).select("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"))
    return corpora.category_counts(docs.join(labels, "doc_id", "left_semi"))


TURNS = (
    "WITH t AS (SELECT *, 'Conv' || conv_id AS class, conv_id % 2 = 0 AS active FROM conversations) "
)


@PLAN.add(
    "S6_probe_payloads",
    TURNS + "SELECT 'talk' AS family, class AS \"class\", 0 AS \"index\", md5(last(text ORDER BY turn)) AS digest, "
    "any_value(active) AS active FROM t GROUP BY class UNION ALL SELECT 'talk', class, 1 + turn, md5(text), "
    "active FROM t",
)
def probe_payloads(spark, sf):
    """Prompt 0 is the whole conversation, prompt 1 + t its turn t asked alone."""
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("probes.talk.Conv"), F.col("conv_id").cast("string")).alias("name"),
        (F.pmod("conv_id", F.lit(2)) == 0).alias("active"),
        F.explode(F.array(F.lit(0).cast("long"), F.col("turn").cast("long") + 1)).alias("prompt"),
        F.col("turn").cast("long").alias("turn"),
        "text",
    )
    out = corpora.turn_payloads(turns)
    return out.select("family", "class", "index", F.md5("payload").alias("digest"), "active")


@PLAN.add(
    "S7_scan_report",
    "SELECT CASE WHEN doc_id % 4 = 1 THEN 'unknown' ELSE 'p.' || doc_id END AS probe, md5(text) AS "
    "prompt, CASE WHEN doc_id % 5 = 1 THEN '' ELSE text END AS output, 'unknown' AS detector, "
    "doc_id % 3 = 0 AS passed, CAST(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM documents "
    "WHERE doc_id % 10 NOT IN (0, 1, 2)",
)
def scan_report(spark, sf):
    d = F.col("doc_id")
    kind = F.pmod(d, F.lit(10))
    entry = F.struct(
        F.when(kind == 1, "init").otherwise("attempt").alias("entry_type"),
        F.when(kind == 2, 0).otherwise(2).alias("status"),
        F.when(F.pmod(d, F.lit(4)) != 1, F.concat(F.lit("p."), d.cast("string"))).alias("probe"),
        F.col("text").alias("prompt"),
        F.when(F.pmod(d, F.lit(5)) == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.col("text"), F.lit("second")))
        .alias("outputs"),
        F.when(F.pmod(d, F.lit(3)) == 0, True).alias("passed"),
        F.when(F.pmod(d, F.lit(3)) == 0, 1.0).alias("score"),
    )
    path = scratch(spark, "scan")
    line = F.when(kind == 0, '{"entry_type": "attempt", bad').otherwise(F.to_json(entry))
    table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    out = corpora.read_scan_report(spark, path)
    return out.withColumn("prompt", F.md5("prompt"))


@PLAN.add(
    "S8_run_reports",
    "SELECT CASE length(source) % 2 WHEN 0 THEN 'standard' ELSE 'full' END AS tier, "
    "'2024-01-' || lpad((1 + count(*) % 28)::VARCHAR, 2, '0') || 'T00:00:00Z' AS completed_at, "
    "count(*) AS total, count_if(lang = 'en') AS defended, count_if(lang = 'en')::DOUBLE / count(*) AS "
    "defense_rate FROM documents GROUP BY source",
)
def run_reports(spark, sf):
    docs = table(spark, sf, "documents")
    runs = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("defended")
    )
    runs = runs.select(
        F.when(F.pmod(F.length("source"), F.lit(2)) == 0, "standard").otherwise("full").alias("tier"),
        F.concat(
            F.lit("2024-01-"),
            F.lpad((F.lit(1) + F.pmod("total", F.lit(28))).cast("string"), 2, "0"),
            F.lit("T00:00:00Z"),
        ).alias("completed_at"),
        "total",
        "defended",
        (F.col("total") - F.col("defended")).alias("vulnerable"),
        F.lit(0).cast("long").alias("hijacked"),
        (F.col("defended") / F.col("total")).alias("defense_rate"),
        F.lit(1.5).alias("duration_s"),
    )
    path = scratch(spark, "runs")
    corpora.save_run_reports(runs, path)
    out = corpora.read_run_reports(spark, path)
    return out.select("tier", "completed_at", "total", "defended", "defense_rate")


@PLAN.add("S9_registry_file", "SELECT item_id::VARCHAR AS source_name, text AS token FROM benchmark")
def registry_file(spark, sf):
    path = scratch(spark, "registry")
    corpora.save_registry(registry(spark, sf), path)
    return corpora.load_registry(spark, path).select("source_name", "token")


@PLAN.add(
    "S10_append_events",
    f"WITH {LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, verdict, count(*) AS n FROM log GROUP BY ALL",
)
def append_events(spark, sf):
    log = log_events(spark, sf)
    log = log.withColumn("ts", F.timestamp_micros(epoch_us(log, "ts")))
    path = scratch(spark, "log")
    for half in (0, 1):
        corpora.append_events(log.where(F.pmod("id", F.lit(2)) == half), path)
    out = spark.read.parquet(path)
    return out.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "verdict").agg(
        F.count(F.lit(1)).alias("n")
    )


@PLAN.add(
    "S11_event_envelopes",
    f"WITH {LOG} SELECT CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t, layer, verdict, source_id, "
    "duration_ms FROM log",
)
def event_envelopes(spark, sf):
    log = log_events(spark, sf)
    event = F.struct(
        F.floor(epoch_us(log, "ts") / 1_000_000).cast("double").alias("timestamp"),
        "layer", "verdict", "source_id", "detail", "duration_ms", "metadata",
    )
    packed = log.groupBy(F.floor(F.col("id") / 50).alias("g")).agg(
        F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("value")
    )
    empty = log.where(F.pmod("id", F.lit(500)) == 0).select(
        F.when(F.pmod("id", F.lit(1000)) == 0, '{"events": []}').otherwise("{}").alias("value")
    )
    rows = corpora.parse_envelopes(packed.select("value").unionByName(empty))
    return rows.select(
        F.col("timestamp").cast("long").alias("t"), "layer", "verdict", "source_id", "duration_ms"
    )


@PLAN.add(
    "S12_event_lines",
    f"WITH {LOG} SELECT id, verdict, source_id, detail FROM log",
)
def event_lines(spark, sf):
    path = scratch(spark, "lines")
    corpora.event_lines(log_events(spark, sf)).write.text(path)
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.id").cast("long").alias("id"),
        *[
            F.get_json_object("value", f"$.{c}").alias(c)
            for c in ("verdict", "source_id", "detail")
        ],
    )


def flaky_post(body: dict) -> None:
    """A receiver that refuses every seventh event."""
    if any(e["id"] % 7 == 0 for e in body["events"]):
        raise ConnectionError("refused")


@PLAN.add(
    "S13_webhook_failures",
    f"WITH {LOG} SELECT count(*) AS failed FROM log WHERE verdict = 'blocked' AND id % 7 = 0",
)
def webhook_failures(spark, sf):
    failed = corpora.post_events(
        corpora.blocked_only(log_events(spark, sf).drop("ts")), flaky_post, batch_size=1
    )
    return failed.agg(F.count(F.lit(1)).alias("failed"))


@PLAN.add(
    "S14_fan_out",
    f"WITH {LOG} SELECT 'all' AS sink, count(*) AS n FROM log UNION ALL SELECT 'blocked', count(*) "
    "FROM log WHERE verdict = 'blocked'",
)
def fan_out(spark, sf):
    path, mark = scratch(spark, "fan"), scratch(spark, "fan-checkpoint")

    def every(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/sink=all/batch={batch_id}")

    def blocked(batch, batch_id):
        corpora.blocked_only(batch).write.mode("overwrite").parquet(
            f"{path}/sink=blocked/batch={batch_id}"
        )

    jobs.fan_out(streamed_log(spark, sf), [every, blocked], mark).awaitTermination()
    return spark.read.parquet(path).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@PLAN.add(
    "U6_user_sink",
    f"WITH {LOG} SELECT layer, count(*) AS n FROM log WHERE verdict = 'modified' GROUP BY layer",
)
def user_sink(spark, sf):
    """A sink of the user's own: per batch it stores how many events of each layer were modified."""
    path, mark = scratch(spark, "own-sink"), scratch(spark, "own-sink-checkpoint")

    def modified(batch, batch_id):
        counts = batch.where(F.col("verdict") == "modified").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    jobs.fan_out(streamed_log(spark, sf), [modified], mark).awaitTermination()
    return spark.read.parquet(path).groupBy("layer").agg(F.sum("n").alias("n"))


@PLAN.add("S15_blocked_feed", f"WITH {LOG} SELECT id, layer, source_id FROM log WHERE verdict = 'blocked'")
def blocked_feed(spark, sf):
    return corpora.blocked_only(log_events(spark, sf)).select("id", "layer", "source_id")


@PLAN.add(
    "S16_resumed_sweep",
    OUTCOMES + "SELECT config_slug, CASE WHEN config_slug IN ('all', 'deberta-only') THEN 1 ELSE 2 END "
    "AS run, count(*) AS total, count_if(outcome = 'blocked') AS blocked FROM outcomes GROUP BY config_slug",
)
def resumed_sweep(spark, sf):
    """A first run stores two configurations; the resumed run computes only the other two."""
    path = scratch(spark, "sweep")
    found = outcomes(spark, sf)
    configs = spark.createDataFrame([(c[0],) for c in ev.CONFIG_PRESETS], "config_slug string")

    def run(n):
        return lambda slug: ev.false_positive_rates(found.where(F.col("config_slug") == slug)).withColumn("run", F.lit(n))

    corpora.run_pending(configs.where(F.col("config_slug").isin("all", "deberta-only")), path, run(1))
    corpora.run_pending(configs, path, run(2))
    return spark.read.parquet(path).select("config_slug", "run", "total", "blocked")


@PLAN.add(
    "S17_report_document",
    OUTCOMES + f", f AS (SELECT config_slug, count(*) AS total, {RATE} AS rate FROM outcomes GROUP BY "
    "config_slug) SELECT ci AS n, config_slug, total FROM f JOIN cfg USING (config_slug)",
)
def report_document(spark, sf):
    order = F.array(*[F.lit(c[0]) for c in ev.CONFIG_PRESETS])
    rows = ev.false_positive_rates(outcomes(spark, sf)).withColumn(
        "ord", F.array_position(order, F.col("config_slug"))
    )
    path = scratch(spark, "report")
    lines = corpora.report_lines(rows, "siftgate_falsepos/v1", "2024-01-30T12:00:00Z")
    lines.select("value").write.text(path)
    read = spark.read.text(path).select(F.from_json("value", "config_slug string, total long").alias("c"))
    at = (F.array_position(order, F.col("c.config_slug")) - 1).alias("n")
    return read.where(F.col("c.config_slug").isNotNull()).select(at, "c.config_slug", "c.total")
