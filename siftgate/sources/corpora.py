"""Reading and validating corpora, registries, probes, reports and event envelopes; writing the
same. Readers take explicit schemas: a malformed line is data to report, not a reason to guess."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.functions.text import require_string, strip, valid_json
from siftgate.operators.events import epoch_us
from siftgate.options import BYTE_CAP, OptionError

READERS = ("parquet", "json", "orc", "csv", "text")
CORPUS_FIELDS = ("id", "category", "subject", "body")
REPORT_SCHEMA = (
    "entry_type string, status int, probe string, prompt string, outputs array<string>, "
    "detector string, passed boolean, score double"
)
EVENT_SCHEMA = (
    "timestamp double, layer string, verdict string, source_id string, detail string, "
    "duration_ms double, metadata string"
)
RUN_SCHEMA = (
    "tier string, completed_at string, total long, defended long, vulnerable long, "
    "hijacked long, defense_rate double, duration_s double"
)


class CorpusError(ValueError):
    """A corpus broke its contract; the message names the first few violations."""


def read_corpus(
    spark: SparkSession, path: str, format: str = "parquet", text: str = "text", schema=None
) -> DataFrame:
    """Read a text corpus; the text column must already be a string column."""
    if format not in READERS:
        raise OptionError(f"format must be one of {READERS}")
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if format == "text" and text != "value":
        df = df.withColumnRenamed("value", text)
    return require_string(df, text)


def admission(df: DataFrame, text: str = "text", cap: int = BYTE_CAP) -> DataFrame:
    """Add ``bytes, admitted, refusal``: the cap counts UTF-8 bytes, not characters."""
    size = F.octet_length(text)
    return (
        df.withColumn("bytes", size)
        .withColumn("admitted", size <= cap)
        .withColumn("refusal", F.when(size > cap, "content_too_large"))
    )


def parse_benign(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to ``(id, category, subject, body, text, problem)``; blank and ``#`` lines go."""
    line = strip(F.col(value))
    rows = lines.select(line.alias("_l")).where((F.col("_l") != "") & ~F.startswith("_l", F.lit("#")))
    shape = ", ".join(f"{c} string" for c in CORPUS_FIELDS)
    rows = rows.withColumn("_o", F.from_json("_l", shape))
    missing = F.greatest(*[F.col(f"_o.{c}").isNull() for c in CORPUS_FIELDS])
    return rows.select(
        *[F.col(f"_o.{c}").alias(c) for c in CORPUS_FIELDS],
        F.concat(F.lit("Subject: "), "_o.subject", F.lit("\n\n"), "_o.body").alias("text"),
        F.when(~valid_json(F.col("_l")), "invalid JSON")
        .when(missing, "missing field")
        .alias("problem"),
    )


def benign_violations(parsed: DataFrame) -> DataFrame:
    """``(id, problem)``: bad lines, repeated ids, or an empty corpus. No rows means valid."""
    # one aggregate serves all three questions; its shuffle is reused by the second branch
    seen = parsed.groupBy("id", "problem").agg(F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("problem").isNotNull(), F.col("n")).when(F.col("n") > 1, F.lit(1)).otherwise(F.lit(0))
    rows = seen.select(
        "id",
        F.coalesce("problem", F.lit("duplicate id")).alias("problem"),
        F.explode(F.array_repeat(F.lit(0), times.cast("int"))),
    ).select("id", "problem")
    none = seen.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    none = none.select(F.lit(None).cast("string").alias("id"), F.lit("empty").alias("problem"))
    return rows.unionByName(none)


def load_benign(spark: SparkSession, path: str) -> DataFrame:
    """Load a benign corpus and fail on any violation (naming at most five)."""
    parsed = parse_benign(spark.read.text(path))
    broken = benign_violations(parsed).limit(5).collect()
    if broken:
        raise CorpusError("; ".join(f"{r['id']}: {r['problem']}" for r in broken))
    return parsed.drop("problem")


def category_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def probe_payloads(exported: DataFrame) -> DataFrame:
    """``(family, class, index, payload, active)`` from exported probes.

    ``prompts`` is ``ARRAY<STRUCT<text, turns ARRAY<STRUCT<text>>>>``: a plain prompt has
    ``text``, a conversation counts by its last turn; prompts without text drop.
    """
    rows = exported.select(
        F.split_part("name", F.lit("."), F.lit(-2)).alias("family"),
        F.substring_index("name", ".", -1).alias("class"),
        "active",
        F.posexplode("prompts").alias("index", "p"),
    )
    last = F.try_element_at("p.turns", F.lit(-1))["text"]
    return rows.select(
        "family", "class", "index", F.coalesce("p.text", last).alias("payload"), "active"
    ).where(F.col("payload").isNotNull())


def turn_payloads(turns: DataFrame, name: str = "name", prompt: str = "prompt") -> DataFrame:
    """Payloads from one row per turn (``name, active, prompt, turn, text``): the last turn of each prompt.

    A conversation of any length reduces to its last turn in every task before it is shuffled.
    """
    last = turns.groupBy(name, prompt).agg(
        F.max(F.struct("turn", "text")).getField("text").alias("payload"), F.max("active").alias("active")
    )
    return last.where(F.col("payload").isNotNull()).select(
        F.split_part(name, F.lit("."), F.lit(-2)).alias("family"),
        F.substring_index(name, ".", -1).alias("class"),
        F.col(prompt).alias("index"),
        "payload",
        "active",
    )


def read_scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Evaluated attempts of scanner reports; other entries and bad lines are skipped."""
    rows = spark.read.schema(REPORT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return attempts(rows)


def attempts(entries: DataFrame) -> DataFrame:
    blank = F.lit("")
    rows = entries.where((F.col("entry_type") == "attempt") & (F.col("status") == 2))
    return rows.select(
        F.coalesce("probe", F.lit("unknown")).alias("probe"),
        F.coalesce("prompt", blank).alias("prompt"),
        F.coalesce(F.get("outputs", F.lit(0)), blank).alias("output"),
        F.coalesce("detector", F.lit("unknown")).alias("detector"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def save_run_reports(reports: DataFrame, path: str) -> None:
    """Append run reports, one folder per tier."""
    reports.write.mode("append").partitionBy("tier").json(path)


def read_run_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Saved run reports with their file name, newest first (completion, then name)."""
    rows = (
        spark.read.schema(RUN_SCHEMA)
        .option("multiLine", multi_line)
        .option("mode", "DROPMALFORMED")
        .json(path)
        .withColumn("filename", F.col("_metadata.file_name"))
    )
    return rows.withColumn("completed_at", F.coalesce("completed_at", F.lit(""))).orderBy(
        F.col("completed_at").desc(), F.col("filename").desc()
    )


def parse_registry(lines: DataFrame, value: str = "value") -> DataFrame:
    """A JSON object ``name -> token`` per line to ``(ord, source_name, token)``."""
    tokens = F.from_json(value, "map<string,string>")
    return lines.select(F.posexplode(F.map_entries(tokens)).alias("ord", "e")).select(
        "ord", F.col("e.key").alias("source_name"), F.col("e.value").alias("token")
    )


def load_registry(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Registry objects, one per line, or one (possibly indented) object per file."""
    return parse_registry(spark.read.text(path, wholetext=whole_file))


def save_registry(registry: DataFrame, path: str) -> None:
    """One JSON object per line."""
    registry.select(
        F.to_json(F.create_map("source_name", "token")).alias("value")
    ).write.mode("overwrite").text(path)


def append_events(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a log in UTC date folders, so time filters skip folders as well as row groups."""
    day = F.date_from_unix_date(F.floor(epoch_us(events, ts) / 86_400_000_000).cast("int"))
    events.withColumn("date", day).write.mode("append").partitionBy("date").parquet(path)


def parse_envelopes(lines: DataFrame, value: str = "value") -> DataFrame:
    """``{"events": [...]}`` payloads to rows (works on a stream too); empty ones yield none."""
    body = F.from_json(value, f"events array<struct<{_colons(EVENT_SCHEMA)}>>")
    return lines.select(F.inline(body["events"]))


def _colons(ddl: str) -> str:
    return ", ".join(f"{a}:{b}" for a, b in (part.split() for part in ddl.split(", ")))


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON document per event, for a text or console sink."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def blocked_only(events: DataFrame) -> DataFrame:
    return events.where(F.col("verdict") == "blocked")


def post_events(
    events: DataFrame, post: Callable[[dict], None], batch_size: int = 100, partitions: int | None = None
) -> DataFrame:
    """Send ``{"chunk": id, "events": [...]}`` through ``post``; ``(chunk, events, error)`` of failed calls.

    The posts happen when the result is evaluated, in the input's own partitions unless another
    number is asked for. Delivery is fire-and-forget: a failed chunk becomes a row, never an error.
    A chunk's id is the digest of its events, so a receiver can drop what a retried task repeats.
    """
    rows = events.select(F.to_json(F.struct("*")).alias("j"))
    if partitions is not None:
        rows = rows.repartition(partitions)

    def send(batches: Iterable) -> Iterable:
        import hashlib
        import json

        import pandas as pd

        buffer: list[str] = []

        def flush() -> list[tuple[str, int, str]]:
            chunk = hashlib.sha256("\n".join(buffer).encode()).hexdigest()
            failed = []
            try:
                post({"chunk": chunk, "events": [json.loads(line) for line in buffer]})
            except Exception as err:  # noqa: BLE001
                failed.append((chunk, len(buffer), f"{type(err).__name__}: {err}"))
            buffer.clear()
            return failed

        for batch in batches:
            failed = []
            for line in batch["j"]:
                buffer.append(line)
                if len(buffer) >= batch_size:
                    failed += flush()
            yield pd.DataFrame(failed, columns=["chunk", "events", "error"])
        if buffer:
            yield pd.DataFrame(flush(), columns=["chunk", "events", "error"])

    return rows.mapInPandas(send, "chunk string, events long, error string")


def pending_configs(configs: DataFrame, store: str) -> DataFrame:
    """Configurations without a stored result: what a resumed sweep still has to run."""
    spark = configs.sparkSession
    try:
        done = spark.read.parquet(store).select("config_slug").distinct()
    except Exception as err:  # noqa: BLE001 - nothing stored yet
        if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
            raise
        return configs
    return configs.join(done, "config_slug", "left_anti")


def store_results(results: DataFrame, store: str) -> None:
    """Write results so that only the configurations present are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "config_slug"
    ).parquet(store)


def run_pending(configs: DataFrame, store: str, run: Callable[[str], DataFrame]) -> list[str]:
    """Run what a sweep still lacks, one configuration at a time; each is stored before the next begins.

    A crash loses the configuration it interrupts and no other. Returns the slugs that were run.
    """
    todo = [r[0] for r in pending_configs(configs, store).select("config_slug").orderBy("config_slug").collect()]
    for slug in todo:
        store_results(run(slug), store)
    return todo


def report_lines(results: DataFrame, schema: str, generated_at: str) -> DataFrame:
    """``(ord, value)``: a header line (``ord`` 0) and one JSON line per configuration, for any number of them."""
    fields = [c for c in results.columns if c != "ord"]
    head = results.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("ord"),
        F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(generated_at).alias("generated_at"))).alias("value"),
    )
    rows = results.select(F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(*fields)).alias("value"))
    return head.unionByName(rows)


def report_document(results: DataFrame, schema: str, generated_at: str) -> DataFrame:
    """One JSON document over the configuration rows, in input order ``ord``.

    A document is one string and is put together in one task; :func:`report_lines` is the form for
    sweeps with more configurations than one string should hold.
    """
    fields = [c for c in results.columns if c != "ord"]
    rows = results.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("c")))).alias("r")
    )
    return rows.select(
        F.to_json(
            F.struct(
                F.lit(schema).alias("schema"),
                F.lit(generated_at).alias("generated_at"),
                F.transform("r", lambda x: x["c"]).alias("configurations"),
            )
        ).alias("document")
    )
