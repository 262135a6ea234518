"""Output guard over tables (map-only apart from the counts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions import guarding
from siftgate.functions.text import require_string
from siftgate.operators.layout import settle
from siftgate.operators.leaks import leak_check
from siftgate.options import GuardOptions


def guard(
    df: DataFrame,
    text: str = "text",
    registry: DataFrame | None = None,
    options: GuardOptions = GuardOptions(),
    checks: Sequence[Column] = (),
) -> DataFrame:
    """Add ``safe, reason, check``.

    Patterns first, then the caller's ``checks`` (string columns: a reason, or null when fine),
    then leaked tokens, which are only looked for where nothing else was found.
    """
    require_string(df, text)
    found = guarding.injection_reason(F.col(text), options)
    if checks:
        found = F.coalesce(found, *checks)
    out = settle(df.withColumn("reason", found), "reason")
    leak = F.lit(None).cast("string")
    if registry is not None:
        out = leak_check(
            out.withColumn("_unflagged", F.when(F.col("reason").isNull(), F.col(text))),
            registry,
            text="_unflagged",
        )
        leak = F.when(
            F.col("leaked"),
            F.concat(F.lit("Canary token leaked from: "), F.array_join("sources", ", ")),
        )
    check = F.when(F.col("reason").isNotNull(), "injection").when(leak.isNotNull(), "canary")
    out = out.withColumn("check", check).withColumn("reason", F.coalesce("reason", leak))
    out = out.withColumn("safe", F.when(F.col(text).isNotNull(), F.col("check").isNull()))
    return out.drop("_unflagged", "leaked", "found_tokens", "sources", "kinds")


def guard_counts(guarded: DataFrame, *by: str) -> DataFrame:
    """Verdict counts per reason and any further columns."""
    return guarded.groupBy("reason", *by).agg(F.count(F.lit(1)).alias("n"))


def guard_events(guarded: DataFrame, options: GuardOptions = GuardOptions(), checks: int = 0, id: str = "doc_id") -> DataFrame:
    """One passed / blocked event of the guard per row: what blocked it, or how many patterns and checks it passed.

    Rows that only a leaked token made unsafe passed the guard; their leak is the canary's event.
    """
    pattern = F.regexp_extract("reason", r"(?s)^Suspicious pattern in text: (.*)$", 1)
    size = F.regexp_extract("reason", r"^Text exceeds maximum length \((.*)\)$", 1)
    flagged = F.col("check") == "injection"
    passed = F.lit(f"All {len(options.patterns)} patterns + {checks} custom checks passed")
    detail = (
        F.when(~F.coalesce(flagged, F.lit(False)), passed)
        .when(size != "", F.concat(F.lit("Exceeds max length: "), size))
        .when(pattern != "", F.concat(F.lit("Pattern match: "), pattern))
        .otherwise(F.col("reason"))
    )
    return guarded.where(F.col("safe").isNotNull()).select(
        F.col(id),
        F.lit("analysis_guard").alias("layer"),
        F.when(flagged, "blocked").otherwise("passed").alias("verdict"),
        detail.alias("detail"),
        F.when(flagged & (pattern != ""), F.to_json(F.struct(pattern.alias("pattern")))).alias("metadata"),
    )
