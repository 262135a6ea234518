"""The full screening job: admit, sanitize, expand, detect, judge, wrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions.detecting import DEFAULT_CHAIN, Detector
from siftgate.functions.text import let, require_string
from siftgate.functions.wrapping import wrapped
from siftgate.functions import decoding as D
from siftgate.functions import detecting as X
from siftgate.operators import detecting as chain
from siftgate.operators.judging import LAYER
from siftgate.operators.layout import settle
from siftgate.operators.sanitizing import with_cleaned
from siftgate.options import OptionError, ScreenOptions

CAP_REASON = "Decoder blocked: base64 candidate cap exceeded"
CAP_DETAIL = "Base64 candidate cap exceeded during decode-rescan"
TRACE_TYPE = "array<struct<step:int,layer:string,verdict:string,detail:string>>"


def _entry(layer, verdict, detail) -> Column:
    return F.struct(
        F.lit(0).alias("step"),
        (F.lit(layer) if isinstance(layer, str) else layer).alias("layer"),
        (F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def screen(
    docs: DataFrame,
    detectors: Sequence[Detector] = DEFAULT_CHAIN,
    options: ScreenOptions = ScreenOptions(),
    judge: DataFrame | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str | Column = "external",
    label: Column | None = None,
    tokenizer: X.TokenizerWindows | None = None,
) -> DataFrame:
    """Screen a table of untrusted texts; one output row per input row.

    Without ``judge`` the job is a pure map: nothing is shuffled, so it runs unchanged on a
    stream. ``judge`` is a per-document decision table (``judging.judge_decisions``) and costs one
    join on ``id``.

    Rows over the byte cap keep their row with ``rejected='content_too_large'`` and no result.
    Blocked rows have an empty ``result``; other rows wrap the *cleaned* text, never a variant.
    """
    require_string(docs, text)
    armed = bool(detectors) or judge is not None
    if not armed and not options.allow_no_detectors:
        raise OptionError("no detectors: set allow_no_detectors to run sanitize-only")
    o = options
    src = F.lit(source) if isinstance(source, str) else source
    df = docs.select(
        F.col(id),
        src.alias("source"),
        *([label.alias("_label")] if label is not None else []),
        F.col(text).alias("_text"),
    )
    fits = F.octet_length("_text") <= o.byte_cap
    df = df.withColumn("_in", F.when(fits, F.col("_text")))
    if o.sanitize is not None:
        df = with_cleaned(df, "_in", "_clean", o.sanitize)
    else:
        df = df.withColumn("_clean", F.col("_in"))
    df = df.withColumn("_variants", D.variants(F.col("_clean"), o.decode))
    df = df.withColumn("_spent", D.cap_exhausted(F.col("_variants")))
    df = settle(df, "_clean", "_variants", "_spent")
    df = df.withColumn("_rescan", F.when(~F.col("_spent"), F.col("_variants")))
    df = chain.run_chain(df, "_rescan", detectors, o.windows, tokenizer)
    judged = F.lit(False)
    if judge is not None:
        decision = judge.select(
            F.col(id),
            F.struct(
                "blocked", "blocked_at_variant", "block_reason", "safe_label", "safe_confidence"
            ).alias("_judge"),
        )
        df = df.join(decision, id, "left")
        judged = (
            F.coalesce("_judge.blocked", F.lit(False)) & ~F.col("_spent") & F.col("block").isNull()
        )
    return _response(df, id, o, judged, judge is not None, armed, label is not None)


def _response(df, id, o, judged, has_judge, armed, has_label) -> DataFrame:
    admitted = F.col("_in").isNotNull()
    model = F.regexp_replace("block.detector_name", "^detection:", "")
    detected = F.col("block").isNotNull()
    df = df.withColumn("blocked", F.when(admitted, F.col("_spent") | detected | judged))
    why = F.concat(
        F.lit("Detector "),
        model,
        F.lit(": "),
        X.block_reason(
            model,
            F.col("block.label"),
            F.col("block.max_score"),
            F.col("block.window_index"),
            F.col("block.n_windows"),
        ),
    )
    reason = F.when(F.col("_spent"), CAP_REASON).when(detected, why)
    where = F.when(F.col("_spent"), "decoders").when(detected, F.col("block.detector_name"))
    variant = F.when(detected, F.col("block.variant_label"))
    if has_judge:
        told = F.regexp_replace("_judge.block_reason", "^LLM judge:?", "")
        told = F.concat(
            F.lit("Detector llm_judge"),
            F.when(F.col("_judge.block_reason").startswith("LLM judge:"), ":").otherwise(""),
            F.regexp_replace(told, r" \(fail-closed\)$", ""),
        )
        reason = reason.when(judged, told)
        where = where.when(judged, LAYER)
        variant = F.coalesce(variant, F.when(judged, F.col("_judge.blocked_at_variant")))
    tag = F.col("_clean")
    if o.boundary is not None:
        tag = wrapped(
            F.col("_clean"), F.col("source"), F.col("_label") if has_label else None, o.boundary
        )
    df = df.withColumn("result", F.when(F.col("blocked"), "").otherwise(tag))
    last = F.try_element_at("ledger", F.lit(-1))
    detector = F.when(
        ~F.col("blocked") & last.isNotNull(),
        F.struct(
            F.coalesce(last["top_label"], F.lit("SAFE")).alias("label"),
            F.bround(last["max_score"], 4).alias("score"),
        ),
    )
    if has_judge:
        safe = F.struct(
            F.col("_judge.safe_label").alias("label"), F.col("_judge.safe_confidence").alias("score")
        )
        detector = F.when(
            ~F.col("blocked") & F.col("_judge.safe_label").isNotNull(), safe
        ).otherwise(detector)
    modified = F.col("_clean") != F.col("_in")
    df = df.withColumn("modified", modified)
    return df.select(
        id,
        "result",
        "blocked",
        reason.alias("block_reason"),
        where.alias("blocked_at"),
        variant.alias("blocked_at_variant"),
        "source",
        F.lit(o.boundary.format if o.boundary else None).cast("string").alias("format"),
        F.length("_text").alias("content_length"),
        F.length("result").alias("result_length"),
        "modified",
        detector.alias("detector"),
        F.lit(None if armed else "degraded-explicit").cast("string").alias("mode"),
        F.transform(
            "_variants",
            lambda v: F.struct(v["label"], v["depth"], v["skipped"], v["skip_reason"]),
        ).alias("decoded_variants"),
        F.when(admitted, _trace(o, judged, has_judge)).alias("trace"),
        F.when(F.col("_text").isNotNull() & ~admitted, "content_too_large").alias("rejected"),
    )


def _trace(o: ScreenOptions, judged: Column, has_judge: bool) -> Column:
    """Steps in running order. Ledger entries collapse to one per detector: its block, else its
    last pass; ledgers are detector-major, so that is the last entry of each detector."""
    steps = []
    if o.sanitize is not None:
        sizes = F.concat(
            F.length("_text").cast("string"),
            F.lit(" -> "),
            F.length("_clean").cast("string"),
            F.lit(" chars"),
        )
        steps.append(
            F.array(
                _entry(
                    "sanitizer",
                    F.when(F.col("modified"), "modified").otherwise("passed"),
                    F.concat(F.when(F.col("modified"), "Modified: ").otherwise("Clean: "), sizes),
                )
            )
        )
    none = F.array().cast(TRACE_TYPE)
    steps.append(
        F.when(F.col("_spent"), F.array(_entry("decoders", "blocked", CAP_DETAIL))).otherwise(none)
    )

    def per_detector(rows: Column) -> Column:
        final = F.filter(
            rows,
            lambda r, i: (i + 1 == F.size(rows))
            | (F.get(rows, i + 1)["detector_index"] != r["detector_index"]),
        )

        def line(r: Column) -> Column:
            model = F.regexp_replace(r["detector_name"], "^detection:", "")
            return _entry(
                r["detector_name"],
                F.when(r["passed"], "passed").otherwise("blocked"),
                F.when(r["passed"], chain.passed_detail(model, r)).otherwise(
                    chain.blocked_detail(model, r)
                ),
            )

        return F.transform(final, line)

    steps.append(F.coalesce(let(F.col("ledger"), per_detector), none))
    if has_judge:
        detail = F.coalesce(
            F.when(
                judged,
                F.concat(
                    F.col("_judge.block_reason"),
                    chain.variant_suffix(F.col("_judge.blocked_at_variant")),
                ),
            ),
            F.lit("LLM judge passed"),
        )
        seen = F.col("_judge").isNotNull() & ~F.col("_spent") & F.col("block").isNull()
        verdict = F.when(judged, "blocked").otherwise("passed")
        steps.append(F.when(seen, F.array(_entry(LAYER, verdict, detail))).otherwise(none))
    if o.boundary is not None:
        entry = _entry(
            "trust_boundary", "passed", F.concat(F.lit("Wrapped with source="), F.col("source"))
        )
        steps.append(F.when(F.col("blocked"), none).otherwise(F.array(entry)))
    return F.transform(
        F.concat(*[s.cast(TRACE_TYPE) for s in steps]),
        lambda e, i: F.struct((i + 1).alias("step"), e["layer"], e["verdict"], e["detail"]),
    )


def screening_report(screened: DataFrame) -> DataFrame:
    """Documents, blocked and modified per source and blocking layer, with subtotals.

    ``level`` 0 = (source, blocked_at), 1 = source, 3 = everything.
    """
    kind = F.when(F.col("blocked_at_variant").isNull(), None).when(
        F.col("blocked_at_variant") == "original", "original"
    ).otherwise("decoded")
    rows = screened.select(
        "source",
        F.coalesce("blocked_at", F.lit("none")).alias("blocked_at"),
        "blocked",
        "modified",
        kind.alias("kind"),
    )
    return (
        rows.rollup("source", "blocked_at")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("documents"),
            F.count_if("blocked").alias("blocked"),
            F.count_if("modified").alias("modified"),
            F.count_if(F.col("kind") == "original").alias("blocked_original"),
            F.count_if(F.col("kind") == "decoded").alias("blocked_decoded"),
        )
    )


def screening_events(screened: DataFrame, as_of: Column, id: str = "doc_id") -> DataFrame:
    """One log event per screened document."""
    ok = F.concat(
        F.lit("Clean "),
        F.col("source"),
        F.lit(": "),
        F.col("content_length").cast("string"),
        F.lit(" -> "),
        F.col("result_length").cast("string"),
        F.lit(" chars"),
    )
    bad = F.concat(
        F.when(F.col("blocked_at") == "decoders", "Blocked by decoder: base64 candidate cap exceeded")
        .otherwise(
            F.concat(F.lit("Blocked by "), F.regexp_replace("block_reason", "^Detector ", ""))
        ),
        F.coalesce(chain.variant_suffix(F.col("blocked_at_variant")), F.lit("")),
    )
    return screened.where(F.col("rejected").isNull()).select(
        F.col(id),
        as_of.alias("ts"),
        F.when(F.col("blocked"), "detection").otherwise("sanitizer").alias("layer"),
        F.when(F.col("blocked"), "blocked")
        .when(F.col("modified"), "modified")
        .otherwise("passed")
        .alias("verdict"),
        F.concat(F.lit("api:clean:"), F.col("source")).alias("source_id"),
        F.when(F.col("blocked"), bad).otherwise(ok).alias("detail"),
        F.lit(0.0).alias("duration_ms"),
        F.lit("{}").alias("metadata"),
    )
