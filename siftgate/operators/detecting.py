"""Detection: windows, scores, verdicts, the chain.

Two shapes of the same thing. ``run_chain`` keeps a document's variants, windows and scores in
its own row, so screening a corpus shuffles nothing and an expensive detector never sees a
document an earlier one has blocked. The long-table functions do it over a stored score table
(scores made elsewhere, one row per window) with algebraic aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgate.functions import detecting as X
from siftgate.functions.detecting import DEFAULT_CHAIN, Detector
from siftgate.functions.text import let
from siftgate.operators.layout import settle
from siftgate.options import INJECTION_LABELS, OptionError, WindowOptions

LEDGER_TYPE = (
    "array<struct<detector_index:int,detector_name:string,variant_ord:int,variant_label:string,"
    "passed:boolean,max_score:double,n_windows:int,top_label:string,window_index:int,label:string>>"
)


def run_chain(
    df: DataFrame,
    variants: str = "variants",
    detectors: Sequence[Detector] = DEFAULT_CHAIN,
    windows: WindowOptions = WindowOptions(),
    tokenizer: X.TokenizerWindows | None = None,
) -> DataFrame:
    """Add ``ledger`` (results up to and including the block) and ``block`` (its last entry, or
    null). Detector-major: a later variant under an earlier detector wins."""
    names = [d.name for d in detectors]
    if len(set(names)) != len(names):
        raise OptionError("detector names must be unique")
    out = with_windows(df, variants, windows, tokenizer)
    for index, detector in enumerate(detectors):
        out = one_detector(out, index, detector)
    return settle(finish_chain(out).drop("_live", "_flat"), "ledger", "block")


def with_windows(df, variants, windows, tokenizer) -> DataFrame:
    """Cut every accepted, non-empty variant into windows, once for all detectors."""
    live = F.filter(
        F.transform(
            F.col(variants),
            lambda v, i: F.struct(
                i.alias("ord"),
                v["label"].alias("label"),
                v["text"].alias("text"),
                v["skipped"].alias("skipped"),
            ),
        ),
        lambda v: ~v["skipped"] & (v["text"] != ""),
    )
    if tokenizer is None:
        cut = F.transform(
            live,
            lambda v: F.struct(
                v["ord"].alias("ord"),
                v["label"].alias("label"),
                X.windows(v["text"], windows).alias("w"),
            ),
        )
        out = df.withColumn("_live", cut)
    else:
        out = df.withColumn("_kept", live)
        out = out.withColumn("_w", tokenizer.windows(F.transform("_kept", lambda v: v["text"])))
        cut = F.zip_with(
            "_kept",
            "_w",
            lambda v, w: F.struct(v["ord"].alias("ord"), v["label"].alias("label"), w.alias("w")),
        )
        out = out.withColumn("_live", cut).drop("_kept", "_w")
    out = out.withColumn("_flat", F.flatten(F.transform("_live", lambda v: v["w"])))
    return fresh_ledger(out)


def fresh_ledger(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "ledger", F.when(F.col("_live").isNotNull(), F.array().cast(LEDGER_TYPE))
    )


def finish_chain(df: DataFrame) -> DataFrame:
    last = F.try_element_at("ledger", F.lit(-1))
    return df.withColumn("block", F.when(~last["passed"], last)).drop("_scores", "_open")


def one_detector(df: DataFrame, index: int, detector: Detector) -> DataFrame:
    df = df.withColumn("_open", ~F.exists("ledger", lambda r: ~r["passed"]))
    df = df.withColumn("_scores", detector.scores(F.when(F.col("_open"), F.col("_flat"))))

    def results(live: Column, scores: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            start = F.aggregate(
                F.slice(live, 1, i), F.lit(1), lambda acc, u: acc + F.size(u["w"])
            )
            mine = F.slice(scores, start, F.size(v["w"]))
            return let(
                X.verdict(mine, detector),
                lambda r: F.struct(
                    F.lit(index).alias("detector_index"),
                    F.lit(detector.name).alias("detector_name"),
                    v["ord"].alias("variant_ord"),
                    v["label"].alias("variant_label"),
                    (~r["blocked"]).alias("passed"),
                    r["max_score"].alias("max_score"),
                    r["n_windows"].alias("n_windows"),
                    r["top_label"].alias("top_label"),
                    r["window_index"].alias("window_index"),
                    r["label"].alias("label"),
                ),
            )

        return F.transform(live, one)

    def cut(rows: Column) -> Column:
        stop = F.array_position(F.transform(rows, lambda r: r["passed"]), F.lit(False)).cast("int")
        return F.when(stop > 0, F.slice(rows, 1, stop)).otherwise(rows)

    added = F.when(
        F.col("_scores").isNotNull(), let(results(F.col("_live"), F.col("_scores")), cut)
    ).otherwise(F.array().cast(LEDGER_TYPE))
    return df.withColumn("ledger", F.concat("ledger", added))


# --- long score tables --------------------------------------------------------------------------

TEXT_KEY = ("detector_index", "detector_name", "variant_ord", "variant_label")


def explode_windows(
    variants: DataFrame,
    id: str = "doc_id",
    windows: WindowOptions = WindowOptions(),
    tokenizer: X.TokenizerWindows | None = None,
) -> DataFrame:
    """``(id, variant_ord, variant_label, window_index, n_windows, text)`` from a variant table.

    Windows index from 1. Skipped and empty variants have none.
    """
    rows = variants.where(~F.col("skipped") & (F.col("text") != ""))
    if tokenizer is None:
        cut = X.windows(F.col("text"), windows)
    else:
        cut = F.get(tokenizer.windows(F.array("text")), F.lit(0))
    rows = rows.select(
        id,
        F.col("ord").alias("variant_ord"),
        F.col("label").alias("variant_label"),
        cut.alias("_w"),
    )
    return rows.select(
        id,
        "variant_ord",
        "variant_label",
        F.size("_w").alias("n_windows"),
        F.posexplode_outer("_w").alias("_i", "text"),  # outer: see decoding.expand_variants
    ).where(F.col("_i").isNotNull()).select(
        id,
        "variant_ord",
        "variant_label",
        (F.col("_i") + 1).alias("window_index"),
        "n_windows",
        "text",
    )


def score_windows(
    windows: DataFrame, detectors: Sequence[Detector] = DEFAULT_CHAIN, text: str = "text"
) -> DataFrame:
    """Long score table: one row per (window, detector); the text itself is dropped."""
    out = windows
    for i, d in enumerate(detectors):
        out = out.withColumn(f"_s{i}", F.get(d.scores(F.array(F.col(text))), F.lit(0)))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("detector_index"),
                F.lit(d.name).alias("detector_name"),
                F.col(f"_s{i}.label").alias("label"),
                F.col(f"_s{i}.score").alias("score"),
            )
            for i, d in enumerate(detectors)
        ]
    )
    keep = [c for c in windows.columns if c != text]
    return out.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def text_verdicts(
    scores: DataFrame,
    id: str = "doc_id",
    threshold: float = 0.9,
    labels: Sequence[str] = INJECTION_LABELS,
) -> DataFrame:
    """Per (document, detector, variant): blocked at the first window over the threshold, else
    the strongest injection score, window count and label of the best window."""
    inj = F.col("label").isin(*labels)
    hit = F.min(
        F.when(inj & (F.col("score") >= threshold), F.struct("window_index", "score", "label"))
    )
    best = F.max(F.struct("score", (-F.col("window_index")).alias("back"), "label"))
    extra = [F.sum("duration_ms").alias("duration_ms")] if "duration_ms" in scores.columns else []
    out = scores.groupBy(id, *TEXT_KEY).agg(
        hit.alias("hit"),
        F.max(F.when(inj, F.col("score"))).alias("strongest"),
        best.alias("best"),
        F.count(F.lit(1)).cast("int").alias("n_windows"),
        *extra,
    )
    return out.select(
        id,
        *TEXT_KEY,
        F.col("hit").isNotNull().alias("blocked"),
        F.coalesce("hit.score", "strongest", F.lit(0.0)).alias("max_score"),
        "n_windows",
        F.col("best.label").alias("top_label"),
        F.col("hit.window_index").alias("window_index"),
        F.col("hit.label").alias("label"),
        *[c for c in ("duration_ms",) if c in scores.columns],
    )


def chain_blocks(verdicts: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document: the blocking (detector, variant), detector-major, or nulls."""
    first = F.min(
        F.when(
            F.col("blocked"),
            F.struct(
                "detector_index",
                "variant_ord",
                "detector_name",
                "variant_label",
                "label",
                "max_score",
                "window_index",
                "n_windows",
            ),
        )
    )
    out = verdicts.groupBy(id).agg(first.alias("b"))
    return out.select(
        id,
        F.col("b").isNotNull().alias("blocked"),
        F.col("b.detector_name").alias("blocked_detector"),
        F.col("b.variant_label").alias("blocked_at_variant"),
        F.when(
            F.col("b").isNotNull(),
            X.block_reason(
                F.regexp_replace("b.detector_name", "^detection:", ""),
                F.col("b.label"),
                F.col("b.max_score"),
                F.col("b.window_index"),
                F.col("b.n_windows"),
            ),
        ).alias("block_reason"),
    )


def ledger(verdicts: DataFrame, id: str = "doc_id") -> DataFrame:
    """Verdicts at or before the block: what a short-circuiting chain would have run."""
    here = F.struct("detector_index", "variant_ord")
    stop = F.min(F.when(F.col("blocked"), here)).over(Window.partitionBy(id))
    kept = verdicts.withColumn("_stop", stop)
    return kept.where(F.col("_stop").isNull() | (here <= F.col("_stop"))).drop("_stop")


def detector_trace(ledger_rows: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per (document, detector): the block if there is one, else the last pass."""
    pick = F.max(
        F.struct(
            "blocked",
            "variant_ord",
            "variant_label",
            "max_score",
            "n_windows",
            "top_label",
            "window_index",
            "label",
        )
    )
    out = ledger_rows.groupBy(id, "detector_index", "detector_name").agg(
        pick.alias("p"), F.sum("duration_ms").alias("duration_ms")
    )
    model = F.regexp_replace("detector_name", "^detection:", "")
    ms = F.concat(
        F.lit(" ("), F.bround("duration_ms", 0).cast("bigint").cast("string"), F.lit("ms)")
    )
    return out.select(
        id,
        "detector_index",
        F.col("detector_name").alias("layer"),
        F.when(F.col("p.blocked"), "blocked").otherwise("passed").alias("verdict"),
        F.when(F.col("p.blocked"), blocked_detail(model, F.col("p"), ms))
        .otherwise(passed_detail(model, F.col("p"), ms))
        .alias("detail"),
        F.bround("duration_ms", 1).alias("duration_ms"),
        F.bround("p.max_score", 4).alias("max_score"),
        F.col("p.n_windows").alias("n_windows"),
        F.col("p.window_index").alias("window_index"),
    )


def passed_detail(model: Column, r: Column, ms: Column | None = None) -> Column:
    from siftgate.functions.text import fixed

    many = F.concat(F.lit(", "), r["n_windows"].cast("string"), F.lit(" windows"))
    parts = [
        model,
        F.lit(": clean (max="),
        fixed(r["max_score"], 3),
        F.when(r["n_windows"] > 1, many).otherwise(""),
        F.lit(")"),
    ]
    return F.concat(*parts, *([ms] if ms is not None else []))


def variant_suffix(label: Column) -> Column:
    return F.when(label != "original", F.concat(F.lit(" variant="), label)).otherwise("")


def blocked_detail(model: Column, r: Column, ms: Column | None = None) -> Column:
    why = X.block_reason(model, r["label"], r["max_score"], r["window_index"], r["n_windows"])
    mid = [ms] if ms is not None else []
    return F.concat(model, F.lit(": "), why, *mid, variant_suffix(r["variant_label"]))
