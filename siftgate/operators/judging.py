"""The judge as two tables: requests out, replies in.

Calling a model is the caller's business. These operators build one request per accepted variant,
read the replies, and decide; a missing reply is an error, never a pass by accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions.text import fixed, strip, valid_json
from siftgate.options import JudgeOptions, OptionError

NONCE_TRIES = 8
REPLY = r'(?s)\{[^{}]*"verdict"[^{}]*\}'
LAYER = "detection:llm_judge"


def _nonce(text: Column, seed: str, *key: Column) -> Column:
    """16 hex digits that do not occur as a marker in the text; 32 if eight tries all do."""

    def digest(k: int) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in key], F.lit(str(k))), 256)

    tries = []
    for k in range(NONCE_TRIES):
        nonce = F.left(digest(k), F.lit(16))
        marker = F.concat(F.lit("INPUT_"), nonce, F.lit("_"))
        tries.append(F.when(~F.contains(text, marker), nonce))
    return F.coalesce(*tries, F.left(digest(NONCE_TRIES), F.lit(32)))


def judge_requests(variants: DataFrame, seed: str, id: str = "doc_id") -> DataFrame:
    """``(id, variant_ord, variant_label, nonce, message)`` per accepted, non-empty variant."""
    if not seed:
        raise OptionError("judge markers need a secret seed")
    rows = variants.where(~F.col("skipped") & (F.col("text") != ""))
    rows = rows.withColumn("nonce", _nonce(F.col("text"), seed, F.col(id), F.col("ord")))
    message = F.concat(
        F.lit("[INPUT_"), F.col("nonce"), F.lit("_START]\n"),
        F.col("text"),
        F.lit("\n[INPUT_"), F.col("nonce"), F.lit("_END]"),
    )
    return rows.select(
        id,
        F.col("ord").alias("variant_ord"),
        F.col("label").alias("variant_label"),
        "nonce",
        message.alias("message"),
    )


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``verdict, confidence, reason`` read from the first flat object naming a verdict."""
    out = replies.withColumn("_o", F.nullif(F.regexp_extract(raw, REPLY, 0), F.lit("")))
    out = out.withColumn(
        "_j",
        F.when(
            valid_json(F.col("_o")),
            F.from_json("_o", "verdict string, confidence string, reason string"),
        ),
    )
    word = strip(F.upper(F.coalesce("_j.verdict", F.lit(""))))
    known = F.col("_j").isNotNull() & word.isin("SAFE", "INJECTION")
    score = F.coalesce(F.col("_j.confidence").try_cast("double"), F.lit(0.0))
    blank = F.col(raw).isNull() | (F.col(raw) == "")
    reason = (
        F.when(blank, "empty response")
        .when(F.col("_j").isNull(), F.left(raw, F.lit(120)))
        .when(~known, F.concat(F.lit("unknown verdict '"), word, F.lit("'")))
        .otherwise(F.left(F.coalesce("_j.reason", F.lit("")), F.lit(200)))
    )
    return (
        out.withColumn("verdict", F.when(known, word).otherwise("UNPARSEABLE"))
        .withColumn(
            "confidence",
            F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0),
        )
        .withColumn("reason", reason)
        .drop("_o", "_j")
    )


def judge_results(
    requests: DataFrame,
    parsed: DataFrame,
    options: JudgeOptions = JudgeOptions(),
    id: str = "doc_id",
) -> DataFrame:
    """Join replies to requests and apply the threshold; adds ``verdict, confidence, blocks``."""
    keep = [c for c in ("latency_ms",) if c in parsed.columns]
    replies = parsed.select(id, "variant_ord", "verdict", "confidence", *keep)
    out = requests.select(id, "variant_ord", "variant_label").join(
        replies, [id, "variant_ord"], "left"
    )
    weak = (F.col("verdict") == "INJECTION") & (F.col("confidence") < options.threshold)
    verdict = F.when(weak, "SAFE").otherwise(F.coalesce("verdict", F.lit("ERROR")))
    out = out.withColumn("verdict", verdict).withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )
    blocking = ["INJECTION"] if options.fail_open else ["INJECTION", "ERROR", "UNPARSEABLE"]
    return out.withColumn("blocks", F.col("verdict").isin(*blocking))


def judge_decisions(results: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document: the first blocking variant and why; ``blocked`` false when none."""
    first = F.min(
        F.when(F.col("blocks"), F.struct("variant_ord", "variant_label", "verdict", "confidence"))
    )
    last = F.max(
        F.when(F.col("verdict") == "SAFE", F.struct("variant_ord", "verdict", "confidence"))
    )
    out = results.groupBy(id).agg(first.alias("b"), last.alias("s"))
    reason = (
        F.when(
            F.col("b.verdict") == "INJECTION",
            F.concat(F.lit("LLM judge: INJECTION ("), fixed(F.col("b.confidence"), 2), F.lit(")")),
        )
        .when(F.col("b.verdict") == "ERROR", "LLM judge unreachable (fail-closed)")
        .when(
            F.col("b.verdict") == "UNPARSEABLE", "LLM judge unparseable response (fail-closed)"
        )
    )
    return out.select(
        id,
        F.col("b").isNotNull().alias("blocked"),
        F.col("b.variant_label").alias("blocked_at_variant"),
        reason.alias("block_reason"),
        F.col("s.verdict").alias("safe_label"),
        F.col("s.confidence").alias("safe_confidence"),
    )
