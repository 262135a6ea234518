"""Corpus sanitization (map-only: no shuffle, no driver work)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.functions import cleaning
from siftgate.functions.text import require_string
from siftgate.operators.layout import settle
from siftgate.options import SanitizeOptions


def with_cleaned(
    df: DataFrame, text: str, out: str, options: SanitizeOptions = SanitizeOptions()
) -> DataFrame:
    """Add the cleaned text. Steps that need Python are staged so nothing is computed twice."""
    require_string(df, text)
    if not options.nfkc:
        return df.withColumn(out, cleaning.cleaned(F.col(text), options))
    head = F.col(text)
    if options.decode_encodings:
        head = cleaning.decode_encodings(head)
    staged = settle(df.withColumn(out, cleaning.strip_hidden(head, options)), out)
    staged = settle(staged.withColumn(out, cleaning.normalize_nfkc(F.col(out))), out)
    return staged.withColumn(out, cleaning.finish(F.col(out), options))


def sanitize(
    df: DataFrame, text: str = "text", options: SanitizeOptions = SanitizeOptions()
) -> DataFrame:
    """Clean every row: adds ``cleaned, modified, len_before, len_after, verdict``."""
    out = settle(with_cleaned(df, text, "cleaned", options), "cleaned")
    changed = F.col("cleaned") != F.col(text)
    return (
        out.withColumn("modified", changed)
        .withColumn("len_before", F.length(text))
        .withColumn("len_after", F.length("cleaned"))
        .withColumn(
            "verdict", F.when(F.col("modified"), "modified").when(~F.col("modified"), "passed")
        )
    )


def change_events(sanitized: DataFrame, id: str = "doc_id") -> DataFrame:
    """One passed / modified event per sanitized row."""
    word = F.when(F.col("modified"), "Modified").otherwise("Clean")
    return sanitized.select(
        F.col(id),
        F.lit("sanitizer").alias("layer"),
        "verdict",
        F.concat(
            word,
            F.lit(": "),
            F.col("len_before").cast("string"),
            F.lit(" -> "),
            F.col("len_after").cast("string"),
            F.lit(" chars"),
        ).alias("detail"),
    )
