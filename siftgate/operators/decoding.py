"""Decode-and-rescan over tables. The variants of a document are one array in its own row, so
every operator here is map-only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.functions import decoding as D
from siftgate.functions.text import require_string
from siftgate.operators.layout import settle
from siftgate.options import DecodeOptions


def with_variants(
    df: DataFrame, text: str = "text", options: DecodeOptions = DecodeOptions(), out="variants"
) -> DataFrame:
    require_string(df, text)
    return settle(df.withColumn(out, D.variants(F.col(text), options)), out)


def expand_variants(
    df: DataFrame, id: str = "doc_id", text: str = "text", options: DecodeOptions = DecodeOptions()
) -> DataFrame:
    """Child table ``(id, ord, label, text, depth, skipped, skip_reason)``."""
    require_string(df, text)
    rows = df.select(id, D.variants(F.col(text), options).alias("variants"))
    # outer: a plain explode would have the optimizer test the array, and so build it, twice
    flat = rows.select(id, F.posexplode_outer("variants").alias("ord", "v"))
    return flat.where(F.col("v").isNotNull()).select(id, "ord", "v.*")


def base64_candidates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base64-shaped runs with their offsets: ``(id, n, start, end, span)``."""
    require_string(df, text)
    found = df.select(id, F.posexplode_outer(D.spans(F.col(text))).alias("n", "s"))
    return found.where(F.col("s").isNotNull()).select(id, "n", "s.start", "s.end", "s.span")


def decode_candidates(
    candidates: DataFrame, span: str = "span", options: DecodeOptions = DecodeOptions()
) -> DataFrame:
    """Add ``decoded`` and ``skip_reason`` (quality gate) to a candidate table."""
    out = candidates.withColumn("_d", D.decoded(F.col(span), options))
    return out.withColumn("decoded", F.col("_d.text")).withColumn(
        "skip_reason", F.col("_d.reason")
    ).drop("_d")


def cap_blocks(with_variants_df: DataFrame, variants: str = "variants") -> DataFrame:
    """Add ``cap_exhausted``: the document spent its candidate budget and must be blocked."""
    return with_variants_df.withColumn("cap_exhausted", D.cap_exhausted(F.col(variants)))


def audit(expanded: DataFrame) -> DataFrame:
    """What was tried, never what it said."""
    return expanded.drop("text")
