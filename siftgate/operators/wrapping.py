"""Trust-boundary operators over tables and conversations (map-only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgate.functions import cleaning, guarding
from siftgate.functions.text import require_string
from siftgate.functions.wrapping import identifier, tag_name, wrapped
from siftgate.operators.sanitizing import with_cleaned
from siftgate.options import BoundaryOptions, GuardOptions, OptionError, SanitizeOptions

UNCUT = SanitizeOptions(max_length=None)


def wrap(
    df: DataFrame,
    text: str = "text",
    source: str | Column = "external",
    label: Column | None = None,
    options: BoundaryOptions = BoundaryOptions(),
    format: Column | None = None,
    out: str = "wrapped",
) -> DataFrame:
    """Wrap a table. ``source`` may be a constant or a column; so may ``format``."""
    require_string(df, text)
    src = F.lit(source) if isinstance(source, str) else source
    return df.withColumn(out, wrapped(F.col(text), src, label, options, format))


def clean(
    df: DataFrame,
    text: str = "text",
    source: str | Column = "external",
    label: Column | None = None,
    max_length: int | None = None,
    format: str = "xml",
    out: str = "result",
) -> DataFrame:
    """Sanitize and wrap in one call; no truncation unless asked for.

    Not idempotent: cleaning a cleaned row wraps it twice, so refuse a frame that has ``out``.
    """
    if out in df.columns:
        raise OptionError(f"column {out!r} exists: these rows may have been cleaned already")
    staged = with_cleaned(df, text, "_cleaned", SanitizeOptions(max_length=max_length))
    boundary = BoundaryOptions(format=format)
    return wrap(staged, "_cleaned", source, label, boundary, out=out).drop("_cleaned")


def wrap_events(
    df: DataFrame,
    source: str | Column = "external",
    label: Column | None = None,
    options: BoundaryOptions = BoundaryOptions(),
    id: str = "doc_id",
) -> DataFrame:
    """One passed event of the trust boundary per wrapped row."""
    src = F.lit(source) if isinstance(source, str) else source
    detail = F.concat(F.lit("Wrapped in <"), tag_name(options.prefix, src, label), F.lit("> (source="), identifier(src), F.lit(")"))
    return df.select(F.col(id), F.lit("trust_boundary").alias("layer"), F.lit("passed").alias("verdict"), detail.alias("detail"))


def _protected(text: Column, source: Column, sanitize: SanitizeOptions, o: BoundaryOptions):
    return wrapped(cleaning.cleaned(text, sanitize), source, None, o)


def protect_conversation(
    df: DataFrame,
    role: str = "role",
    content: str = "content",
    source: str = "external",
    sanitize: SanitizeOptions = UNCUT,
    options: BoundaryOptions = BoundaryOptions(),
) -> DataFrame:
    """Clean and wrap what users and tools wrote; leave every other role and block as it is.

    ``content`` is a string, or ``ARRAY<STRUCT<type, text, content>>`` whose inner ``content`` is
    a string or again such an array (nested tool results).
    """
    src = F.lit(source)
    kind = df.schema[content].dataType

    def safe(c: Column) -> Column:
        return _protected(c, src, sanitize, options)

    def block(b: Column, fields: T.StructType) -> Column:
        inner = fields["content"].dataType
        body = b["content"]
        if isinstance(inner, T.ArrayType):
            fixed = F.transform(body, lambda x: block(x, inner.elementType))
        else:
            fixed = safe(body)
        cols = []
        for f in fields.fields:
            c = b[f.name]
            if f.name == "text":
                c = F.when(b["type"] == "text", safe(F.coalesce(c, F.lit("")))).otherwise(c)
            elif f.name == "content":
                c = F.when(b["type"] == "tool_result", fixed).otherwise(c)
            cols.append(c.alias(f.name))
        return F.struct(*cols)

    if isinstance(kind, T.StringType):
        new = safe(F.col(content))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        new = F.transform(F.col(content), lambda b: block(b, kind.elementType))
    else:
        raise OptionError(f"unsupported content type {kind.simpleString()}")
    return df.withColumn(content, F.when(F.col(role) == "user", new).otherwise(F.col(content)))


def screen_transcript(
    df: DataFrame,
    role: str = "role",
    text: str = "text",
    tool: Column | None = None,
    guard: GuardOptions = GuardOptions(),
) -> DataFrame:
    """Screen a transcript by direction: user and tool rows are cleaned and wrapped, assistant
    rows are guarded and replaced by a notice when unsafe; other roles pass."""
    require_string(df, text)
    who = F.lit(None).cast("string") if tool is None else tool
    inbound = F.when(F.col(role) == "user", F.lit("message")).when(
        F.col(role) == "tool", F.concat(F.lit("tool:"), F.coalesce(who, F.lit("unknown")))
    )
    staged = df.withColumn("source", inbound).withColumn(
        "reason", F.when(F.col(role) == "assistant", guarding.injection_reason(F.col(text), guard))
    )
    notice = F.concat(F.lit("[blocked this message: "), F.col("reason"), F.lit("]"))
    return staged.withColumn(
        "screened",
        F.when(
            F.col("source").isNotNull(),
            _protected(F.col(text), F.col("source"), UNCUT, BoundaryOptions()),
        )
        .when(F.col("reason").isNotNull(), notice)
        .otherwise(F.col(text)),
    )
