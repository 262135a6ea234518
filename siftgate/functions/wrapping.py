"""Trust-boundary wrapping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgate.functions.text import remove
from siftgate.options import BoundaryOptions

BORDER_WIDTH = 60


def identifier(value: Column) -> Column:
    """Keep letters, digits, underscore and hyphen (ASCII only)."""
    return remove(value, r"[^a-zA-Z0-9_\-]")


def tag_name(prefix: str, source: Column, label: Column | None) -> Column:
    named = identifier(source)
    if label is not None:
        named = F.coalesce(F.nullif(identifier(label), F.lit("")), named)
    return F.concat(F.lit(f"{prefix}_"), named)


def wrap_xml(text: Column, tag: Column, source: Column, o: BoundaryOptions) -> Column:
    head = [F.lit("<"), tag]
    if o.source_attr:
        head += [F.lit(' source="'), source, F.lit('"')]
    if o.treat_as_attr:
        head.append(F.lit(' treat_as="data_only"'))
    return F.concat(
        *head, F.lit(f">\n{o.instruction}\n"), text, F.lit("\n</"), tag, F.lit(">")
    )


def wrap_markdown(text: Column, tag: Column, source: Column, o: BoundaryOptions) -> Column:
    return F.concat(
        F.lit("```"),
        tag,
        F.lit(" [source="),
        source,
        F.lit(f", treat_as=data_only]\n{o.instruction}\n"),
        text,
        F.lit("\n```"),
    )


def wrap_delimiter(text: Column, tag: Column, source: Column, o: BoundaryOptions) -> Column:
    border = "=" * BORDER_WIDTH
    shout = F.upper(tag)
    return F.concat(
        F.lit("["),
        shout,
        F.lit(" START — source="),
        source,
        F.lit(f", treat_as=data_only]\n{border}\n{o.instruction}\n"),
        text,
        F.lit(f"\n{border}\n["),
        shout,
        F.lit(" END]"),
    )


WRAPPERS = {"xml": wrap_xml, "markdown": wrap_markdown, "delimiter": wrap_delimiter}


def wrapped(
    text: Column,
    source: Column,
    label: Column | None = None,
    options: BoundaryOptions = BoundaryOptions(),
    format: Column | None = None,
) -> Column:
    """Wrap ``text``; with a ``format`` column every row picks its own style.

    An unknown per-row format raises when the row is computed: silently passing untrusted text
    through unwrapped is not an option.
    """
    tag = tag_name(options.prefix, source, label)
    safe = identifier(source)
    if format is None:
        return WRAPPERS[options.format](text, tag, safe, options)
    out = None
    for name, wrapper in WRAPPERS.items():
        value = wrapper(text, tag, safe, options)
        out = F.when(format == name, value) if out is None else out.when(format == name, value)
    message = F.concat(F.lit("unknown boundary format: "), F.coalesce(format, F.lit("null")))
    return out.otherwise(F.raise_error(message).cast("string"))
