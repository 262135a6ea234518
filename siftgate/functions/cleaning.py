"""Cleaning steps as column expressions (order is part of the meaning)."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftgate.functions.text import java_pattern, let, rare, remove, strip
from siftgate.options import SanitizeOptions

# --- fixed values: what each step removes -------------------------------------------------------
ZERO_WIDTH_SET = r"\x{200b}-\x{200f}\x{feff}\x{2060}-\x{2064}"
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
TAG = r"<[^>]+>"
CSS_DISPLAY = r"(?i)display\s*:\s*none[^;]*;?"
CSS_FONT = r"(?i)font-size\s*:\s*0[^;]*;?"
CSS_COLOR = r"(?i)color\s*:\s*(?:white|#fff(?:fff)?|rgb\(255,\s*255,\s*255\))[^;]*;?"
CONTROL_SET = (
    r"\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{600}-\x{605}\x{61c}\x{6dd}"
    r"\x{70f}\x{890}\x{891}\x{8e2}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}"
    r"\x{2066}-\x{206f}\x{feff}\x{fff9}-\x{fffb}\x{110bd}\x{110cd}\x{13430}-\x{1345f}"
    r"\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0001}\x{e0020}-\x{e007f}"
)
BIDI_SET = r"\x{202a}-\x{202e}\x{2066}-\x{2069}"
EMOJI_SET = r"\x{fe00}-\x{fe0f}\x{e0100}-\x{e01ef}\x{e0001}-\x{e007f}"
DECODE_ROUNDS = 4
# ------------------------------------------------------------------------------------------------


def strip_zero_width(c: Column) -> Column:
    return remove(c, rare(ZERO_WIDTH_SET))


def strip_scripts(c: Column) -> Column:
    return remove(remove(c, java_pattern(SCRIPT)), java_pattern(STYLE))


def strip_tags(c: Column) -> Column:
    """Drop tags. Text after the last ``>`` cannot hold one and is not searched, so a run of
    unclosed ``<`` costs one look instead of a scan to the end for each."""

    def split(x: Column) -> Column:
        tail = F.substring_index(x, ">", -1)
        return let(
            tail, lambda t: F.concat(remove(F.left(x, F.length(x) - F.length(t)), TAG), t)
        )

    return let(c, split)


def strip_hidden_css(c: Column) -> Column:
    for pattern in (CSS_DISPLAY, CSS_FONT, CSS_COLOR):
        c = remove(c, java_pattern(pattern))
    return c


def strip_control(c: Column) -> Column:
    return remove(c, rare(CONTROL_SET))


def strip_bidi(c: Column) -> Column:
    return remove(c, rare(BIDI_SET))


def strip_emoji_smuggling(c: Column) -> Column:
    return remove(c, rare(EMOJI_SET))


def strip_patterns(c: Column, patterns: tuple[str, ...]) -> Column:
    for pattern in patterns:
        c = remove(c, pattern)
    return c


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{3,}", "\n\n")


def truncate(c: Column, max_length: int | None) -> Column:
    return strip(F.substring(c, 1, max_length) if max_length else c)


def decode_entities(text: str) -> str:
    for _ in range(DECODE_ROUNDS):
        decoded = unquote(html.unescape(text))
        if decoded == text:
            break
        text = decoded
    return text


@F.pandas_udf(StringType())
def _decode_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(decode_entities, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def decode_encodings(c: Column) -> Column:
    """HTML entities and percent-encoding, to a fixed point.

    Only rows that can change cross to Python: the others travel as nulls.
    """
    return F.coalesce(_decode_udf(F.when(c.rlike("[&%]"), c)), c)


def normalize_nfkc(c: Column) -> Column:
    """NFKC. ASCII text is already normal and stays in the JVM."""
    return F.coalesce(_nfkc_udf(F.when(F.octet_length(c) != F.length(c), c)), c)


def cleaned(text: Column, options: SanitizeOptions = SanitizeOptions()) -> Column:
    """The whole cleaning program as one expression; disabled steps are absent from the plan."""
    c = decode_encodings(text) if options.decode_encodings else text
    c = strip_hidden(c, options)
    if options.nfkc:
        c = normalize_nfkc(c)
    return finish(c, options)


def strip_hidden(c: Column, o: SanitizeOptions) -> Column:
    """Steps between decoding and NFKC."""
    if o.zero_width:
        c = strip_zero_width(c)
    if o.scripts or o.html:
        # one byte scan decides whether the markup passes run at all
        def markup(x: Column) -> Column:
            y = strip_scripts(x) if o.scripts else x
            y = strip_tags(y) if o.html else y
            return F.when(F.contains(x, F.lit("<")), y).otherwise(x)

        c = let(c, markup)
    if o.css_hidden:
        c = let(c, lambda x: F.when(F.contains(x, F.lit(":")), strip_hidden_css(x)).otherwise(x))
    # the three single-character sweeps are adjacent and commute: one pass over their union
    sweeps = [
        chars
        for on, chars in (
            (o.control_chars, CONTROL_SET),
            (o.bidi, BIDI_SET),
            (o.emoji_smuggling, EMOJI_SET),
        )
        if on
    ]
    return remove(c, rare("".join(sweeps))) if sweeps else c


def finish(c: Column, o: SanitizeOptions) -> Column:
    """Steps after NFKC."""
    c = strip_patterns(c, o.custom_patterns)
    if o.collapse_whitespace:
        c = collapse_whitespace(c)
    return truncate(c, o.max_length)
