"""Decoded variants of a text as one array expression (no shuffle, so it streams as it is).

``variants(text)`` yields ``ARRAY<STRUCT<label, text, depth, skipped, skip_reason>>``: the text
itself, its ROT13 form, every decodable base64 span, and both again for each accepted variant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgate.functions.text import fixed, let
from siftgate.options import DecodeOptions

# --- fixed values -------------------------------------------------------------------------------
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROTATED = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
SPAN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
UNPRINTABLE = r"[\p{C}\p{Z}\x{fffd}&&[^ \n\r\t]]"
# ------------------------------------------------------------------------------------------------

# The same runs for the JVM: looking behind keeps it from retrying every suffix of every word, and
# a class of single characters is one table lookup where ranges are a chain of tests.
_ONE = f"[{PLAIN}0123456789+/_\\-]"
JVM_SPAN = f"(?<!{_ONE}){_ONE}{{20,}}={{0,2}}"
SPANS_TYPE = "array<struct<start:int,end:int,span:string>>"
VARIANT_TYPE = "struct<label:string,text:string,depth:int,skipped:boolean,skip_reason:string>"


def rot13(text: Column) -> Column:
    return F.translate(text, PLAIN, ROTATED)


def spans(text: Column) -> Column:
    """Base64-shaped runs with code-point offsets: ``ARRAY<STRUCT<start, end, span>>``.

    Offsets are running sums over the gaps between runs, so a text is walked once however many
    runs it holds.
    """
    found = F.regexp_extract_all(text, F.lit(JVM_SPAN), F.lit(0))
    gaps = F.transform(F.split(text, JVM_SPAN, -1), lambda g: F.length(g))

    def place(runs: Column, between: Column) -> Column:
        first = F.array(F.lit(0))  # seed; dropped below
        ends = F.aggregate(
            F.zip_with(F.slice(between, 1, F.size(runs)), runs, lambda g, s: g + F.length(s)),
            first,
            lambda acc, step: F.concat(acc, F.array(F.element_at(acc, -1) + step)),
        )
        return let(
            ends,
            lambda stops: F.transform(
                runs,
                lambda s, i: F.struct(
                    (F.get(stops, i + 1) - F.length(s)).alias("start"),
                    F.get(stops, i + 1).alias("end"),
                    s.alias("span"),
                ),
            ),
        )

    return let(found, lambda runs: F.when(F.size(runs) > 0, let(gaps, lambda b: place(runs, b)))
               .otherwise(F.array().cast(SPANS_TYPE)))


def base64_bytes(span: Column) -> Column:
    """Bytes of a span, or null. Both alphabets, missing or surplus padding tolerated."""
    core = F.translate(F.rtrim(span, F.lit("=")), "-_", "+/")
    padded = lambda t: F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4))))
    # one character over a multiple of four never decodes; saying so is cheaper than an exception
    return let(
        core,
        lambda t: F.when(
            F.pmod(F.length(t), F.lit(4)) != 1, F.try_to_binary(padded(t), F.lit("base64"))
        ),
    )


def printable_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, UNPRINTABLE, "")) / F.length(text)


def _variant(label, text, depth, reason=None) -> Column:
    skipped = F.lit(False) if reason is None else reason.isNotNull()
    why = F.lit(None).cast("string") if reason is None else reason
    return F.struct(
        label.alias("label"),
        text.alias("text"),
        F.lit(depth).cast("int").alias("depth"),
        skipped.alias("skipped"),
        why.alias("skip_reason"),
    )


def decoded(span: Column, o: DecodeOptions) -> Column:
    """``STRUCT<text, reason>`` of one candidate: decoded text, or why it was set aside."""

    def gate(raw: Column) -> Column:
        def judge(text: Column) -> Column:
            return let(
                printable_ratio(text),
                lambda ratio: F.struct(
                    F.when(ratio < o.min_printable, F.lit("")).otherwise(text).alias("text"),
                    F.when(
                        ratio < o.min_printable,
                        F.concat(F.lit("low_printable_ratio:"), fixed(ratio, 2)),
                    ).alias("reason"),
                ),
            )

        set_aside = F.struct(
            F.lit("").alias("text"),
            F.when(raw.isNull(), "decode_failed").otherwise("too_short").alias("reason"),
        )
        usable = raw.isNotNull() & (F.octet_length(raw) >= o.min_bytes)
        return F.when(usable, let(F.make_valid_utf8(raw.cast("string")), judge)).otherwise(
            set_aside
        )

    return let(base64_bytes(span), gate)


def _candidates(found, before, parent, depth, o: DecodeOptions) -> Column:
    """Candidates of one text; ``before`` is how many the document has used already."""
    head = F.lit("base64@") if parent is None else F.concat(parent, F.lit("/base64@"))

    def one(c: Column, i: Column) -> Column:
        label = F.concat(head, c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))
        over = F.struct(F.lit("").alias("text"), F.lit("candidate_cap").alias("reason"))
        result = F.when(before + i >= o.candidate_cap, over).otherwise(decoded(c["span"], o))
        return let(result, lambda r: _variant(label, r["text"], depth, r["reason"]))

    return F.transform(found, one)


def _rotated(text, parent, depth) -> Column:
    label = F.lit("rot13") if parent is None else F.concat(parent, F.lit("/rot13"))
    none = F.array().cast(f"array<{VARIANT_TYPE}>")
    return let(
        rot13(text),
        lambda r: F.when(r != text, F.array(_variant(label, r, depth))).otherwise(none),
    )


def first_pass(text: Column, o: DecodeOptions, found: Column) -> Column:
    """Depth-1 variants: ROT13 of the text, then its base64 candidates in order."""
    return F.concat(_rotated(text, None, 1), _candidates(found, F.lit(0), None, 1, o))


def second_pass(used: Column, found: Column, ones: Column, o: DecodeOptions) -> Column:
    """Depth-2 variants of every accepted depth-1 variant.

    Candidates share one budget per document, in order of discovery over both passes. ROT13 twice
    is the text itself, which is never kept again; and as ROT13 maps the base64 alphabet to itself,
    the runs of the rotated text are the runs of the text, rotated.
    """
    parents = F.filter(ones, lambda v: ~v["skipped"] & (v["text"] != ""))
    none = F.array().cast(f"array<{VARIANT_TYPE}>")

    def runs(v: Column) -> Column:
        rotated = F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), rot13(s["span"]).alias("span")
            ),
        )
        return F.when(v["label"] == "rot13", rotated).otherwise(spans(v["text"]))

    def expand(p: Column) -> Column:
        with_spans = F.transform(p, lambda v: F.struct(v.alias("v"), runs(v).alias("f")))

        def number(ws: Column) -> Column:
            # at most candidate_cap + 1 parents, so the running total is a short loop
            return F.flatten(
                F.transform(
                    ws,
                    lambda w, i: let(
                        used
                        + F.aggregate(
                            F.slice(ws, 1, i), F.lit(0), lambda acc, u: acc + F.size(u["f"])
                        ),
                        lambda before: F.concat(
                            F.when(w["v"]["label"] == "rot13", none).otherwise(
                                _rotated(w["v"]["text"], w["v"]["label"], 2)
                            ),
                            _candidates(w["f"], before, w["v"]["label"], 2, o),
                        ),
                    ),
                )
            )

        return let(with_spans, number)

    return let(parents, expand)


def dedupe(all_variants: Column) -> Column:
    """Keep the first accepted variant of each text and every skipped one."""
    return let(
        F.transform(all_variants, lambda v: F.when(~v["skipped"], v["text"])),
        lambda texts: F.filter(
            all_variants,
            lambda v, i: v["skipped"] | (F.array_position(texts, v["text"]) == i + 1),
        ),
    )


def variants(text: Column, options: DecodeOptions = DecodeOptions()) -> Column:
    """Every variant of ``text``, in discovery order. Null text has no variants (null)."""
    o = options

    def build(t: Column) -> Column:
        original = F.array(_variant(F.lit("original"), t, 0))

        def passes(found: Column) -> Column:
            def join(ones: Column) -> Column:
                parts = [original, ones]
                if o.max_depth >= 2:
                    parts.append(second_pass(F.size(found), found, ones, o))
                return let(F.concat(*parts), dedupe)

            return let(first_pass(t, o, found), join)

        if o.max_depth < 1:
            body = original
        elif o.base64:
            body = let(spans(t), passes)
        else:  # ROT13 alone: a second pass could only give the text back
            body = F.concat(original, _rotated(t, None, 1))
        return F.when(t.isNotNull(), F.when(t == "", original).otherwise(body))

    return let(text, build)


def cap_exhausted(variants_column: Column) -> Column:
    return F.exists(variants_column, lambda v: v["skip_reason"].eqNullSafe(F.lit("candidate_cap")))
