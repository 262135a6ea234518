"""Leak forms of a registered token as column expressions.

A token leaks when the text holds it verbatim or in one of five encodings. Everything that
depends only on the token is computed on the registry side, once per token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgate.functions.text import WHITESPACE, WS

# --- fixed values -------------------------------------------------------------------------------
KINDS = ("exact", "casefold", "base64", "hex", "reversed", "spaced")
GAP = rf"[{WS}.\-_]"
GAP_CHARACTERS = WHITESPACE + ".-_"
SHAPES = ("aws", "bearer", "password", "url", "mongo")
# ------------------------------------------------------------------------------------------------

FORM_TYPE = (
    "array<struct<ord:int,source_name:string,token:string,folded:string,b64:string,hexed:string,"
    "backwards:string,squeezed:string,anchors:array<string>,short:boolean>>"
)


def spaced_pattern(token: Column) -> Column:
    """``t{0,3 separators}o{0,3 separators}k…`` with every character quoted."""
    quoted = F.transform(
        F.regexp_extract_all(token, F.lit("(?s)(.)"), F.lit(1)),
        lambda ch: F.when(
            ch.rlike(r"^[\p{Punct}]$"), F.concat(F.lit("\\"), ch)
        ).otherwise(ch),
    )
    return F.array_join(quoted, f"{GAP}{{0,3}}")


def squeezed(text: Column) -> Column:
    """Drop every separator the spaced form may contain."""
    return F.translate(text, GAP_CHARACTERS, "")


def forms(ord: Column, source_name: Column, token: Column) -> Column:
    """Everything the matcher needs to know about one token."""
    raw = token.cast("binary")
    return F.struct(
        ord.cast("int").alias("ord"),
        source_name.alias("source_name"),
        token.alias("token"),
        F.lower(token).alias("folded"),
        F.translate(F.base64(raw), "\r\n", "").alias("b64"),  # without the line ends of mail
        F.lower(F.hex(raw)).alias("hexed"),
        F.reverse(token).alias("backwards"),
        squeezed(token).alias("squeezed"),
    )


def match_kind(
    form: Column, text: Column, folded: Column, tight: Column, encoding_resistant: bool = True
) -> Column:
    """Which form of the token the text holds (first of ``KINDS``), or null."""
    kind = F.when(F.contains(text, form["token"]), "exact")
    if encoding_resistant:
        kind = (
            kind.when(F.contains(folded, form["folded"]), "casefold")
            .when(F.contains(text, form["b64"]), "base64")
            .when(F.contains(folded, form["hexed"]), "hex")
            .when(F.contains(text, form["backwards"]), "reversed")
            # a spaced hit always survives squeezing both sides, so the costly per-token pattern
            # only runs where that cheap test already holds
            .when(
                F.contains(tight, form["squeezed"]) & F.rlike(text, spaced_pattern(form["token"])),
                "spaced",
            )
        )
    return kind


def seeded_hex(seed: str, *parts: Column) -> Column:
    """64 repeatable hex digits. The seed is the secret: whoever has it can forge tokens."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *parts), 256)


def generated_token(source_name: Column, prefix: str, seed: str) -> Column:
    tag = F.left(F.translate(F.upper(source_name), " _", "--"), F.lit(10))
    return F.concat(
        F.lit(f"{prefix}-"), tag, F.lit("-"), F.left(seeded_hex(seed, source_name), F.lit(16))
    )


def _pick(hexes: Column, index: int, alphabet: str) -> Column:
    """One character of ``alphabet`` chosen by two hex digits."""
    value = F.conv(F.substring(hexes, index * 2 + 1, 2), 16, 10).cast("int")
    return F.substring(F.lit(alphabet), F.pmod(value, F.lit(len(alphabet))) + 1, F.lit(1))


def shaped_token(shape: Column, source_name: Column, seed: str) -> Column:
    """Credential-looking decoy per ``shape``; an unknown shape raises.

    The prefixes, lengths and URL forms are fixed values: decoys must have the published shapes.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()
    digits = "0123456789"
    symbols = "!@#$%^&*"
    h = seeded_hex(seed, source_name, shape)
    g = seeded_hex(seed, source_name, shape, F.lit("more"))
    aws = F.concat(F.lit("AKIA"), *[_pick(h, i, upper + digits) for i in range(16)])
    bearer = F.concat(F.lit("tk_live_"), F.left(h, F.lit(32)))
    # the four required classes sit at seed-chosen places inside the twelve
    chosen = [_pick(h, 0, upper), _pick(h, 1, lower), _pick(h, 2, digits), _pick(h, 3, symbols)]
    chosen += [_pick(h, i, upper + lower + digits + symbols) for i in range(4, 12)]
    shuffled = F.transform(
        F.array_sort(
            F.array(
                *[
                    F.struct(F.substring(g, i * 2 + 1, 2).alias("k"), F.lit(i).alias("i"), c.alias("c"))
                    for i, c in enumerate(chosen)
                ]
            )
        ),
        lambda x: x["c"],
    )
    password = F.concat(F.array_join(shuffled, ""), F.substring(h, 41, 6))
    url = F.concat(
        F.lit("https://admin-"),
        F.left(h, F.lit(8)),
        F.lit(".infra.internal/v1/keys/"),
        F.substring(h, 9, 12),
    )
    mongo = F.concat(
        F.lit("mongodb+srv://svc_"),
        F.left(h, F.lit(8)),
        F.lit(":Pw_"),
        F.substring(h, 9, 12),
        F.lit("@cluster-"),
        F.substring(h, 21, 6),
        F.lit(".prod.mongodb.net/app_"),
        F.substring(h, 27, 6),
    )
    message = F.concat(F.lit("unknown shape: "), F.coalesce(shape, F.lit("null")))
    return (
        F.when(shape == "aws", aws)
        .when(shape == "bearer", bearer)
        .when(shape == "password", password)
        .when(shape == "url", url)
        .when(shape == "mongo", mongo)
        .otherwise(F.raise_error(message).cast("string"))
    )


def comment(token: Column, format: Column) -> Column:
    """The token as a comment of the host file; other formats get the bare token."""
    return (
        F.when(format == "html", F.concat(F.lit("<!-- "), token, F.lit(" -->")))
        .when(format == "markdown", F.concat(F.lit("[//]: # ("), token, F.lit(")")))
        .when(format == "yaml", F.concat(F.lit("# "), token))
        .otherwise(token)
    )
