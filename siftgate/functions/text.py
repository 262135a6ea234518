"""Small column helpers shared by every text operator."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the characters Python calls whitespace ---------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# ------------------------------------------------------------------------------------------------


class TextTypeError(TypeError):
    """The text column of an input is not a string column."""


def require_string(df: DataFrame, name: str) -> DataFrame:
    """Fail at plan time unless ``name`` is a string column (never coerces)."""
    if name not in df.columns:
        raise TextTypeError(f"no column {name!r}; have {df.columns}")
    found = df.schema[name].dataType
    if not isinstance(found, T.StringType):
        raise TextTypeError(f"column {name!r} must be STRING, got {found.simpleString()}")
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it for ``body``.

    A plain alias is not enough: the optimizer may inline an alias that is used once, and inside a
    higher-order function "once" means once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode whitespace from both ends (linear; no regex)."""
    return F.btrim(text, F.lit(WHITESPACE))


def valid_json(text: Column) -> Column:
    """Whether ``text`` is JSON; false for null. An object may repeat a key, which the strict reader refuses."""
    keys = F.json_object_keys(text)
    repeated = (F.size(F.array_distinct(keys)) < F.size(keys)) & F.endswith(strip(text), F.lit("}"))
    return F.coalesce(F.try_parse_json(text).isNotNull() | repeated, F.lit(False))


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON object as a string; of a repeated key the last."""
    return F.from_json(text, f"`{name}` string")[name]


def json_truthy(text: Column, name: str) -> Column:
    """Whether a field is true, a number but 0, or a string, list or object that is not empty."""
    typed = {t: F.from_json(text, f"`{name}` {t}")[name] for t in ("boolean", "double", "array<string>", "map<string,string>")}
    return F.coalesce(
        typed["boolean"],
        typed["double"] != 0,
        F.size(typed["array<string>"]) > 0,
        F.size(typed["map<string,string>"]) > 0,
        json_field(text, name) != "",
        F.lit(False),
    )


def rare(chars: str) -> str:
    """Class for ``chars``, none of which is printable ASCII or a Latin letter.

    The intersection rejects ordinary characters with one comparison; spelling the set alone makes
    the JVM try every range on every character (measured about five times slower).
    """
    return rf"[[^ -~\x{{c0}}-\x{{24f}}]&&[{chars}]]"


def words(text: Column) -> Column:
    """Whitespace tokens; empty array for blank text."""
    spaced = F.regexp_replace(text, rare(WS), " ")
    return F.array_remove(F.split(spaced, " "), "")


def remove(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def java_pattern(pattern: str) -> str:
    """Re-state a pattern so the JVM reads it the way it was published.

    Whitespace, word boundaries and ``.`` are spelt out because their meaning differs per engine;
    ``(?i)`` gains ``u`` so that case folding covers non-ASCII letters.
    """
    word = r"\p{L}\p{N}_"
    boundary = f"(?:(?<![{word}])(?=[{word}])|(?<=[{word}])(?![{word}]))"
    out = pattern.replace(r"\s", f"[{WS}]").replace(r"\b", boundary)
    out = re.sub(r"(?<!\\)\.\{", lambda _: r"[^\n]{", out)
    return out.replace("(?i)", "(?iu)").replace("(?is)", "(?isu)")


def fixed(value: Column, digits: int) -> Column:
    """``%.{digits}f`` of a double in [0, 128), rounding the exact binary value half to even.

    JVM formatting rounds the *printed* decimal half up, which disagrees on ties such as 0.125. A
    double times a power of two is exact, so the value is taken apart into whole numbers and the
    rounding is done on those.
    """
    high, low = 52, 53
    wide = "decimal(38,0)"
    unit = F.lit(Decimal(2 ** (high + low)))
    half = F.lit(Decimal(2 ** (high + low - 1)))

    def whole(top: Column) -> Column:
        upper = F.floor(top)
        lower = ((top - upper) * F.lit(float(2**low))).cast("bigint").cast("decimal(16,0)")
        exact = upper.cast("decimal(19,0)") * F.lit(Decimal(2**low)) + lower
        return (exact.cast(wide) * F.lit(Decimal(10**digits))).cast(wide)

    def render(x: Column) -> Column:
        def settle(q: Column) -> Column:
            rest = x - (q.cast("decimal(8,0)") * unit).cast(wide)
            up = (rest > half) | ((rest == half) & (F.pmod(q, F.lit(2)) == 1))
            return let(q + F.when(up, 1).otherwise(0), show)

        return let(F.call_function("div", x, unit), settle)

    def show(n: Column) -> Column:
        if digits == 0:
            return n.cast("string")
        return F.concat(
            F.call_function("div", n, F.lit(10**digits)).cast("string"),
            F.lit("."),
            F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"),
        )

    return let(value * F.lit(float(2**high)), lambda top: let(whole(top), render))
