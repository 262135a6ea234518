"""Output-guard predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgate.functions.text import java_pattern, let
from siftgate.options import GUARD_PATTERNS, GuardOptions


def too_long(text: Column, options: GuardOptions = GuardOptions()) -> Column:
    return F.length(text) > options.max_length


# Substrings a lower-cased text must hold before the published pattern can match it.
NEEDS = (
    ("ignore", "previous", "instruction"),
    ("disregard", "instruction"),
    ("new", "instruction"),
    ("you", "are", "now"),
    ("admin", "mode"),
    ("</untrusted_",),
    ("system", "<"),
    ("trusted", "<"),
    ("system", ":"),
    ("system", ":", "\n"),
    ("tool_use",),
    ("function_call",),
    ("tool_call",),
    ("忽略", "指令"),
    ("تجاهل", "تعليمات"),
    ("forward", "all"),
    ("send", "all"),
)
# Letters that a case-blind ASCII letter also matches but lower-casing does not turn into it.
FOLDS_ASIDE = ("\u017f", "\u0130", "\u0131")


def first_pattern(text: Column, options: GuardOptions = GuardOptions()) -> Column:
    """The first configured pattern that matches, or null.

    Byte scans for the words a default pattern cannot do without come first, so the patterns
    themselves only run on the few rows that could match. A caller's own patterns always run.
    """
    if not options.patterns:
        return F.lit(None).cast("string")
    needs = dict(zip(GUARD_PATTERNS, NEEDS, strict=True))

    def any_of(t: Column, parts: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in parts])

    def ladder(t: Column) -> Column:
        def steps(low: Column) -> Column:
            tests = []
            for p in options.patterns:
                hit = t.rlike(java_pattern(p))
                if p in needs:
                    held = reduce(lambda a, b: a & b, [F.contains(low, F.lit(n)) for n in needs[p]])
                    hit = (held | any_of(t, FOLDS_ASIDE)) & hit
                tests.append(F.when(hit, F.lit(p)))
            return F.coalesce(*tests)

        return let(F.lower(t), steps)

    return let(text, ladder)


def injection_reason(text: Column, options: GuardOptions = GuardOptions()) -> Column:
    """Why the text is unsafe, or null. Over-long text is unsafe before any pattern is tried."""
    size = F.concat(
        F.lit("Text exceeds maximum length ("),
        F.length(text).cast("string"),
        F.lit(f" > {options.max_length})"),
    )
    found = F.concat(F.lit("Suspicious pattern in text: "), first_pattern(text, options))
    return F.when(too_long(text, options), size).otherwise(found)
