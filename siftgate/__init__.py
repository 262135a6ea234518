"""Screening of untrusted text on Spark: functions from DataFrame to DataFrame."""

from siftgate.options import (
    BoundaryOptions,
    DecodeOptions,
    GuardOptions,
    JudgeOptions,
    OptionError,
    SanitizeOptions,
    ScreenOptions,
    WindowOptions,
)

__all__ = [
    "BoundaryOptions",
    "DecodeOptions",
    "GuardOptions",
    "JudgeOptions",
    "OptionError",
    "SanitizeOptions",
    "ScreenOptions",
    "WindowOptions",
]
