"""Isolated map: one prompt per item, one failure per item."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions import cleaning
from siftgate.functions.text import require_string
from siftgate.functions.wrapping import wrapped
from siftgate.options import BoundaryOptions, OptionError, SanitizeOptions

RESULT = "index long, label string, output string, parsed string, error string, suspicious boolean"


def prompt(template: str, item: Column) -> Column:
    """Fill ``{tagged_item}`` while building the plan; braces are escaped as in str.format."""
    parts = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field != "tagged_item" or spec or conversion:
                raise OptionError(f"template may only use {{tagged_item}}, found {field!r}")
            parts.append(item)
    return F.concat(*parts) if parts else F.lit("")


def isolated_map(
    df: DataFrame,
    map_fn: Callable[[str], str],
    index: str = "index",
    text: str = "item",
    sanitize: SanitizeOptions | None = SanitizeOptions(),
    boundary: BoundaryOptions | None = BoundaryOptions(),
    source: str | Column = "external",
    template: str = "{tagged_item}",
    parser: Callable[[str], object] | None = None,
    timeout: float = 30.0,
    concurrency: int = 5,
    label: Column | None = None,
) -> DataFrame:
    """Run ``map_fn`` on every item alone; ``(index, label, output, parsed, error, suspicious)``.

    Sanitizing and wrapping stay in the JVM. In each task up to ``concurrency`` calls run at once;
    one that raises or outlives ``timeout`` costs its own row only. ``source`` and ``label`` may
    differ per row. Rows come as their tasks end and carry ``index``; they are not sorted here, as
    a sort behind the calls would run them once more to sample the order.
    """
    require_string(df, text)
    item = F.col(text)
    if sanitize is not None:
        item = cleaning.cleaned(item, sanitize)
    if boundary is not None:
        item = wrapped(item, F.lit(source) if isinstance(source, str) else source, None, boundary)
    name = F.lit(None) if label is None else label
    prompts = df.select(
        F.col(index).cast("long").alias("index"),
        name.cast("string").alias("label"),
        prompt(template, item).alias("p"),
    )

    def call(p: str, slot: dict) -> None:
        try:
            slot["output"] = map_fn(p)
        except Exception as err:  # noqa: BLE001 - any failure belongs to this row
            slot["error"] = f"{type(err).__name__}: {err}"

    def settle(slot: dict) -> tuple:
        if "error" in slot:
            return "", None, slot["error"], False
        if "output" not in slot:
            return "", None, "Timeout", False
        if parser is None:
            return slot["output"], None, None, False
        try:
            value = parser(slot["output"])
            flag = isinstance(value, dict) and bool(value.get("suspicious"))
            return slot["output"], json.dumps(value), None, flag
        except Exception as err:  # noqa: BLE001
            return "", None, f"{type(err).__name__}: {err}", False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at in range(0, len(batch), concurrency):
                group = batch.iloc[at : at + concurrency]
                started = []
                for p in group["p"]:
                    slot: dict = {}
                    # daemon: a call that never returns must not hold the task open
                    worker = threading.Thread(target=call, args=(p, slot), daemon=True)
                    worker.start()
                    started.append((worker, slot, time.monotonic() + timeout))
                for i, name, (worker, slot, deadline) in zip(group["index"], group["label"], started, strict=True):
                    worker.join(max(0.0, deadline - time.monotonic()))
                    rows.append((i, name, *settle(dict(slot))))
            yield pd.DataFrame(
                rows, columns=["index", "label", "output", "parsed", "error", "suspicious"]
            )

    return prompts.mapInPandas(run, RESULT)


def isolated_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if("suspicious").alias("suspicious"),
    )


def isolated_event(results: DataFrame) -> DataFrame:
    """The isolator's one event for a run: how many items were processed, failed and suspicious."""
    told = isolated_summary(results)
    total = F.col("processed") + F.col("failed")
    counts = ("processed", "failed", "suspicious")
    parts = [p for c in counts for p in (F.col(c).cast("string"), F.lit(f" {c}, "))]
    return told.select(
        F.lit("isolator").alias("layer"),
        F.lit("passed").alias("verdict"),
        F.rtrim(F.concat(*parts), F.lit(", ")).alias("detail"),
        F.to_json(F.struct(total.alias("total"), "suspicious")).alias("metadata"),
    )
