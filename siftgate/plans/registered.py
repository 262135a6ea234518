"""All registered queries, by area."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType

from siftgate.plans import detection, evaluation, event_store, leaks, logs, stores, texts
from siftgate.sources.storage import ship

PLANS = (
    stores.PLAN,
    texts.PLAN,
    leaks.PLAN,
    detection.PLAN,
    evaluation.PLAN,
    logs.PLAN,
    event_store.PLAN,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(run) for plan in PLANS for name, run in plan.queries.items()}


def _shipped(run: Callable) -> Callable:
    """Python workers import this package too, wherever the driver was started."""

    @functools.wraps(run)
    def go(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        out = run(spark, sf)
        # SQL counts and lengths are 64-bit: report the same width
        narrow = [f.name for f in out.schema.fields if isinstance(f.dataType, IntegerType)]
        return out.withColumns({c: out[c].cast("long") for c in narrow}) if narrow else out

    return go


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for plan in PLANS:
        out.update(plan.sql)
    return out
