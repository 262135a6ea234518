"""Plan layout: where costly columns are computed, and how rows meet cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Compute ``columns`` here, once per row.

    The optimizer pushes a filter below a projection by copying the filtered column's expression
    into the filter, and copies it again wherever it is used. For columns that cost a scan of the
    text (cleaned text, hits, ledgers) that multiplies the whole job. Passing them through a
    one-row generator stops the copying: predicates on generated columns stay above it.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a large table in few files to all cores, by a hash of ``key``; other tables stay as they are.

    A Parquet file is read by at most one task per row group, however many splits it has, and a map
    over the texts keeps these tasks. Only for costly maps: the columns they use are shuffled once.
    The files of a stream are known batch by batch only, so its rows are always dealt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df.repartition(4 * cores, key)
    splits = df.rdd.getNumPartitions()
    if splits == 1 or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(4 * max(cores, splits), key)
