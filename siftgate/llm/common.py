"""What the operators share: byte-wise words, row-wise Arrow maps, written intermediate tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgate.sources.storage import scratch, ship

#: Lower-cases A-Z and nothing else; every byte of a longer UTF-8 sequence stays as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and turns every ASCII character that is neither a letter nor a digit into a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
STEP = 256


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of anything but ASCII white space."""
    return text.translate(LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends, lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_as(df: DataFrame, path: str) -> DataFrame:
    """As :func:`written`, to a folder the caller has named with ``scratch`` and will drop."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A row's number in its part lies below this bit of ``monotonically_increasing_id``, the part above.
_PART = 33


def ranked(df: DataFrame, by: list, name: str) -> DataFrame:
    """The rows with ``part`` and ``position``, their place (from 0) in the ascending order of ``by``, nulls first.

    Rows equal in ``by`` come in any order, and their number in the table is the last key of the
    range partitions: a value that many rows share is dealt to many parts, and no task sorts more
    than its share. The one window over everything has a row per part. ``df`` should be a written
    table; the ordered rows are written, so positions stay what they are if executors are lost.
    """
    tie = F.monotonically_increasing_id()
    ordered = df.withColumn("_tie", tie).repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie")
    rows = written(ordered.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("_at", _PART))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PART) - 1))
    return rows.join(before, "part").withColumn("position", position).drop("_at", "_before")


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about ``most`` bytes in column ``name``; a longer value has a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > at and held + n > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def column_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """A string column's values as UTF-8 bytes, few at a time."""
    col = batch.column(name)
    for at in range(0, len(col), STEP):
        yield from col.slice(at, STEP).cast(pa.binary()).to_pylist()


def column_text(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    col = batch.column(name)
    for at in range(0, len(col), STEP):
        yield from col.slice(at, STEP).to_pylist()


def mapped(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(batches, schema)


_AMBIGUOUS = re.compile(r" (?:[\s᠎]|$)")
_BEFORE_WORD = re.compile(r" (?=[^\s᠎])")


def units(text: str) -> tuple[str, list[str]]:
    """Cut ``text`` at each space that a non-space follows: the first stretch, and the others without their space.

    The pre-tokenization patterns of the public byte-level vocabularies always begin a new piece
    there, so each stretch can be encoded alone (the others with their space) and the ids joined.
    """
    first, *rest = _BEFORE_WORD.split(text) if _AMBIGUOUS.search(text) else text.split(" ")
    return first, rest


class Recent(dict):
    """A dict of at most ``2 * size`` recent entries: when full, the older half is let go."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def put(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def find(self, key):
        """A hit among the older entries is made recent again."""
        value = self.old.get(key)
        return None if value is None else self.put(key, value)
