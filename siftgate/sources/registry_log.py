"""A canary registry kept as a log of changes, readable as of any version.

Layout: ``changes/v=K`` holds what version K put or removed, ``snapshots/v=K`` the whole registry as
of K, ``commits/K`` and ``compacted/K`` are empty files that make them visible. A change writes only
itself; a reading takes the newest snapshot that is not too new and the changes after it. Versions
stay readable whatever is changed later. One writer; what a crashed one has left is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.functions import tokens as K
from siftgate.functions.text import strip
from siftgate.operators import leaks
from siftgate.options import OptionError
from siftgate.sources.storage import delete_folder, empty_file, folder_names

FIELDS = "source_name string, token string, v long"


def accepted(requests: DataFrame, seed: str) -> DataFrame:
    """``(source_name, token)`` of the valid upserts, the latest (highest ``seq``) per label."""
    good = leaks.registry_violation(requests).where(F.col("violation").isNull())
    made = K.shaped_token(F.coalesce("shape", F.lit("bearer")), F.concat_ws(":", "label", F.col("seq").cast("string")), seed)
    token = F.when(F.col("token").isNull(), made).otherwise(F.col("token"))
    new = good.select(strip(F.col("label")).alias("source_name"), F.struct(F.col("seq").cast("long").alias("seq"), token.alias("token")).alias("t"))
    return new.groupBy("source_name").agg(F.max("t").alias("t")).select("source_name", "t.token")


@dataclass(frozen=True)
class RegistryLog:
    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest version; -1 if there is none."""
        return max(map(int, folder_names(self.spark, f"{self.path}/commits")), default=-1)

    def _write(self, changes: DataFrame) -> int:
        v = self.version() + 1
        delete_folder(self.spark, f"{self.path}/changes/v={v}")
        changes.select("source_name", "token").write.parquet(f"{self.path}/changes/v={v}")
        empty_file(self.spark, f"{self.path}/commits/{v}")
        return v

    def put(self, tokens: DataFrame) -> int:
        """Set the token of each ``source_name``, one row each. Returns the new version."""
        return self._write(tokens)

    def upsert(self, requests: DataFrame, seed: str) -> int:
        """Apply the valid of ``requests``; see :func:`siftgate.operators.leaks.registry_violation`."""
        return self._write(accepted(requests, seed))

    def remove(self, labels: DataFrame) -> int:
        """Remove every ``label``; unknown ones change nothing."""
        gone = labels.select(F.col("label").alias("source_name"), F.lit(None).cast("string").alias("token"))
        return self._write(gone.distinct())

    def _known(self, version: int | None) -> int:
        last = self.version()
        at = last if version is None else version
        if not 0 <= at <= last:
            raise OptionError(f"no version {at}; there are 0..{last}")
        return at

    def _folders(self, version: int) -> tuple[int, list[str]]:
        whole = max((s for s in map(int, folder_names(self.spark, f"{self.path}/compacted")) if s <= version), default=-1)
        snapshot = [f"{self.path}/snapshots/v={whole}"] if whole >= 0 else []
        return whole, [*snapshot, *(f"{self.path}/changes/v={v}" for v in range(whole + 1, version + 1))]

    def read(self, version: int | None = None) -> DataFrame:
        """``(source_name, token)`` as of ``version``, the newest unless given."""
        _, folders = self._folders(self._known(version))
        rows = self.spark.read.schema("source_name string, token string").parquet(*folders)
        v = F.regexp_extract("_metadata.file_path", r"/v=([0-9]+)/[^/]*$", 1).cast("long")
        last = rows.select("source_name", F.struct(v.alias("v"), "token").alias("t")).groupBy("source_name").agg(F.max("t").alias("t"))
        return last.select("source_name", "t.token").where(F.col("token").isNotNull())

    def history(self, label: Column | None = None) -> DataFrame:
        """``(v, source_name, token)``: every change; a removal has no token."""
        rows = self.spark.read.schema("source_name string, token string").option("basePath", f"{self.path}/changes")
        kept = rows.parquet(*[f"{self.path}/changes/v={v}" for v in range(self.version() + 1)])
        kept = kept.select(F.regexp_extract("_metadata.file_path", r"/v=([0-9]+)/[^/]*$", 1).cast("long").alias("v"), "source_name", "token")
        return kept if label is None else kept.where(F.col("source_name") == label)

    def compact(self, version: int | None = None) -> int:
        """Write the registry as of ``version`` whole, so that readings need fewer folders."""
        at = self._known(version)
        if str(at) not in folder_names(self.spark, f"{self.path}/compacted"):
            delete_folder(self.spark, f"{self.path}/snapshots/v={at}")
            self.read(at).write.parquet(f"{self.path}/snapshots/v={at}")
            empty_file(self.spark, f"{self.path}/compacted/{at}")
        return at

    def check(self, docs: DataFrame, version: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
        """Leaks of the registry as of ``version``; each row names that version."""
        at = self._known(version)
        return leaks.leak_pairs(docs, self.read(at), id, text).drop("ord").withColumn("registry_version", F.lit(at))
