"""Window scores that are made once.

A score depends on the window's text, the detector and its version, on nothing else. The store
holds them by the digest of the text, in folders by detector and version; a run scores each text
that is new to the store once, however often the run repeats it, and everything else is a join of
digests. Texts travel once, to be made distinct; the table of windows is joined without them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.functions.detecting import DEFAULT_CHAIN, Detector
from siftgate.operators.layout import settle
from siftgate.options import OptionError
from siftgate.sources.storage import folder_names


@dataclass(frozen=True)
class ScoreStore:
    spark: SparkSession
    path: str

    def folder(self, detector: str, version: str) -> str:
        name = f"{detector}@{version}"
        if "/" in name:
            raise OptionError(f"{name!r} is no folder name")
        return f"{self.path}/{name.replace(':', '.')}"

    def known(self, detector: str, version: str) -> DataFrame:
        """``(digest, label, score)``, one row per digest."""
        schema = "digest binary, label string, score double"
        if not folder_names(self.spark, self.folder(detector, version)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.folder(detector, version))
        # two runs at a time may both have scored a text
        return rows.groupBy("digest").agg(F.max(F.struct("label", "score")).alias("s")).select("digest", "s.*")

    def add(self, texts: DataFrame, detector: Detector, version: str, text: str = "text") -> None:
        """Score what the store does not hold yet."""
        own = texts.where(F.col(text).isNotNull()).select(_digest(text), F.col(text).alias("_text"))
        new = own.join(self.known(detector.name, version).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
        scored = settle(new.withColumn("_s", F.get(detector.scores(F.array("_text")), F.lit(0))), "_s")
        scored.select("digest", "_s.label", "_s.score").write.mode("append").parquet(self.folder(detector.name, version))


def _digest(text: str):
    return F.unhex(F.sha2(F.col(text), 256)).alias("digest")


def score_once(
    windows: DataFrame, store: ScoreStore, versions: Mapping[str, str], detectors: Sequence[Detector] = DEFAULT_CHAIN, text: str = "text"
) -> DataFrame:
    """The long score table of :func:`siftgate.operators.detecting.score_windows`, by way of the store.

    ``versions`` says which version of each detector runs. Rows without text have no score.
    """
    lacking = [d.name for d in detectors if d.name not in versions]
    if lacking:
        raise OptionError(f"no version given for {', '.join(lacking)}")
    keep = [c for c in windows.columns if c != text]
    rows = windows.select(*keep, _digest(text))
    out = None
    for i, d in enumerate(detectors):
        store.add(windows, d, versions[d.name], text)
        scores = store.known(d.name, versions[d.name])
        one = rows.join(scores, "digest", "left").select(*keep, F.lit(i).alias("detector_index"), F.lit(d.name).alias("detector_name"), "label", "score")
        out = one if out is None else out.unionByName(one)
    return out
