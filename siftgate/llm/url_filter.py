"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule is a host with a path prefix; it fits that host and its subdomains, and the longest fitting
rule decides. URLs that rules decide are the labelled ones: trees are trained on at most
``TRAIN_ROWS`` of them (those with the least hashes; a documented bound on the sample, everything
else covers all rows) and decide the rest. Features: lengths, depth, digit and hyphen shares, entropy of the characters,
parameter counts, labels of the host, and how often the labelled URLs of the same host suffix were
blocked, shrunk towards the overall share (counted over all labelled URLs).

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is
judged by its features (a null as an empty string); where the labels hold a single verdict that is
everyone's, and without labels every URL is allowed; repeated rows have equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import written

TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 4
SHRINK = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "digits", "hyphens", "entropy", "parameters", "fragment", "secure", "labels", "suffix_blocked", "suffix_seen")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (a short list, part of the plan), or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _features(df: DataFrame) -> DataFrame:
    """``df`` (with ``url, host, path``) and its lexical features, and the host's suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    letters = F.split(url, "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters))
    return df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "query_length": F.length(query).cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digits": F.regexp_count(url, F.lit("[0-9]")) / size,
            "hyphens": F.regexp_count("host", F.lit("[-_]")).cast("double"),
            "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
            "parameters": F.regexp_count(query, F.lit("[^&=]+=")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": F.startswith(F.lower(url), F.lit("https")).cast("double"),
            "labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
            "suffix": F.regexp_extract("host", "[^.]*$", 0),
        }
    )


def judge(urls: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """``(key, host, path, rule, verdict, blocked_odds)``: the rule's verdict or else the trees'; odds are null where a rule decides."""
    host, path = split(F.col("url"))
    held = urls.select(F.col(key).alias("key"), F.col(url).alias("url"))
    held = held.withColumns({"host": host, "path": path})
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    held = _features(held.withColumns({"rule": name, "ruled": verdict}))
    labelled = held.where("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    blocked, seen = labelled.agg(F.sum("label"), F.count("*")).first()
    if not seen or blocked in (0, seen):
        only = "block" if seen and blocked == seen else "allow"
        return held.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("blocked_odds"))
    share = blocked / seen
    suffixes = labelled.groupBy("suffix").agg(F.sum("label").alias("suffix_bad"), F.count("*").alias("suffix_n"))

    def with_suffix(df: DataFrame, own: Column) -> DataFrame:
        """Suffix statistics, without the row's own label where it has one."""
        n, bad = F.coalesce("suffix_n", F.lit(0)) - own.isNotNull().cast("int"), F.coalesce("suffix_bad", F.lit(0.0)) - F.coalesce(own, F.lit(0.0))
        joined = df.join(suffixes, "suffix", "left")
        return joined.withColumns({"suffix_blocked": (bad + SHRINK * share) / (n + SHRINK), "suffix_seen": F.log2(n + F.lit(1.0))})

    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    chosen = labelled.orderBy(F.xxhash64("url"), "key").limit(TRAIN_ROWS)
    sample = written(vectors.transform(with_suffix(chosen, F.col("label"))).select("label", vector_to_array("features").alias("values"), "url", "key"), "url-sample")
    ordered = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.select("label", *[F.col("values")[k].alias(c) for k, c in enumerate(FEATURES)])).coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=7).fit(ordered.select("label", "features"))
    told = model.transform(vectors.transform(with_suffix(held, F.lit(None).cast("double"))))
    odds = vector_to_array("rawPrediction")[1]
    return told.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("prediction") == 1, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), odds).alias("blocked_odds"),
    )
