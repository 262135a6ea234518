"""Quality by hierarchical empirical Bayes: what a document shows, and what its site is known for.

A logistic classifier on properties of the text is fitted to at most ``TRAIN_DOCS`` labelled
documents (those with the least hashes; a documented bound on the sample). Its probabilities over
*all* documents are summed per host and per path of a host. Site rates are shrunk: hosts towards
the overall rate, paths towards their host, each with a prior weight estimated from how much the
groups differ (method of moments), so a site with few documents says little. The posterior odds of
a document are its site's odds, without itself, times the classifier's evidence.

Defined results: a null text counts as empty; a null host or path is a site of its own; documents
without a label are only judged; repeated labels are averaged; with no labels, or labels of one
kind only, the text says nothing and every document has the labels' rate (one half without any);
repeated rows have equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import column_text, mapped, written

TRAIN_DOCS = 20_000
RIDGE, ROUNDS = 1e-3, 25
MOST_ODDS = 12.0
KEEP = 0.5
NO_SPREAD = 1e6

FEATURES = ("log_words", "word_length", "distinct", "repeated", "common", "letters", "digits", "capitals", "marks", "odd_marks", "line_words", "lines_repeated", "marked_words", "lone_marks")
_MARK = re.compile(r"[^\w\s]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
_MARKED = re.compile(r"\w[^\w\s.,;:]{2,}(?=\s|$)")
_LONE = re.compile(r"(?:^|\s)[^\w\s]+(?=\s|$)")


def properties(text: str | None) -> list[float]:
    """The values of FEATURES; shares unless named otherwise."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    kinds = Counter(words)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    return [
        math.log1p(len(words)),
        min(40.0, sum(map(len, words)) / n),
        len(kinds) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        max(kinds.values(), default=0) / n,
        letters / size,
        len(re.findall(r"\d", text)) / size,
        sum(w.isupper() for w in words) / n,
        len(_MARK.findall(text)) / size,
        len(_ODD.findall(text)) / size,
        math.log1p(len(words) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        len(_MARKED.findall(text)) / n,
        len(_LONE.findall(text)) / n,
    ]


class Classifier:
    """Logistic regression on standardized properties and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.weights: np.ndarray | None = None
        if not len(y) or not 0 < self.rate < 1:
            return
        self.mean, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = self.expanded(x)
        weights = np.zeros(z.shape[1])
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * v[:, None]).T @ z / len(y) + RIDGE * np.eye(z.shape[1]), z.T @ (y - p) / len(y) - RIDGE * weights)
            weights += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = weights

    def expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality beyond those of the labels' rate."""
        if self.weights is None or not len(x):
            return np.zeros(len(x))
        return np.clip(self.expanded(x) @ self.weights - math.log(self.rate / (1 - self.rate)), -MOST_ODDS, MOST_ODDS)


def _rate(good: Column, n: Column, towards: Column, weight: float) -> Column:
    return (good + towards * weight) / (n + weight)


def prior_weight(sites: DataFrame) -> tuple[float, float]:
    """``(overall rate, prior weight in documents)`` of groups with columns ``good`` and ``n``."""
    good, total, squares, groups = (float(v or 0) for v in sites.agg(F.sum("good"), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.count("*")).first())
    if not total:
        return 0.5, NO_SPREAD
    mean = min(max(good / total, 1e-6), 1 - 1e-6)
    between = float(sites.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2))).first()[0])
    even = total - squares / total
    spread = (between - (groups - 1) * mean * (1 - mean)) / even if even > 0 else 0.0
    return mean, min(NO_SPREAD, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else NO_SPREAD


def classify(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``(key, evidence, site_rate, score, kept)`` of every row; ``score`` is the posterior probability of good quality."""
    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = [properties(t) for t in column_text(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], ["row_id", "key", "host", "path", "x"])

    seen = written(mapped(frame, run, f"row_id long, key {kind}, host string, path string, x array<double>"), "properties")
    told = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sample = seen.join(told, "key").orderBy(F.xxhash64("key", "row_id"), "row_id").limit(TRAIN_DOCS).select("x", "y").collect()
    classifier = Classifier(np.array([r.x for r in sample]), np.array([r.y for r in sample], float))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    base = math.log(min(max(classifier.rate, 1e-6), 1 - 1e-6) / (1 - min(max(classifier.rate, 1e-6), 1 - 1e-6)))

    def weigh(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.evidence(x))], ["row_id", "key", "host", "path", "evidence"])

    weighed = mapped(seen, weigh, f"row_id long, key {kind}, host string, path string, evidence double")
    weighed = written(weighed.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + base)))), "evidence")
    paths = written(weighed.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    mean, host_weight = prior_weight(hosts)
    _, path_weight = prior_weight(paths)
    named = hosts.select(F.col("host").alias("h"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    sites = paths.join(named, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "good", "n", "host_good", "host_n")
    joined = weighed.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    p = F.col("p")
    host_rate = _rate(F.col("host_good") - p, F.col("host_n") - 1, F.lit(mean), host_weight)
    site_rate = F.least(F.greatest(_rate(F.col("good") - p, F.col("n") - 1, host_rate, path_weight), F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("site_rate", site_rate)
    score = 1 / (1 + F.exp(-(F.log(F.col("site_rate") / (1 - F.col("site_rate"))) + F.col("evidence"))))
    return joined.select(F.col("key").alias(key), "evidence", "site_rate", score.alias("score"), (score >= KEEP).alias("kept"))
