"""Language identification as a mixture: which languages, in which proportions, made this text?

A language is a distribution over byte trigrams of lower-cased words, hashed to ``BINS`` bins and
counted over all learning documents. For a document, expectation-maximisation finds the proportions
under which its trigrams are likeliest. Languages enter the set one by one while the gain in
likelihood exceeds a penalty of ``PENALTY * log(trigrams)``; the largest proportion names the text.

The counts (languages times bins, whatever the size of the corpus) are the only thing that reaches
the driver. Defined results: texts that are null or hold no letter are ``und`` with score 0, and so
is everything if no document could be learned from; documents with a null language are not learned
from; repeated documents count as often as they occur and have equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import column_text, mapped

BITS = 16
BINS = 1 << BITS
SMOOTHING = 0.5
PENALTY = 4.0
ROUNDS, SETTLED = 60, 1e-3
UNKNOWN = "und"

_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray | None:
    """Hashed bins of all trigrams of the words, with a space on either side; None without a letter."""
    if not text:
        return None
    words = text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    if not words or (all(w[0] >= 128 for w in words) and not any(c.isalpha() for c in text)):
        return None
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    codes = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass
class Mixture:
    languages: list[str]
    proportions: list[float]
    #: Mean log-likelihood of a trigram above that of evenly spread bins.
    above_chance: float


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        totals = counts.sum(axis=1, keepdims=True)
        self.p = ((counts + SMOOTHING) / (totals + SMOOTHING * BINS)).T.astype(np.float64).copy()
        self.log_p = np.log(self.p)

    def fit(self, p: np.ndarray, counts: np.ndarray, n: float) -> tuple[np.ndarray, float]:
        """Proportions of the languages in ``p``'s columns, and the log-likelihood."""
        shares = np.full(p.shape[1], 1.0 / p.shape[1])
        for _ in range(ROUNDS):
            new = shares * ((counts / (p @ shares)) @ p) / n
            if np.abs(new - shares).max() < SETTLED:
                shares = new
                break
            shares = new
        return shares, float(counts @ np.log(p @ shares))

    def explain(self, bins: np.ndarray) -> Mixture:
        kinds, counts = np.unique(bins, return_counts=True)
        counts, n = counts.astype(np.float64), float(len(bins))
        p = self.p[kinds]
        alone = counts @ self.log_p[kinds]
        chosen, shares, best = [int(alone.argmax())], np.ones(1), float(alone.max())
        if len(self.languages) > 1:
            every, _ = self.fit(p, counts, n)
            for k in np.argsort(-every, kind="stable").tolist():
                if k in chosen or every[k] < SETTLED:
                    continue
                more, likelihood = self.fit(p[:, [*chosen, k]], counts, n)
                if likelihood - best <= PENALTY * np.log(n + 1):
                    break
                chosen, shares, best = [*chosen, k], more, likelihood
        order = sorted(range(len(chosen)), key=lambda i: (-shares[i], self.languages[chosen[i]]))
        return Mixture([self.languages[chosen[i]] for i in order], [min(1.0, float(shares[i])) for i in order], best / n + BITS * np.log(2.0))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model | None:
    """Count trigrams per language over all of ``docs``; None if there is nothing to learn."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name, body in zip(names, column_text(batch, "text")):
                bins = trigrams(body)
                if bins is not None:
                    if name not in totals:
                        totals[name] = np.zeros(BINS, np.int64)
                    totals[name] += np.bincount(bins, minlength=BINS)
        for name, counts in totals.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(counts[bins])], ["lang", "bin", "n"])

    told = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = mapped(told, run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    if not names:
        return None
    at = {name: k for k, name in enumerate(names)}
    dense = np.zeros((len(names), BINS))
    dense[[at[x] for x in counts.column("lang").to_pylist()], counts.column("bin").to_numpy()] = counts.column("n").to_numpy()
    return Model(names, dense)


def held_out(key: str, parts: int, part: int):
    """Whether the CRC-32 of the key as text leaves ``part``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, model: Model | None, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred``, ``score`` (its proportion), ``languages`` and ``proportions`` of the chosen set, and ``above_chance``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col(text).alias("__text"))
    schema = frame.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("languages"), F.array().cast("array<double>").alias("proportions"), F.lit(0.0).alias("above_chance")).schema

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [_explained(model, body) for body in column_text(batch, "__text")]
            columns = [
                pa.array([m.languages[0] for m in found], pa.string()),
                pa.array([m.proportions[0] for m in found], pa.float64()),
                pa.array([m.languages for m in found], pa.list_(pa.string())),
                pa.array([m.proportions for m in found], pa.list_(pa.float64())),
                pa.array([m.above_chance for m in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return mapped(frame, run, schema)


def _explained(model: Model | None, body: str | None) -> Mixture:
    bins = trigrams(body) if model else None
    return Mixture([UNKNOWN], [0.0], 0.0) if bins is None else model.explain(bins)


def known_only(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language: those that are null or hold no letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [_explained(model, body) for body in column_text(batch, text)]
            yield batch.filter(pa.array([m.languages[0] != UNKNOWN for m in found], pa.bool_()))

    return mapped(docs, run, docs.schema)
