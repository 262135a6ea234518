"""Windows, window scores and chain verdicts as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgate.functions.text import fixed, let, words
from siftgate.options import INJECTION_LABELS, OptionError, WindowOptions

WINDOWS_PER_CALL = 64
SCORE_TYPE = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
)


def windows(text: Column, options: WindowOptions = WindowOptions()) -> Column:
    """Overlapping token windows; the last one ends at the last token. Short text is one window."""
    window, step = options.window, options.window - options.overlap

    def cut(t: Column) -> Column:
        last = F.ceil((F.size(t) - window) / step).cast("int")
        return F.when(F.size(t) <= window, F.array(text)).otherwise(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.array_join(F.slice(t, i * step + 1, window), " "),
            )
        )

    empty = F.array().cast("array<string>")
    return F.when(text.isNotNull(), F.when(text == "", empty).otherwise(let(words(text), cut)))


@dataclass(frozen=True)
class TokenizerWindows:
    """Windows by a user tokenizer. ``load()`` runs once per Python worker and returns
    ``(encode, decode)``: text to token ids and back."""

    load: Callable[[], tuple[Callable[[str], list], Callable[[list], str]]]
    options: WindowOptions = WindowOptions()

    def windows(self, texts: Column) -> Column:
        """``ARRAY<STRING>`` -> ``ARRAY<ARRAY<STRING>>``."""
        load, size = self.load, self.options.window
        step = size - self.options.overlap

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode, decode = load()

            def cut(text: str) -> list[str]:
                ids = encode(text)
                if len(ids) <= size:
                    return [text] if text else []
                last = -(-(len(ids) - size) // step)
                return [decode(ids[i * step : i * step + size]) for i in range(last + 1)]

            for batch in batches:
                rows = [None if r is None else [cut(t) for t in r] for r in batch.to_pylist()]
                yield pa.array(rows, type=pa.list_(pa.list_(pa.string())))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, T.ArrayType(T.ArrayType(T.StringType())))(texts)


@dataclass(frozen=True)
class Detector:
    """A named window scorer with a blocking rule. Subclasses say how windows are scored."""

    name: str
    threshold: float = 0.9
    labels: tuple[str, ...] = INJECTION_LABELS

    def scores(self, windows: Column) -> Column:
        """``ARRAY<STRING>`` -> ``ARRAY<STRUCT<label, score>>`` (null in, null out)."""
        raise NotImplementedError


@dataclass(frozen=True)
class LexicalDetector(Detector):
    """Deterministic default: the heaviest cue phrase found in a window names its label."""

    cues: tuple[tuple[str, str, float], ...] = ()

    def scores(self, windows: Column) -> Column:
        ranked = sorted(self.cues, key=lambda cue: -cue[2])

        def score(low: Column) -> Column:
            safe = F.struct(F.lit("SAFE").alias("label"), F.lit(0.99).alias("score"))
            out = None
            for phrase, label, weight in ranked:
                value = F.struct(F.lit(label).alias("label"), F.lit(float(weight)).alias("score"))
                hit = F.contains(low, F.lit(phrase))
                out = F.when(hit, value) if out is None else out.when(hit, value)
            return safe if out is None else out.otherwise(safe)

        return F.transform(windows, lambda w: let(F.lower(w), score))


@dataclass(frozen=True)
class ModelDetector(Detector):
    """User model: ``load()`` runs once per Python worker and returns
    ``list[str] -> list[(label, score)]``; it is called with at most 64 windows at a time, filled
    across documents of the Arrow batch."""

    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]] = field(default=None)

    def scores(self, windows: Column) -> Column:
        if self.load is None:
            raise OptionError(f"detector {self.name!r} has no model loader")
        load = self.load
        arrow_type = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                windows, labels, scores = batch.flatten(), [], []
                for at in range(0, len(windows), WINDOWS_PER_CALL):
                    asked = windows.slice(at, WINDOWS_PER_CALL).to_pylist()
                    told = list(model(asked))
                    if len(told) != len(asked):
                        raise ValueError(f"the model gave {len(told)} scores for {len(asked)} windows")
                    labels += [label for label, _ in told]
                    scores += [float(score) for _, score in told]
                out, at = [], 0
                for size in batch.value_lengths().to_pylist():
                    row = slice(at, at + (size or 0))
                    out.append(None if size is None else [{"label": x, "score": y} for x, y in zip(labels[row], scores[row])])
                    at = row.stop
                yield pa.array(out, type=arrow_type)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, SCORE_TYPE)(windows)


# --- the default chain: cheap, exact and repeatable --------------------------------------------
OVERRIDE_CUES = (
    ("ignore all previous instructions", "INJECTION", 0.98),
    ("ignore previous instructions", "INJECTION", 0.97),
    ("disregard your instructions", "INJECTION", 0.95),
    ("you are now", "JAILBREAK", 0.93),
    ("admin mode", "JAILBREAK", 0.91),
    ("system prompt", "INJECTION", 0.6),
    ("new instructions", "INJECTION", 0.5),
)
TOOL_CUES = (
    ("tool_call", "INJECTION", 0.96),
    ("function_call", "INJECTION", 0.95),
    ("</untrusted_", "INJECTION", 0.94),
    ("<system", "INJECTION", 0.92),
    ("send all", "INJECTION", 0.55),
)
OVERRIDE = LexicalDetector("detection:override", cues=OVERRIDE_CUES)
TOOLS = LexicalDetector("detection:tools", cues=TOOL_CUES)
DEFAULT_CHAIN = (OVERRIDE, TOOLS)


def verdict(scores: Column, detector: Detector) -> Column:
    """Reduce one text's window scores.

    Blocks at the *first* window over the threshold (its score, not the highest, is reported);
    otherwise reports the strongest injection-class score, 0 when no window has such a label.
    """
    labels = [F.lit(x) for x in detector.labels]

    def reduce(s: Column) -> Column:
        numbered = F.transform(
            s,
            lambda x, i: F.struct(
                x["score"].alias("score"), (-i).alias("back"), x["label"].alias("label")
            ),
        )
        hit = F.get(
            F.filter(
                numbered,
                lambda x: x["label"].isin(*labels) & (x["score"] >= detector.threshold),
            ),
            F.lit(0),
        )

        def assemble(h: Column) -> Column:
            strongest = F.array_max(
                F.transform(
                    F.filter(s, lambda x: x["label"].isin(*labels)), lambda x: x["score"]
                )
            )
            return F.struct(
                h.isNotNull().alias("blocked"),
                (F.lit(1) - h["back"]).alias("window_index"),
                h["label"].alias("label"),
                F.coalesce(h["score"], strongest, F.lit(0.0)).alias("max_score"),
                F.size(s).alias("n_windows"),
                F.array_max(numbered)["label"].alias("top_label"),
            )

        return let(hit, assemble)

    return let(scores, lambda s: F.when(s.isNotNull(), reduce(s)))


def block_reason(detector: str | Column, label, score, window_index, n_windows) -> Column:
    name = F.lit(detector) if isinstance(detector, str) else detector
    where = F.concat(
        F.lit(" in window "), window_index.cast("string"), F.lit("/"), n_windows.cast("string")
    )
    return F.concat(
        F.lit("Prompt injection detected ("),
        fixed(score, 3),
        F.lit(", "),
        label,
        F.lit(") by "),
        name,
        F.when(n_windows > 1, where).otherwise(""),
    )
