import random
import re

from pyspark.sql import functions as F

from siftgate.operators import subwords
from siftgate.options import WindowOptions

VOCABULARY = ["un", "##believ", "##able", "##ab", "##le", "the", "t", "##h", "##e", "run", "##ning", "##n", "é", "##🙂", "s" * 60, "##" + "s" * 3]


def cut(word):
    """Longest match by hand: the pieces' ends."""
    at, ends = 0, []
    while at < len(word):
        fits = [p for p in ((v.removeprefix("##") for v in VOCABULARY if v.startswith("##") == (at > 0))) if word.startswith(p, at)]
        at += max(map(len, fits), default=1)
        ends.append(at)
    return ends


def pieces_by_hand(text):
    out = []
    for m in re.finditer(r"\S{1,100}", text):
        start = m.start()
        for end in cut(m.group()):
            out.append((start, m.start() + end))
            start = m.start() + end
    return out


def sample():
    rng = random.Random(12)
    words = ["unbelievable", "the", "running", "thee", "é🙂x", "s" * 70, "s" * 250, "zzz", "runn", "unthe"]
    return [" ".join(rng.choice(words) + rng.choice(["", " ", "\n\n"]) for _ in range(rng.choice([1, 4, 30, 120]))) + rng.choice(["", "  "]) for _ in range(60)]


def vocabulary(spark):
    return subwords.read_vocabulary(spark.createDataFrame([(v,) for v in [*VOCABULARY, "the", ""]], "value string"))


def test_pieces_as_by_hand(spark, texts):
    values = sample()
    got = {}
    for r in subwords.pieces(texts(values), vocabulary(spark)).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["end"]))
    for k, text in enumerate(values):
        assert sorted(got.get(k, [])) == [(i, *p) for i, p in enumerate(pieces_by_hand(text))]


def test_windows_as_by_hand(spark, texts):
    values = [*sample(), None, "", "  \n "]
    options = WindowOptions(model_max=22)  # 20 pieces, 5 of which overlap
    got = {}
    for r in subwords.subword_windows(texts(values), vocabulary(spark), windows=options).collect():
        got.setdefault(r["doc_id"], []).append((r["window_index"], r["n_windows"], r["text"]))
    for k, text in enumerate(values):
        if not text:
            assert k not in got
            continue
        found = pieces_by_hand(text)
        if len(found) <= 20:
            assert got[k] == [(1, 1, text)]
            continue
        n = -(-(len(found) - 20) // 15) + 1
        want = [(w + 1, n, text[found[w * 15][0] : found[min(w * 15 + 20, len(found)) - 1][1]]) for w in range(n)]
        assert sorted(got[k]) == want


def test_empty_vocabulary_cuts_characters(spark, texts):
    none = spark.createDataFrame([], "piece string, initial boolean")
    out = subwords.pieces(texts(["ab c"]), none).orderBy("piece")
    assert [(r["start"], r["end"]) for r in out.collect()] == [(0, 1), (1, 2), (3, 4)]
    assert subwords.subword_windows(texts(["ab"]).where(F.lit(False)), none).count() == 0
