import random

from pyspark.sql import functions as F

from siftgate.functions.text import fixed, strip, words
from rowref import random_texts


def test_fixed_matches_python_formatting(spark):
    rng = random.Random(5)
    values = [k / 8 for k in range(800)] + [k / 200 for k in range(200)]
    values += [rng.random() * 100 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(fixed(F.col("x"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_words_and_strip_match_python(spark, texts):
    values = random_texts(300, seed=11)
    df = texts(values).select("doc_id", words(F.col("text")).alias("w"), strip(F.col("text")).alias("s"))
    rows = df.orderBy("doc_id").collect()
    assert [r["w"] for r in rows] == [v.split() for v in values]
    assert [r["s"] for r in rows] == [v.strip() for v in values]
