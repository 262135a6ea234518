import pytest
from conftest import column
from rowref import clean, random_texts

from siftgate import OptionError, SanitizeOptions
from siftgate.functions import cleaning
from siftgate.functions.text import TextTypeError
from siftgate.operators import sanitizing


def test_random_texts_match_row_reference(spark, texts):
    values = random_texts(400)
    df = texts(values)
    assert column(sanitizing.sanitize(df), "cleaned") == [clean(v) for v in values]
    options = SanitizeOptions(max_length=7, decode_encodings=True)
    got = column(sanitizing.sanitize(df, options=options), "cleaned")
    assert got == [clean(v, 7, decode=True) for v in values]


def test_nfkc_after_decoding(spark, texts):
    values = random_texts(200, seed=3)
    options = SanitizeOptions(max_length=None, decode_encodings=True, nfkc=True)
    got = column(sanitizing.sanitize(texts(values), options=options), "cleaned")
    assert got == [clean(v, None, decode=True, nfkc=True) for v in values]


def test_null_and_empty(texts):
    rows = sanitizing.sanitize(texts([None, "", "\u200b", " \n "])).orderBy("doc_id").collect()
    assert [r["cleaned"] for r in rows] == [None, "", "", ""]
    assert [r["verdict"] for r in rows] == [None, "passed", "modified", "modified"]


def test_unclosed_tags_stay_cheap(texts):
    text = "<" * 100_000 + "a>b" + "<" * 100_000
    got = column(sanitizing.sanitize(texts([text])), "cleaned")
    assert got == [clean(text)]


def test_switched_off_steps_leave_the_plan(texts):
    off = SanitizeOptions(
        zero_width=False, scripts=False, html=False, css_hidden=False, control_chars=False,
        bidi=False, emoji_smuggling=False, collapse_whitespace=False, max_length=None,
    )
    df = sanitizing.with_cleaned(texts(["<b>a</b>\u200b  b "]), "text", "c", off)
    assert column(df, "c") == ["<b>a</b>\u200b  b"]
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_custom_patterns_run_in_order_and_fail_early(texts):
    options = SanitizeOptions(custom_patterns=("b+", "ac"))
    assert column(sanitizing.sanitize(texts(["abbc!"]), options=options), "cleaned") == ["!"]
    with pytest.raises(OptionError):
        SanitizeOptions(custom_patterns=("(",))


def test_text_column_must_be_string(spark):
    df = spark.range(3).withColumnRenamed("id", "text")
    with pytest.raises(TextTypeError):
        sanitizing.sanitize(df)


def test_filter_on_a_result_does_not_clean_twice(texts):
    plan = sanitizing.sanitize(texts(["a"])).where("modified")
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count(cleaning.TAG) == 1


def test_decoding_sends_only_candidates_to_python(spark, texts):
    df = texts(["plain", "a&lt;b", "%41", "&amp;amp;lt;"])
    from pyspark.sql import functions as F

    got = column(df.select("doc_id", cleaning.decode_encodings(F.col("text")).alias("d")), "d")
    assert got == ["plain", "a<b", "A", "<"]
