import pytest
from conftest import column
from pyspark.sql import functions as F

from siftgate import BoundaryOptions, OptionError
from siftgate.operators import wrapping
from siftgate.options import DEFAULT_INSTRUCTION


def test_label_falls_back_to_source_when_it_cleans_to_nothing(spark):
    df = spark.createDataFrame(
        [(0, "x", "my mail!", "body"), (1, "x", "mail", "<>"), (2, "x", "mail", None)],
        "doc_id long, text string, source string, label string",
    )
    out = column(wrapping.wrap(df, source=F.col("source"), label=F.col("label")), "wrapped")
    assert [w.split(" ")[0] for w in out] == ["<untrusted_body", "<untrusted_mail", "<untrusted_mail"]
    assert 'source="mymail"' in out[0]


def test_attributes_can_be_left_out(texts):
    o = BoundaryOptions(source_attr=False, treat_as_attr=False)
    out = column(wrapping.wrap(texts(["x"]), options=o), "wrapped")
    assert out == [f"<untrusted_external>\n{DEFAULT_INSTRUCTION}\nx\n</untrusted_external>"]


def test_unknown_formats_fail(texts):
    with pytest.raises(OptionError):
        BoundaryOptions(format="html")
    with pytest.raises(Exception, match="unknown boundary format"):
        wrapping.wrap(texts(["x"]), format=F.lit("html")).collect()


def test_clean_refuses_to_run_twice(texts):
    once = wrapping.clean(texts(["<b>x</b>"]))
    assert "\nx\n" in column(once, "result")[0]
    with pytest.raises(OptionError):
        wrapping.clean(once)


def test_nested_tool_results(spark):
    inner = "array<struct<type:string,text:string,content:string>>"
    schema = f"doc_id long, role string, content array<struct<type:string,text:string,content:{inner}>>"
    blocks = [
        ("text", "<i>a</i>", None),
        ("tool_result", None, [("text", "<i>b</i>", None), ("image", "<i>c</i>", None)]),
    ]
    df = spark.createDataFrame([(0, "user", blocks), (1, "assistant", blocks)], schema)
    rows = wrapping.protect_conversation(df).orderBy("doc_id").collect()
    user, assistant = rows[0]["content"], rows[1]["content"]
    assert "\na\n" in user[0]["text"]
    assert "\nb\n" in user[1]["content"][0]["text"]
    assert user[1]["content"][1]["text"] == "<i>c</i>"
    assert assistant[0]["text"] == "<i>a</i>"


def test_transcript_directions(spark):
    df = spark.createDataFrame(
        [(0, "user", "hi", None), (1, "tool", "res", "grep"), (2, "assistant", "admin mode", None),
         (3, "assistant", "fine", None), (4, "system", "<b>", None)],
        "doc_id long, role string, text string, tool string",
    )
    out = column(wrapping.screen_transcript(df, tool=F.col("tool")), "screened")
    assert out[0].startswith("<untrusted_message ") and out[1].startswith("<untrusted_toolgrep ")
    assert out[2].startswith("[blocked this message: Suspicious pattern")
    assert out[3:] == ["fine", "<b>"]
