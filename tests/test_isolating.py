import json
import time

import pytest
from pyspark.sql import functions as F

from siftgate import OptionError
from siftgate.operators import isolating


def work(prompt):
    if "fail" in prompt:
        raise RuntimeError("no")
    if "slow" in prompt:
        time.sleep(5)
    if "odd" in prompt:
        return "not json"
    return json.dumps({"suspicious": "bad" in prompt, "n": len(prompt)})


def items(spark):
    rows = [(i, t) for i, t in enumerate(["fine", "fail", "slow", "odd", "bad", "<b>fine</b>"])]
    return spark.createDataFrame(rows[::-1], "index long, item string")


def test_failures_stay_in_their_row(spark):
    out = isolating.isolated_map(items(spark), work, parser=json.loads, timeout=1.0, template="Do: {tagged_item} {{x}}")
    rows = sorted(out.collect())
    assert [r["index"] for r in rows] == list(range(6))
    assert [r["error"] and r["error"].split(":")[0] for r in rows] == [
        None, "RuntimeError", "Timeout", "JSONDecodeError", None, None,
    ]
    assert [r["suspicious"] for r in rows] == [False, False, False, False, True, False]
    assert json.loads(rows[0]["parsed"])["n"] == json.loads(rows[5]["parsed"])["n"]
    summary = isolating.isolated_summary(out).first()
    assert (summary["processed"], summary["failed"], summary["suspicious"]) == (3, 3, 1)


def test_without_parser_nothing_is_parsed(spark):
    out = isolating.isolated_map(items(spark).where("index = 3"), work)
    row = out.first()
    assert (row["output"], row["parsed"], row["error"]) == ("not json", None, None)


def test_each_item_is_asked_once_with_its_own_label_and_source(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def note(prompt):
        with open(asked, "a") as f:
            f.write(prompt + "\n--\n")
        return "ok"

    df = spark.createDataFrame([(i, f"item {i}", f"from{i % 2}") for i in range(40)], "index long, item string, who string")
    out = isolating.isolated_map(df, note, label=F.concat(F.lit("row"), F.col("index")), source=F.col("who"))
    rows = sorted(out.collect())
    assert [r["label"] for r in rows] == [f"row{i}" for i in range(40)]
    told = open(asked).read()
    assert told.count("--\n") == 40 and told.count("from1") == 60  # opening, source and closing of twenty


def test_template_may_only_use_the_item(spark):
    with pytest.raises(OptionError):
        isolating.prompt("{other}", F.lit("x"))
