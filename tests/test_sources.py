import json

import pytest
from pyspark.sql import functions as F

from siftgate import OptionError
from siftgate.functions.text import TextTypeError
from siftgate.operators import splitting
from siftgate.sources import corpora


def write_lines(path, lines):
    path.write_text("\n".join(lines))
    return str(path)


def good(id):
    return json.dumps({"id": id, "category": "c", "subject": "s", "body": "b\nb"})


def test_benign_corpus(spark, tmp_path):
    path = write_lines(tmp_path / "ok.jsonl", [good("1"), "", "# note", "   ", good("2")])
    rows = corpora.load_benign(spark, path).orderBy("id").collect()
    assert [r["text"] for r in rows] == ["Subject: s\n\nb\nb"] * 2
    for lines, problem in (
        ([good("1"), good("1")], "duplicate id"),
        ([good("1"), '{"id": "2"}'], "missing field"),
        ([good("1"), "{bad"], "invalid JSON"),
        (["# only a note"], "empty"),
    ):
        with pytest.raises(corpora.CorpusError, match=problem):
            corpora.load_benign(spark, write_lines(tmp_path / "bad.jsonl", lines))


def test_corpus_reader_checks_type(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "text").write.parquet(str(tmp_path / "n"))
    with pytest.raises(TextTypeError):
        corpora.read_corpus(spark, str(tmp_path / "n"))
    with pytest.raises(OptionError):
        corpora.read_corpus(spark, "x", format="xlsx")
    lines = write_lines(tmp_path / "t.txt", ["a", "b"])
    assert corpora.read_corpus(spark, lines, format="text").columns == ["text"]


def test_admission_counts_bytes(texts):
    rows = corpora.admission(texts(["é" * 5, "e" * 9]), cap=9).orderBy("doc_id").collect()
    assert [r["refusal"] for r in rows] == ["content_too_large", None]


def test_registry_files(spark, tmp_path):
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"a": "token-a", "b": "token-b"}, indent=2))
    rows = corpora.load_registry(spark, str(one), whole_file=True).orderBy("ord").collect()
    assert [(r["source_name"], r["token"]) for r in rows] == [("a", "token-a"), ("b", "token-b")]
    corpora.save_registry(corpora.load_registry(spark, str(one), whole_file=True), str(tmp_path / "many"))
    again = corpora.load_registry(spark, str(tmp_path / "many"))
    assert {r["source_name"] for r in again.collect()} == {"a", "b"}


def test_scan_reports(spark, tmp_path):
    path = write_lines(tmp_path / "r.jsonl", [
        '{"entry_type": "init"}', "{bad",
        '{"entry_type": "attempt", "status": 1, "probe": "p"}',
        '{"entry_type": "attempt", "status": 2, "outputs": []}',
        '{"entry_type": "attempt", "status": 2, "probe": "p", "outputs": ["x", "y"], "passed": true, "score": 1}',
    ])
    rows = corpora.read_scan_report(spark, path).orderBy("probe").collect()
    assert [(r["probe"], r["output"], r["passed"], r["score"]) for r in rows] == [
        ("p", "x", True, 1.0), ("unknown", "", False, 0.0),
    ]


def test_envelopes(spark):
    lines = spark.createDataFrame(
        [('{"events": [{"layer": "a", "timestamp": 1.5}, {"layer": "b"}]}',), ('{"events": []}',), ("{}",), ("bad",)],
        "value string",
    )
    assert sorted(r["layer"] for r in corpora.parse_envelopes(lines).collect()) == ["a", "b"]


def test_store_replaces_only_what_it_writes(spark, tmp_path):
    store = str(tmp_path / "store")
    configs = spark.createDataFrame([("a",), ("b",)], "config_slug string")
    assert corpora.pending_configs(configs, store).count() == 2
    corpora.store_results(spark.createDataFrame([(1, "a")], "x long, config_slug string"), store)
    assert [r[0] for r in corpora.pending_configs(configs, store).collect()] == ["b"]
    corpora.store_results(spark.createDataFrame([(2, "b")], "x long, config_slug string"), store)
    corpora.store_results(spark.createDataFrame([(3, "a")], "x long, config_slug string"), store)
    rows = spark.read.parquet(store).select("config_slug", "x").collect()
    assert sorted(map(tuple, rows)) == [("a", 3), ("b", 2)]


def refuse_twos(body):
    if any(e["id"] == 2 for e in body["events"]):
        raise OSError("no")


def test_posting_counts_failures(spark):
    events = spark.range(6)
    one = corpora.post_events(events, refuse_twos, batch_size=1).collect()
    assert [(r["events"], r["error"]) for r in one] == [(1, "OSError: no")]
    all_at_once = corpora.post_events(events, refuse_twos, batch_size=100, partitions=1).collect()
    assert [r["events"] for r in all_at_once] == [6]
    again = corpora.post_events(events, refuse_twos, batch_size=100, partitions=1).collect()
    assert all_at_once == again  # a chunk keeps its id


def test_probe_payloads(spark):
    schema = "name string, active boolean, prompts array<struct<text:string,turns:array<struct<text:string>>>>"
    df = spark.createDataFrame(
        [("probes.dan.Dan", True, [("plain", None), (None, [("one",), ("two",)]), (None, None), (None, [])])], schema
    )
    rows = corpora.probe_payloads(df).orderBy("index").collect()
    assert [(r["family"], r["class"], r["index"], r["payload"]) for r in rows] == [
        ("dan", "Dan", 0, "plain"), ("dan", "Dan", 1, "two"),
    ]


@pytest.mark.parametrize("target", [1, 5, 6, 7, 13, 100])
def test_filler_repeats_paragraphs_until_long_enough(spark, target):
    paragraphs = ["a b c", "d", "e f"]
    want, n, i = [], 0, 0
    while n < target:
        want.append(paragraphs[i % 3])
        n += len(paragraphs[i % 3].split())
        i += 1
    df = spark.createDataFrame([(paragraphs,)], "p array<string>")
    assert df.select(splitting.filler(F.col("p"), target)).first()[0] == " ".join(want)
    none = spark.createDataFrame([([" "],)], "p array<string>")
    assert none.select(splitting.filler(F.col("p"), target)).first()[0] is None
