import pytest
from pyspark.sql import functions as F

from siftgate import OptionError
from siftgate.functions.detecting import LexicalDetector, ModelDetector
from siftgate.operators.scoring import ScoreStore, score_once
from siftgate.sources.registry_log import RegistryLog
from siftgate.sources.storage import folder_names


class Counted:
    """A model that notes every text it is asked about."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        path = self.path

        def model(texts):
            with open(path, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [("INJECTION" if "bad" in t else "SAFE", len(t) / 100) for t in texts]

        return model


def test_the_model_sees_each_text_once(spark, tmp_path):
    seen = tmp_path / "seen"
    model = ModelDetector("detection:m", load=Counted(str(seen)))
    plain = LexicalDetector("detection:l", cues=(("bad", "INJECTION", 0.95),))
    store, versions = ScoreStore(spark, str(tmp_path / "scores")), {"detection:m": "1", "detection:l": "1"}

    def windows(texts):
        return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, window_index int, text string").repartition(3)

    first, second = ["same"] * 40 + ["bad one", "", None], ["same"] * 5 + ["bad one", "new", "new"]
    for texts, asked in ((first, ["", "bad one", "same"]), (second, ["new"]), (second, [])):
        seen.write_text("")
        got = score_once(windows(texts), store, versions, [model, plain]).collect()
        assert len(got) == 2 * len(texts)
        for r in got:
            text = texts[r["doc_id"]]
            if text is None:
                assert r["label"] is None
            elif r["detector_index"] == 1:
                assert r["label"] == ("INJECTION" if "bad" in text else "SAFE")
            else:
                assert (r["label"], r["score"]) == ("INJECTION" if "bad" in text else "SAFE", len(text) / 100)
        with open(seen) as f:
            assert sorted(f.read().splitlines()) == asked
    seen.write_text("")
    score_once(windows(["same"]), store, {"detection:m": "2"}, [model]).collect()
    assert seen.read_text() == "same\n"  # another version scores anew
    with pytest.raises(OptionError):
        score_once(windows(["same"]), store, {}, [model])


def test_no_text_travels_with_the_windows(spark, tmp_path):
    model = LexicalDetector("detection:l", cues=())
    store = ScoreStore(spark, str(tmp_path / "scores"))
    windows = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    plan = score_once(windows, store, {"detection:l": "1"}, [model])._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "LeftOuter" in joined.splitlines()[0] and "text" not in joined.split("unhex")[0]


def tokens(spark, rows):
    return spark.createDataFrame(rows, "source_name string, token string")


def asked(spark, rows):
    return spark.createDataFrame(rows, "seq long, label string, token string, shape string")


def test_versions_stay_readable(spark, tmp_path):
    log = RegistryLog(spark, str(tmp_path / "r"))
    with pytest.raises(OptionError):
        log.read()
    states = {}

    def note(v):
        states[v] = {r["source_name"]: r["token"] for r in log.read(v).collect()}

    note(log.put(tokens(spark, [("a", "first-token"), ("b", "other-token")])))
    note(log.upsert(asked(spark, [(1, "a", "too old-one", None), (2, "a", "newer-token", None), (3, "x y", "refused-token", None), (4, "c", None, "aws")]), "seed"))
    note(log.remove(spark.createDataFrame([("b",), ("nobody",), ("b",)], "label string")))
    assert states[0] == {"a": "first-token", "b": "other-token"}
    assert states[1] == states[0] | {"a": "newer-token", "c": states[1]["c"]} and states[1]["c"].startswith("AKIA")
    assert states[2] == {k: v for k, v in states[1].items() if k != "b"}
    assert [spark.read.parquet(f"{log.path}/changes/v={v}").count() for v in range(3)] == [2, 2, 2]  # changes, not registries
    assert log.compact(1) == 1 and log.compact(1) == 1
    note(log.upsert(asked(spark, [(9, "b", "b is back", None)]), "seed"))
    assert states[3] == states[2] | {"b": "b is back"}
    log.compact()
    for v in range(4):
        assert {r["source_name"]: r["token"] for r in log.read(v).collect()} == states[v]
    assert log._folders(3)[1] == [f"{log.path}/snapshots/v=3"] and len(log._folders(2)[1]) == 2
    assert sorted((r["v"], r["token"]) for r in log.history(F.lit("b")).collect() if r["token"]) == [(0, "other-token"), (3, "b is back")]
    for bad in (-1, 4):
        with pytest.raises(OptionError):
            log.read(bad)


def test_a_check_names_its_version_and_a_crashed_change_is_replaced(spark, texts, tmp_path):
    log = RegistryLog(spark, str(tmp_path / "r"))
    log.put(tokens(spark, [("a", "first-token")]))
    log.put(tokens(spark, [("a", "second-token")]))
    tokens(spark, [("a", "half-written")]).write.parquet(f"{log.path}/changes/v=2")
    docs = texts(["has first-token", "has SECOND-TOKEN", None])
    assert [(r["doc_id"], r["kind"], r["registry_version"]) for r in log.check(docs, 0).collect()] == [(0, "exact", 0)]
    assert [(r["doc_id"], r["kind"], r["registry_version"]) for r in log.check(docs).collect()] == [(1, "casefold", 1)]
    assert log.put(tokens(spark, [("b", "third-token")])) == 2
    assert {r["source_name"] for r in log.read().collect()} == {"a", "b"} and folder_names(spark, f"{log.path}/commits") == ["0", "1", "2"]
