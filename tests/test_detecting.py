import pytest
from conftest import column
from pyspark.sql import functions as F
from rowref import windows as row_windows

from siftgate import DecodeOptions, OptionError, WindowOptions
from siftgate.functions import detecting as X
from siftgate.operators import decoding as rescans
from siftgate.operators import detecting as chain

SMALL = WindowOptions(model_max=10)
TRIGGER = X.LexicalDetector("detection:trigger", cues=(("boom", "INJECTION", 0.99), ("hiss", "INJECTION", 0.6)))


@pytest.mark.parametrize("model_max", [5, 10, 40, 512])
def test_windows_match_the_row_loop(texts, model_max):
    values = [" ".join(f"w{i}" for i in range(n)) for n in (*range(1, 40), 509, 510, 511, 956, 957, 2000)]
    values += ["", " ", "\t a \n b c "]
    got = column(
        texts(values).select("doc_id", X.windows(F.col("text"), WindowOptions(model_max)).alias("w")), "w"
    )
    assert got == [row_windows(v, model_max) if v else [] for v in values]


def load_model():
    def model(batch):
        assert len(batch) <= X.WINDOWS_PER_CALL
        return [("JAILBREAK", 0.95) if "model-hit" in t else ("SAFE", 0.7) for t in batch]

    return model


def load_chars():
    return (lambda text: list(text)), (lambda ids: "".join(ids))


def in_row(df, detectors, windows=SMALL, tokenizer=None):
    found = rescans.with_variants(df, options=DecodeOptions(base64=True))
    return chain.run_chain(found, detectors=detectors, windows=windows, tokenizer=tokenizer)


SAMPLE = [
    "a quiet text",
    "boom",
    "hiss " * 30 + "boom " + "calm " * 20 + "boom",
    "obbz",  # rot13 of boom
    "model-hit and boom",
    "model-hit alone",
    "hiss",
    "",
    None,
]


def test_chain_is_detector_major_and_first_window_wins(texts):
    model = X.ModelDetector("detection:model", load=load_model)
    rows = in_row(texts(SAMPLE), [model, TRIGGER]).orderBy("doc_id").collect()
    block = [r["block"] for r in rows]
    assert [b and b["detector_name"] for b in block] == [
        None, "detection:trigger", "detection:trigger", "detection:trigger", "detection:model",
        "detection:model", None, None, None,
    ]
    assert block[3]["variant_label"] == "rot13"
    assert block[2]["window_index"] > 1 and block[2]["max_score"] == 0.99
    # nothing after the block was kept, and the blocked detector ends the ledger
    assert [len(r["ledger"]) if r["ledger"] is not None else None for r in rows] == [4, 3, 3, 4, 1, 1, 4, 0, None]
    last = rows[6]["ledger"][2]
    assert (last["max_score"], last["top_label"]) == (0.6, "INJECTION")


def test_row_and_table_forms_agree(texts):
    df = texts(SAMPLE * 3)
    detectors = [TRIGGER, X.TOOLS]
    rows = in_row(df, detectors)
    kept = rows.select("doc_id", F.explode("ledger").alias("r")).select(
        "doc_id", "r.detector_name", "r.variant_label", "r.passed", "r.max_score", "r.n_windows", "r.top_label"
    )
    variants = rescans.expand_variants(df, options=DecodeOptions(base64=True))
    scores = chain.score_windows(chain.explode_windows(variants, windows=SMALL), detectors)
    ledger = chain.ledger(chain.text_verdicts(scores)).select(
        "doc_id", "detector_name", "variant_label", (~F.col("blocked")).alias("passed"), "max_score",
        "n_windows", "top_label",
    )
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, ledger.collect()))


def test_user_tokenizer(texts):
    tokenizer = X.TokenizerWindows(load_chars, SMALL)
    text = "abcdefgh" * 3
    variants = rescans.expand_variants(texts([text, "xyz"]))
    rows = chain.explode_windows(variants.where("label = 'original'"), tokenizer=tokenizer).collect()
    mine = [r["text"] for r in rows if r["doc_id"] == 0]
    assert mine == [text[0:8], text[6:14], text[12:20], text[18:24]]
    out = in_row(texts(["boo" + "m" * 9, "b o o m"]), [TRIGGER], tokenizer=tokenizer)
    assert [b is not None for b in column(out, "block")] == [True, False]


def test_detector_names_are_unique(texts):
    with pytest.raises(OptionError):
        in_row(texts(["x"]), [TRIGGER, TRIGGER])


def test_expensive_detector_does_not_see_blocked_documents(texts):
    def refuse():
        def model(batch):
            assert not any("boom" in t for t in batch)
            return [("SAFE", 0.5)] * len(batch)

        return model

    out = in_row(texts(["boom", "calm"]), [TRIGGER, X.ModelDetector("detection:late", load=refuse)])
    assert [b is not None for b in column(out, "block")] == [True, False]


def test_filter_on_the_block_does_not_repeat_the_chain(texts):
    plan = in_row(texts(["x"]), [TRIGGER]).where("block IS NOT NULL")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
