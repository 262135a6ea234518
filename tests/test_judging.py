import pytest

from siftgate import JudgeOptions, OptionError
from siftgate.operators import judging


def parsed(spark, raws):
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raws)], "doc_id long, variant_ord int, raw string")
    rows = judging.parse_replies(df).orderBy("doc_id").collect()
    return [(r["verdict"], r["confidence"], r["reason"]) for r in rows]


def test_replies(spark):
    got = parsed(spark, [
        '{"verdict": "SAFE", "confidence": 0.4, "reason": "ok"}',
        'x {"a": {"verdict": "INJECTION", "confidence": -2}} y',
        '{"verdict": " injection", "confidence": "high"}',
        '{"verdict": null}',
        '{"confidence": 1}',
        None,
        '{"verdict": "SAFE", "reason": "' + "r" * 300 + '"}',
    ])
    assert got[0] == ("SAFE", 0.4, "ok")
    assert got[1] == ("INJECTION", 0.0, "")
    assert got[2] == ("INJECTION", 0.0, "")
    assert [g[0] for g in got[3:6]] == ["UNPARSEABLE"] * 3
    assert got[5][2] == "empty response" and len(got[6][2]) == 200


def variants(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id long, ord int, label string, text string, depth int, skipped boolean, skip_reason string"
    )


def test_nonce_avoids_markers_in_the_text(spark):
    plain = variants(spark, [(1, 0, "original", "text", 0, False, None)])
    nonce = judging.judge_requests(plain, "seed").first()["nonce"]
    forged = variants(spark, [(1, 0, "original", f"INPUT_{nonce}_ here", 0, False, None)])
    row = judging.judge_requests(forged, "seed").first()
    assert len(nonce) == 16 and row["nonce"] != nonce
    assert row["message"] == f"[INPUT_{row['nonce']}_START]\nINPUT_{nonce}_ here\n[INPUT_{row['nonce']}_END]"
    with pytest.raises(OptionError):
        judging.judge_requests(plain, "")


def test_decisions(spark):
    rows = [(d, o, f"v{o}", "t", 0, False, None) for d in range(5) for o in range(2)]
    requests = judging.judge_requests(variants(spark, [*rows, (9, 0, "x", "", 1, True, "too_short")]), "s")
    replies = spark.createDataFrame(
        [(0, 0, "SAFE", 0.9), (0, 1, "SAFE", 0.8), (1, 0, "INJECTION", 0.5), (1, 1, "INJECTION", 0.9),
         (2, 0, "UNPARSEABLE", 0.0), (2, 1, "SAFE", 0.7), (3, 0, "SAFE", 0.7), (4, 0, "SAFE", 1.0), (4, 1, "SAFE", 1.0)],
        "doc_id long, variant_ord int, verdict string, confidence double",
    )

    def decide(fail_open):
        results = judging.judge_results(requests, replies, JudgeOptions(fail_open=fail_open))
        return {r["doc_id"]: r for r in judging.judge_decisions(results).collect()}

    opened, closed = decide(True), decide(False)
    assert {d: r["blocked"] for d, r in opened.items()} == {0: False, 1: True, 2: False, 3: False, 4: False}
    assert opened[1]["blocked_at_variant"] == "v1" and opened[1]["block_reason"] == "LLM judge: INJECTION (0.90)"
    assert {d: r["blocked"] for d, r in closed.items()} == {0: False, 1: True, 2: True, 3: True, 4: False}
    assert closed[2]["block_reason"] == "LLM judge unparseable response (fail-closed)"
    assert closed[3]["block_reason"] == "LLM judge unreachable (fail-closed)"
    assert opened[0]["safe_confidence"] == 0.8
