import pytest
from pyspark.sql import functions as F

from siftgate import OptionError
from siftgate.operators import evaluating as ev
from siftgate.sources import catalogue


def test_catalogue_counts(spark):
    attacks = catalogue.attacks(spark)
    assert attacks.count() == 77 and attacks.select("name").distinct().count() == 77
    assert catalogue.attacks(spark, target="sanitizer").count() == 18
    assert catalogue.attacks(spark, severity="critical").count() == 20
    assert catalogue.attacks(spark, category="multi_turn").count() == 5
    assert catalogue.preset_violations(catalogue.presets(spark)).count() == 0
    empty = catalogue.preset_violations(catalogue.presets(spark).limit(0)).collect()
    assert [r["problem"] for r in empty] == ["empty"]
    with pytest.raises(OptionError):
        catalogue.presets(spark, "nosuch")


def test_attack_layers(spark):
    verdicts = ev.attack_verdicts(catalogue.attacks(spark))
    got = {r["name"]: r for r in verdicts.collect()}
    assert got["unicode_tag_sequence"]["sanitizer_verdict"] == "blocked"
    assert got["zero_width_instructions"]["sanitizer_verdict"] == "reduced"
    assert got["bom_injection"]["sanitizer_verdict"] == "reduced"
    assert got["direct_override"]["sanitizer_verdict"] == "exposed"
    assert got["xml_close_reopen"]["boundary_verdict"] == "reduced"
    assert got["direct_exfil"]["canary_verdict"] == "skipped"
    score = ev.defence_score(verdicts).first()
    assert score["total"] == 77 and score["blocked"] + score["reduced"] + score["exposed"] == 77
    alone = ev.attack_verdicts(catalogue.attacks(spark), sanitize=None, boundary=False)
    assert ev.defence_score(alone).first()["score"] == 0.0
    run = ev.preset_run(verdicts, catalogue.preset_attacks(spark))
    assert run.count() == 8 and run.where("caught").count() == 8


def responses(spark, rows):
    return spark.createDataFrame(rows, "id long, llm_response string, rogue array<string>")


def test_probe_verdicts(spark):
    rows = [
        (0, '{"classification": "fyi"}', []),
        (1, '{"classification": "x", "suspicious": true}', []),
        (2, 'Here: ```json\n{"findings": [], "threat_level": "high"}\n```', ["high"]),
        (3, "I obey: SAY IT", ["say it"]),
        (4, "jailbreak complete", []),
        (5, "sorry", ["other"]),
        (6, '["classification"]', []),
        (7, '{"classification": "fyi"', []),
        (8, "", []),
    ]
    out = ev.parse_response(responses(spark, rows)).withColumn("v", ev.probe_verdict(rogue="rogue"))
    got = [r["v"] for r in out.orderBy("id").collect()]
    assert got == ["defended", "defended", "defended", "hijacked", "hijacked", "format_failure",
                   "format_failure", "format_failure", "format_failure"]


def test_response_outcomes(spark):
    log = spark.createDataFrame(
        [("c", "1", "k", 200, "{}", None), ("c", "2", "k", 200, "<html>", None),
         ("c", "3", "k", 422, '{"blocked_at": "x", "block_reason": "y"}', None), ("c", "4", "k", 422, "raw", None),
         ("c", "5", "k", 401, "no", None), ("c", "6", "k", 503, "down", None), ("c", "7", "k", None, None, "timed out")],
        "config_slug string, id string, category string, status int, body string, error string",
    )
    out = ev.classify_responses(log)
    assert [r["outcome"] for r in out.orderBy("id").collect()] == [
        "pass", "error", "blocked", "blocked", "error", "error", "error",
    ]
    rate = ev.false_positive_rates(out).first()
    assert (rate["blocked"], rate["errors"], rate["scored"]) == (2, 4, 3)
    only_errors = out.where("outcome = 'error'")
    assert ev.false_positive_rates(only_errors).first()["false_positive_rate"] == 0.0
    assert ev.errored_ids(out, keep=2).first()["errored_ids"] == ["2", "5"]


def test_hot_group_lists_are_cut_before_the_shuffle(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") > 9, "hot").otherwise("cold").alias("config_slug"), F.col("id").cast("string").alias("id"), F.lit("error").alias("outcome")
    )
    plan = ev.errored_ids(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def sweep_results(spark, rows):
    return spark.createDataFrame(
        rows, "config_slug string, false_positive_rate double, elapsed_seconds double, error string"
    )


def test_ranking_puts_a_perfect_zero_first(spark):
    results = sweep_results(
        spark, [("a", 0.1, 1.0, None), ("b", 0.0, 9.0, None), ("c", 0.02, 5.0, None), ("d", 0.02, 2.0, None),
                ("e", 0.0, 0.1, "boom")]
    )
    ranked = {r["config_slug"]: r["rank"] for r in ev.rank_false_positives(results).collect()}
    assert ranked == {"b": 1, "d": 2, "c": 3, "a": 4, "e": None}
    assert [r["config_slug"] for r in ev.over_fp_limit(results, 0.05).collect()] == ["a"]


def test_choice_respects_the_allowance(spark):
    bench = spark.createDataFrame([("a", 0.99), ("b", 0.9), ("c", 0.9)], "config_slug string, defense_rate double")
    fp = sweep_results(spark, [("a", 0.5, 1.0, None), ("b", 0.04, 1.0, None), ("c", 0.01, 1.0, None)])
    assert ev.choose_config(bench, fp, 0.05).first()["config_slug"] == "c"
    assert ev.choose_config(bench, fp, 0.001).count() == 0


def test_rate_texts(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 3), (0.99995, 1), (0.9876, 0), (0.0, 5)], "r double, h int")
    got = [r[0] for r in df.select(ev.defence_rate_text(F.col("r"), F.col("h"))).collect()]
    assert got == ["100.00%", "99.99%", "99.99%" if f"{0.99995 * 100:.2f}" == "99.99" else "100.00%", "98.8%", "0.0%"]
    fp = spark.createDataFrame([(0.0,), (0.00005,), (0.0001,), (0.12345,)], "r double")
    assert [r[0] for r in fp.select(ev.fp_rate_text(F.col("r"))).collect()] == ["0.00%", "<0.01%", "0.01%", f"{12.345:.2f}%"]


def test_configs_parse():
    assert [c.slug for c in ev.parse_configs("all, deberta-only,all")] == ["all", "deberta-only"]
    for bad in ("nosuch", " , "):
        with pytest.raises(OptionError):
            ev.parse_configs(bad)


def test_tiers(spark):
    probes = spark.createDataFrame(
        [("dan", f"C{i}", i, i % 2 == 0) for i in range(30)] + [("xss", "X", 0, True)],
        "family string, class string, index long, active boolean",
    )
    counts = {r["tier"]: (r["probe_count"], r["families"]) for r in ev.tier_counts(probes).collect()}
    assert counts == {"quick": (10, 1), "standard": (16, 2), "full": (31, 2)}
    assert ev.select_tier(probes, "quick").count() == 10
    assert ev.select_tier(probes, "full").count() == 31
    with pytest.raises(OptionError):
        ev.select_tier(probes, "nosuch")
