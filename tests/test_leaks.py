import base64
import hashlib
import random

import pytest
from conftest import column
from rowref import leak_kind

from siftgate import OptionError
from siftgate.functions.tokens import SHAPES
from siftgate.operators import leaks

TOKENS = ["SIFT-CANARY-mail-00ff", "pa$$.w0rd+(x)", "Ünïcode-Tökén", "ab cd_ef", "\U0001f600smile\U0001f600", "zzz9zzz8"]


def encoded(token, rng):
    return rng.choice(
        [
            token,
            token.swapcase(),
            base64.b64encode(token.encode()).decode(),
            token.encode().hex().upper(),
            token[::-1],
            " - ".join(token),
            " .-_ ".join(token),
            token[:-1],
        ]
    )


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(4)
    return [
        " ".join(encoded(rng.choice(TOKENS), rng) if rng.random() < 0.5 else "word" for _ in range(4))
        for _ in range(300)
    ] + [None, ""]


@pytest.mark.parametrize("plan_bytes", [leaks.PLAN_BYTES, 0])
def test_every_path_matches_brute_force(spark, texts, sample, plan_bytes):
    registry = spark.createDataFrame(
        [(i, f"s{i}", t) for i, t in enumerate(TOKENS)], "ord int, source_name string, token string"
    )
    rows = leaks.leak_check(texts(sample), registry, plan_bytes=plan_bytes).orderBy("doc_id").collect()
    for text, row in zip(sample, rows, strict=True):
        if text is None:
            assert row["leaked"] is None
            continue
        want = [(f"s{i}", k) for i, t in enumerate(TOKENS) if (k := leak_kind(text, t))]
        assert list(zip(row["sources"], row["kinds"])) == want
        assert row["leaked"] == bool(want)


ODD_TOKENS = [*TOKENS, "İstanbul", "ΟΔΟΣ ΑΣ", "x.y", "ab", "Kelvin\u212a-sign", "abc-d", "q" * 40, "z9" * 300]


def test_pairs_of_a_large_registry(spark):
    """No text leaves its row, no row has a null key, documents are read once; long texts and odd characters included."""
    rng = random.Random(8)
    filler = [f"word{i}" for i in range(300)]
    rows = []
    for k in range(250):
        parts = [rng.choice(filler) for _ in range(rng.choice([3, 30, 1500]))]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts)), encoded(rng.choice(ODD_TOKENS), rng))
        rows.append((k, " ".join(parts)))
    rows += [(250, None), (251, ""), (252, "ΟΔΟΣ ΑΣ " + "word " * 800), (253, "hot " + TOKENS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = [(i, f"s{i}", t) for i, t in enumerate(ODD_TOKENS)]
    registry = spark.createDataFrame([*names, *[(100 + i, f"t{i}", f"unseen-token-{i:05d}") for i in range(2000)]], "ord int, source_name string, token string")
    got = leaks.leak_pairs(docs, registry)
    want = {(k, i, kind) for k, text in rows if text is not None for i, t in enumerate(ODD_TOKENS) if (kind := leak_kind(text, t))}
    found = [(r["doc_id"], r["ord"], r["kind"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 200
    hits = leaks.hit_rows(leaks.leak_hits(docs, registry, plan_bytes=0)).collect()
    assert {(r["doc_id"], r["ord"], r["kind"]) for r in hits} == want


def test_pairs_shuffle_no_text_and_read_documents_once(spark, tmp_path):
    spark.range(500).selectExpr("id AS doc_id", "concat('plain words ', id) AS text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    registry = spark.createDataFrame([(i, f"t{i}", f"some-token-{i:05d}") for i in range(300)], "ord int, source_name string, token string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = leaks.leak_pairs(docs, registry)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Scan parquet" in line and "doc_id" in line for line in plan.splitlines()) == 1
    joins = [line for line in plan.splitlines() if "Join" in line and "_gram" in line]
    assert joins and all("_salt" in line and "Inner" in line for line in joins)
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "_text" not in line and "text#" not in line
    assert "_text#" in plan or "text#" in plan
    assert out.count() == 0


def test_a_large_registry_is_no_part_of_the_plan(spark, texts):
    """What finds candidates grows with the registry; the driver keeps every plan's description."""
    registry = spark.range(3000).selectExpr("cast(id AS string) AS source_name", "concat('tk_', md5(cast(id AS string))) AS token")
    out = leaks.leak_pairs(texts(["none"]), registry)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 50_000


def test_encodings_can_be_switched_off(spark, texts):
    registry = spark.createDataFrame([(0, "a", "secret-token")], "ord int, source_name string, token string")
    df = texts(["secret-token", "SECRET-TOKEN"])
    assert column(leaks.leak_check(df, registry, encoding_resistant=False), "leaked") == [True, False]


def test_empty_registry(spark, texts):
    registry = spark.createDataFrame([], "ord int, source_name string, token string")
    assert column(leaks.leak_check(texts(["x"]), registry), "leaked") == [False]


def test_shapes(spark):
    names = spark.createDataFrame([("a",), ("b",)], "source_name string")
    with pytest.raises(OptionError):
        leaks.generate_shaped(names, "nosuch", "seed")
    for shape in SHAPES:
        first = [r["token"] for r in leaks.generate_shaped(names, shape, "seed").collect()]
        again = [r["token"] for r in leaks.generate_shaped(names, shape, "seed").collect()]
        other = [r["token"] for r in leaks.generate_shaped(names, shape, "tide").collect()]
        assert first == again and len(set(first + other)) == 4


def test_generated_token_form(spark):
    names = spark.createDataFrame([("user data_store",)], "source_name string")
    token = leaks.generate_tokens(names, "seed", prefix="P").first()["token"]
    assert token.startswith("P-USER-DATA-") and len(token.rsplit("-", 1)[1]) == 16
    with pytest.raises(OptionError):
        leaks.generate_tokens(names, "")


def test_registry_rules(spark):
    requests = spark.createDataFrame(
        [(1, "ok", "long enough", None), (2, "ok", "even longer one", None), (3, "two words", "long enough", None),
         (4, "x" * 65, "long enough", None), (5, "a", None, None), (6, "b", None, "nosuch"), (7, "c", "short", None),
         (8, "made", None, "aws")],
        "seq long, label string, token string, shape string",
    )
    bad = {r["seq"]: r["violation"] for r in leaks.registry_violation(requests).collect()}
    assert [k for k, v in bad.items() if v is None] == [1, 2, 8]
    old = spark.createDataFrame([("keep", "kept-token"), ("ok", "old-token")], "source_name string, token string")
    merged = {r["source_name"]: r["token"] for r in leaks.upsert_registry(old, requests, "s").collect()}
    assert merged["ok"] == "even longer one" and merged["keep"] == "kept-token"
    assert merged["made"].startswith("AKIA") and set(merged) == {"keep", "ok", "made"}
    gone = leaks.delete_from_registry(old, spark.createDataFrame([("ok",)], "label string"))
    assert [r["source_name"] for r in gone.collect()] == ["keep"]


def test_matching_shuffles_nothing(spark, texts):
    registry = spark.createDataFrame([(0, "a", "secret-token")], "ord int, source_name string, token string")
    plan = leaks.leak_check(texts(["x"]), registry)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_no_side_that_grows_with_the_registry_is_broadcast(spark, texts, monkeypatch):
    """The optimizer takes a registry's runs for as small as its file; broadcast, they filled the driver."""
    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    forms = leaks._forms
    monkeypatch.setattr(leaks, "_forms", lambda *a: told(forms(*a)))
    registry = spark.createDataFrame([(f"s{i}", f"tk_{i:030d}x") for i in range(50)], "source_name string, token string")
    docs = texts([f"see tk_{i:030d}x" for i in range(0, 100, 10)] + ["", None])
    found = told(leaks.leak_pairs(docs, registry))
    assert sorted((r.doc_id, r.source_name, r.kind) for r in found.collect()) == [(i, f"s{10 * i}", "exact") for i in range(5)]
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)


def test_orders_that_no_document_can_name_stay_where_they_are(spark, tmp_path, monkeypatch):
    from siftgate.plans import leaks as plans

    planted = []
    monkeypatch.setattr(plans.leaks, "leak_pairs", lambda docs, keys: planted.append(docs) or docs.selectExpr("doc_id", "'' AS token", "'' AS kind"))
    keys = [(k,) for k in [*range(0, 3000, 2), -2, None]]
    spark.createDataFrame(keys, "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, f"d{i}") for i in [*range(0, 3000, 7), None, -5]], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plans.PLAN.queries["C7_leak_check_thousands"](spark, str(tmp_path))
    told = lambda k: hashlib.md5(str(k).encode()).hexdigest() if k % 2 == 0 else None
    got = {r.doc_id: r.text for r in planted[0].collect()}
    assert len(got) == planted[0].count() == 431
    for i, text in got.items():
        if i is not None and i % 3 == 0:
            want = told(i % 997)
            assert text == (want and f"d{i} tk_{want}")
        elif i is not None and i % 3 == 1:
            a, b = told(i % 997), told(i % 991)
            assert text == (a and b and f"d{i} TK_{a.upper()}.tk_{b}")
    plan = planted[0]._jdf.queryExecution().executedPlan().toString()
    assert "996" in plan and "990" in plan
