"""Registered queries: canary tokens and leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgate.functions import tokens as K
from siftgate.functions.text import WS
from siftgate.operators import leaks
from siftgate.plans.inputs import SEED, Plan, documents, registry, table, text_literal
from siftgate.sources.registry_log import RegistryLog
from siftgate.sources.storage import scratch

PLAN = Plan()

# --- planted leaks: every sixth document carries its source's token in another form -------------
GAP = text_literal(f"[{WS}.\\-_]{{0,3}}")
TOKEN_SQL = (
    "'SIFT-CANARY-' || left(translate(upper({s}), ' _', '--'), 10) || '-' || "
    f"left(sha256({text_literal(SEED)} || chr(31) || {{s}}), 16)"
)


def token_sql(source: str) -> str:
    return TOKEN_SQL.replace("{s}", source)


SPACED_SQL = "array_to_string(string_split({t}, ''), ' . ')"
LEAKY = (
    f"tok AS (SELECT DISTINCT source AS source_name, {token_sql('source')} AS token FROM documents), "
    f"leaky AS (SELECT doc_id, source, text || ' ' || CASE doc_id % 8 "
    f"WHEN 0 THEN {token_sql('source')} WHEN 1 THEN lower({token_sql('source')}) "
    f"WHEN 2 THEN to_base64(CAST({token_sql('source')} AS BLOB)) "
    f"WHEN 3 THEN hex({token_sql('source')}) WHEN 4 THEN reverse({token_sql('source')}) "
    f"WHEN 5 THEN {SPACED_SQL.replace('{t}', token_sql('source'))} "
    "WHEN 6 THEN 'SIFT-CANARY-none' ELSE '' END AS text FROM documents)"
)


def leaky(spark, sf):
    docs = documents(spark, sf)
    token = K.generated_token(F.col("source"), "SIFT-CANARY", SEED)
    raw = token.cast("binary")
    form = F.pmod("doc_id", F.lit(8))
    extra = (
        F.when(form == 0, token)
        .when(form == 1, F.lower(token))
        .when(form == 2, F.base64(raw))
        .when(form == 3, F.hex(raw))
        .when(form == 4, F.reverse(token))
        .when(
            form == 5,
            F.array_join(F.regexp_extract_all(token, F.lit("(?s)(.)"), F.lit(1)), " . "),
        )
        .when(form == 6, "SIFT-CANARY-none")
        .otherwise("")
    )
    return docs.withColumn("text", F.concat("text", F.lit(" "), extra))


def tokens(spark, sf):
    names = table(spark, sf, "documents").select(F.col("source").alias("source_name")).distinct()
    return leaks.generate_tokens(names, SEED)


SPACED_RX = (
    f"array_to_string([regexp_escape(c) FOR c IN string_split(t.token, '')], {GAP})"
)
TESTS = {
    "exact": "contains(d.text, t.token)",
    "casefold": "contains(lower(d.text), lower(t.token))",
    "base64": "contains(d.text, to_base64(CAST(t.token AS BLOB)))",
    "hex": "contains(lower(d.text), lower(hex(t.token)))",
    "reversed": "contains(d.text, reverse(t.token))",
    "spaced": f"regexp_matches(d.text, {SPACED_RX})",
}
KIND = "CASE " + " ".join(f"WHEN {test} THEN '{kind}'" for kind, test in TESTS.items()) + " END"
HITS = (
    f"WITH {LEAKY}, hits AS (SELECT d.doc_id, t.source_name, t.token, {KIND} AS kind "
    "FROM leaky d, tok t WHERE kind IS NOT NULL)"
)


def _one_kind(name: str, kind: str):
    def run(spark, sf):
        out = leaks.leak_hits(leaky(spark, sf), tokens(spark, sf))
        rows = leaks.hit_rows(out).where(F.col("kind") == kind)
        return rows.select("doc_id", "source_name")

    PLAN.add(name, f"{HITS} SELECT doc_id, source_name FROM hits WHERE kind = '{kind}'")(run)


@PLAN.add(
    "C1_exact",
    "SELECT d.doc_id, b.item_id::VARCHAR AS source_name FROM documents d JOIN benchmark b "
    "ON contains(d.text, b.text)",
)
def exact(spark, sf):
    docs = documents(spark, sf)
    out = leaks.leak_hits(docs, registry(spark, sf), encoding_resistant=False)
    return leaks.hit_rows(out).select("doc_id", "source_name")


_one_kind("C2_casefold", "casefold")
_one_kind("C3_base64", "base64")
_one_kind("C4_hex", "hex")
_one_kind("C5_reversed", "reversed")
_one_kind("C6_spaced", "spaced")


@PLAN.add(
    "C7_leak_events",
    f"{HITS}, n AS (SELECT count(*) AS n FROM tok) SELECT l.doc_id, 'canary' AS layer, CASE WHEN "
    "count(h.token) > 0 THEN 'blocked' ELSE 'passed' END AS verdict, CASE WHEN count(h.token) > 0 THEN "
    "'Canary leaked from: ' || string_agg(h.source_name, ', ' ORDER BY h.source_name) ELSE 'Clean: 0/' || "
    "any_value(n) || ' tokens found' END AS detail FROM leaky l CROSS JOIN n LEFT JOIN hits h USING (doc_id) "
    "GROUP BY l.doc_id",
)
def leak_events(spark, sf):
    registry = tokens(spark, sf)
    checked = leaks.leak_check(leaky(spark, sf), registry)
    return leaks.leak_events(checked, registry.count()).select("doc_id", "layer", "verdict", "detail")


MANY = (
    "WITH keys AS (SELECT o_orderkey AS k, 'tk_' || md5(o_orderkey::VARCHAR) AS token FROM orders), "
    "d AS (SELECT doc_id, text || ' ' || CASE doc_id % 3 WHEN 0 THEN k.token WHEN 1 THEN upper(k.token) || "
    "'.' || o.token ELSE 'tk_none' END AS text FROM documents LEFT JOIN keys k ON k.k = doc_id % 997 "
    "LEFT JOIN keys o ON o.k = doc_id % 991), "
    "found AS (SELECT DISTINCT doc_id, text, k.k, k.token FROM (SELECT doc_id, text, unnest(regexp_extract_all("
    "lower(text), 'tk_[0-9a-f]{32}')) AS t FROM d) JOIN keys k ON k.token = t) "
)


@PLAN.add(
    "C7_leak_check_thousands",
    MANY + "SELECT doc_id, token, CASE WHEN contains(text, token) THEN 'exact' ELSE 'casefold' END AS kind FROM found",
)
def leak_check_thousands(spark, sf):
    """A registry with a token per order; documents carry one of them in one of two forms, or two."""
    key = F.col("o_orderkey")
    keys = table(spark, sf, "orders").select(
        key.cast("string").alias("source_name"),
        F.concat(F.lit("tk_"), F.md5(key.cast("string"))).alias("token"),
        key.alias("k"),
    )
    # only so many keys can be met, however many orders there are: the rest is never sent to the driver
    a, b = (
        F.broadcast(keys.where(F.col("k").between(0, n - 1)).select(F.col("k").alias(k), F.col("token").alias(f"t{k}")))
        for k, n in (("a", 997), ("b", 991))
    )
    docs = table(spark, sf, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(997)).alias("a"), F.pmod("doc_id", F.lit(991)).alias("b"))
    third = F.pmod("doc_id", F.lit(3))
    extra = (
        F.when(third == 0, F.col("ta"))
        .when(third == 1, F.concat(F.upper("ta"), F.lit("."), "tb"))
        .otherwise("tk_none")
    )
    planted = docs.join(a, "a", "left").join(b, "b", "left").select("doc_id", F.concat("text", F.lit(" "), extra).alias("text"))
    return leaks.leak_pairs(planted, keys.select("source_name", "token")).select("doc_id", "token", "kind")


@PLAN.add(
    "C7_leak_check",
    f"{HITS} SELECT l.doc_id, count(h.token) > 0 AS leaked, "
    "COALESCE(string_agg(h.token, ',' ORDER BY h.source_name), '') AS found, "
    "COALESCE(string_agg(h.source_name, ',' ORDER BY h.source_name), '') AS sources, "
    "COALESCE(string_agg(h.kind, ',' ORDER BY h.source_name), '') AS kinds "
    "FROM leaky l LEFT JOIN hits h USING (doc_id) GROUP BY l.doc_id",
)
def leak_check(spark, sf):
    out = leaks.leak_check(leaky(spark, sf), tokens(spark, sf))
    return out.select(
        "doc_id",
        "leaked",
        F.array_join("found_tokens", ",").alias("found"),
        F.array_join("sources", ",").alias("sources"),
        F.array_join("kinds", ",").alias("kinds"),
    )


@PLAN.add(
    "C7_leak_check_benchmark",
    "WITH h AS (SELECT d.doc_id, string_agg(b.item_id::VARCHAR, ',' ORDER BY b.item_id) AS sources "
    "FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY d.doc_id) "
    "SELECT d.doc_id, h.sources IS NOT NULL AS leaked, COALESCE(h.sources, '') AS sources "
    "FROM documents d LEFT JOIN h USING (doc_id)",
)
def leak_check_benchmark(spark, sf):
    """Passages as tokens: the registry grows with the benchmark table."""
    docs = documents(spark, sf)
    out = leaks.leak_check(docs, registry(spark, sf))
    return out.select("doc_id", "leaked", F.array_join("sources", ",").alias("sources"))


@PLAN.add(
    "C8_leak_report",
    f"{HITS} SELECT source_name, count(*) AS documents, min(doc_id) AS first_doc, "
    + ", ".join(f'count_if(kind = \'{k}\') AS "{k}"' for k in K.KINDS)
    + " FROM hits GROUP BY source_name",
)
def leak_report(spark, sf):
    return leaks.leak_report(leaks.leak_hits(leaky(spark, sf), tokens(spark, sf)))


@PLAN.add(
    "C9_generate_tokens",
    f"SELECT DISTINCT source AS source_name, {token_sql('source')} AS token FROM documents",
)
def generate(spark, sf):
    return tokens(spark, sf)


# per shape: the published form, and whether every document got a token of its own
SHAPE_RX = {
    "aws": "^AKIA[A-Z0-9]{16}$",
    "bearer": "^tk_live_[0-9a-f]{32}$",
    "password": "^[A-Za-z0-9!@#$%^&*]{12}[0-9a-f]{6}$",
    "url": r"^https://admin-[0-9a-f]{8}\.infra\.internal/v1/keys/[0-9a-f]{12}$",
    "mongo": (
        r"^mongodb\+srv://svc_[0-9a-f]{8}:Pw_[0-9a-f]{12}@cluster-[0-9a-f]{6}"
        r"\.prod\.mongodb\.net/app_[0-9a-f]{6}$"
    ),
}


@PLAN.add(
    "C10_shaped_tokens",
    "SELECT shape, n AS tokens, n AS well_formed, n AS distinct_tokens FROM (SELECT unnest(["
    + ", ".join(f"'{s}'" for s in K.SHAPES)
    + "]) AS shape, count(*) AS n FROM documents)",
)
def shaped(spark, sf):
    names = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_name"))
    each = names.select("source_name", F.explode(F.array(*[F.lit(s) for s in K.SHAPES])).alias("shape"))
    made = leaks.generate_shaped(each, F.col("shape"), SEED)
    good = F.lit(False)
    for shape, rx in SHAPE_RX.items():
        good = good | ((F.col("shape") == shape) & F.col("token").rlike(rx))
    password = F.col("shape") == "password"
    for rx in ("[A-Z]", "[a-z]", "[0-9]", r"[!@#$%^&*]"):
        good = good & (~password | F.left("token", F.lit(12)).rlike(rx))
    return made.groupBy("shape").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.count_if(good).alias("well_formed"),
        F.count_distinct("token").alias("distinct_tokens"),
    )


HALF = "(SELECT source_name, token FROM tok WHERE length(source_name) % 2 = 0)"


@PLAN.add(
    "C11_plant_comments",
    f"WITH {LEAKY}, j AS (SELECT d.doc_id, d.text, COALESCE(h.token, {token_sql('d.source')}) AS t "
    f"FROM documents d LEFT JOIN {HALF} h ON d.source = h.source_name), "
    "c AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '<!-- ' || t || ' -->' WHEN 1 THEN "
    "'[//]: # (' || t || ')' WHEN 2 THEN '# ' || t ELSE t END AS comment FROM j) "
    "SELECT doc_id, comment, md5(text || chr(10) || comment) AS digest FROM c",
)
def plant_comments(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("source").alias("source_name")
    )
    some = tokens(spark, sf).where(F.pmod(F.length("source_name"), F.lit(2)) == 0)
    style = F.get(
        F.array(*[F.lit(x) for x in ("html", "markdown", "yaml", "plain")]),
        F.pmod("doc_id", F.lit(4)).cast("int"),
    )
    out = leaks.plant_comments(docs, some, style, SEED)
    return out.select("doc_id", "comment", F.md5("planted").alias("digest"))


REQUESTS = (
    "req AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'bad label' ELSE 'u' || user_id "
    "END AS label, CASE WHEN event_id % 7 = 0 THEN 'short' WHEN event_id % 13 = 0 THEN NULL ELSE "
    "'token-' || event_id END AS token, CASE WHEN event_id % 26 = 0 THEN 'nosuch' ELSE NULL END "
    "AS shape FROM events), "
    "judged AS (SELECT *, CASE WHEN label LIKE '% %' OR length(label) > 64 THEN "
    "'label must be 1..64 chars with no whitespace' WHEN token IS NULL AND shape IS NULL THEN "
    "'provide either token or shape' WHEN token IS NULL AND shape = 'nosuch' THEN 'unknown shape' "
    "WHEN length(token) < 8 THEN 'token must be at least 8 characters' END AS violation FROM req)"
)


def _requests(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("seq"),
        F.when(F.pmod(e, F.lit(11)) == 0, "bad label")
        .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .alias("label"),
        F.when(F.pmod(e, F.lit(7)) == 0, "short")
        .when(F.pmod(e, F.lit(13)) == 0, None)
        .otherwise(F.concat(F.lit("token-"), e.cast("string")))
        .alias("token"),
        F.when(F.pmod(e, F.lit(26)) == 0, "nosuch").alias("shape"),
    )


@PLAN.add(
    "C12_registry_violations",
    f"WITH {REQUESTS} SELECT violation, count(*) AS n FROM judged GROUP BY violation",
)
def violations(spark, sf):
    judged = leaks.registry_violation(_requests(spark, sf))
    return judged.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@PLAN.add(
    "C12_registry_upsert",
    f"WITH {REQUESTS}, good AS (SELECT label, token FROM judged WHERE violation IS NULL "
    "QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq DESC) = 1), "
    "old AS (SELECT DISTINCT 'u' || user_id AS label, 'before' AS token FROM events) "
    "SELECT old.label AS source_name, COALESCE(good.token, old.token) AS token FROM old "
    "LEFT JOIN good USING (label) WHERE old.label NOT IN "
    "(SELECT 'u' || user_id FROM events WHERE event_type = 'signup' AND event_id % 97 = 0)",
)
def upsert(spark, sf):
    events = table(spark, sf, "events")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    old = events.select(name.alias("source_name"), F.lit("before").alias("token")).distinct()
    merged = leaks.upsert_registry(old, _requests(spark, sf), SEED)
    gone = events.where((F.col("event_type") == "signup") & (F.pmod("event_id", F.lit(97)) == 0))
    return leaks.delete_from_registry(merged, gone.select(name.alias("label")).distinct())


@PLAN.add(
    "C12_registry_versions",
    f"WITH {REQUESTS}, good AS (SELECT seq % 3 AS part, label, token FROM judged WHERE violation IS NULL QUALIFY row_number() "
    "OVER (PARTITION BY part, label ORDER BY seq DESC) = 1), "
    "ch AS (SELECT DISTINCT 0 AS v, 'u' || user_id AS label, 'before' AS token FROM events "
    "UNION ALL SELECT 1, label, token FROM good WHERE part = 0 "
    "UNION ALL SELECT DISTINCT 2, 'u' || user_id, NULL FROM events WHERE event_type = 'signup' AND event_id % 97 = 0 "
    "UNION ALL SELECT 3, label, token FROM good WHERE part = 1 UNION ALL SELECT 4, label, token FROM good WHERE part = 2), "
    "held AS (SELECT r.version, label, token FROM range(5) r(version) JOIN ch ON ch.v <= r.version "
    "QUALIFY row_number() OVER (PARTITION BY r.version, label ORDER BY v DESC) = 1) "
    "SELECT version, label AS source_name, token FROM held WHERE token IS NOT NULL",
)
def registry_versions(spark, sf):
    """Five versions of a registry, two of them put together; all are read after the last change."""
    events = table(spark, sf, "events")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    log = RegistryLog(spark, scratch(spark, "registry"))
    asked, part = _requests(spark, sf), F.pmod("seq", F.lit(3))
    log.put(events.select(name.alias("source_name"), F.lit("before").alias("token")).distinct())
    log.upsert(asked.where(part == 0), SEED)
    gone = events.where((F.col("event_type") == "signup") & (F.pmod("event_id", F.lit(97)) == 0))
    log.remove(gone.select(name.alias("label")))
    log.upsert(asked.where(part == 1), SEED)
    log.compact(1)
    log.compact()
    log.upsert(asked.where(part == 2), SEED)
    out = None
    for v in range(5):
        one = log.read(v).select(F.lit(v).alias("version"), "source_name", "token")
        out = one if out is None else out.unionByName(one)
    return out


@PLAN.add("C12_check_as_of", f"{HITS} SELECT doc_id, source_name, kind, 0 AS registry_version FROM hits")
def check_as_of(spark, sf):
    """A check against a version whose tokens have been removed since."""
    log = RegistryLog(spark, scratch(spark, "registry"))
    held = tokens(spark, sf)
    log.put(held)
    log.remove(held.select(F.col("source_name").alias("label")))
    return log.check(leaky(spark, sf), 0).select("doc_id", "source_name", "kind", "registry_version")
