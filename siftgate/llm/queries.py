"""The registered queries of the training-data operators: each over its whole table.

Two can be said in SQL as a whole (``ORACLE``); the others are held against brute force in
``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.llm import bpe, decontamination, language, lm_scoring, manifest, near_dedup, packing, periodic_runs, quality, secrets, token_files, url_filter, winnowing
from siftgate.llm.common import table
from siftgate.operators.layout import settle

TIKTOKEN_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER_JSON = "byte_bpe_50k.json"
WORD_TOKENIZER_JSON = "word_bpe_49k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_layers", "n_refused")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TIKTOKEN_RANKS)
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.against_edits(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, ~language.held_out("doc_id", 7, 2))
    return scored.withColumn("held_out", ~scored.learned).drop("learned")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out("doc_id", 4, 2).alias("held_out"))
    model = language.learn(docs.where("NOT held_out"))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(TOKENIZER_JSON)) as f:
        description = f.read()
    return token_files.round_trip(table(spark, sf_dir, "documents"), description, with_ids=False)


#: The given rules.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_TOKENIZER_JSON)) as f:
        description = f.read()
    pieces = packing.pieces(table(spark, sf_dir, "documents"), description)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(digests)


def looped(docs: DataFrame) -> DataFrame:
    """Texts with planted runs: the words of one document in ten go round and round from some word on."""

    def text(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(F.sequence(F.lit(0), (n - a - 1).cast("int")), lambda k: F.get(w, (a + k % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), again), " "))

    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.get(F.transform(F.array(words), text), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(looped(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(touched, manifest.digest(*[lowered if f == "text" else F.col(f) for f in manifest.FIELDS]))
    proved = manifest.manifest(docs, carry={"tampered": tampered})
    proof = F.array_join(F.col("proof.siblings"), "")
    back = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    found = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), back.alias("folded_root"))
    return settle(found, "folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_lm_scores": op6_lm_scores,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_token_files": op9_token_files,
    "op10_url_filter": op10_url_filter,
    "op11_packing": op11_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_manifest": op13_manifest,
}

_LOW = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w"

ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_PLAIN} FROM documents),
        i AS (SELECT COALESCE(item_id::VARCHAR, 'null') AS item, {_PLAIN} FROM benchmark),
        win AS (SELECT DISTINCT item, k, array_to_string(w[pos:pos + k - 1], ' ') AS g FROM (
            SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS pos FROM i WHERE len(w) > 0)),
        run AS (SELECT doc_id, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS g FROM (
            SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        met AS (SELECT doc_id, pos, k, item FROM run JOIN win USING (k, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM met) GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
                FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(hit.n, 0) AS n_hit, COALESCE(own.n, 0) AS n_items,
            sha256(COALESCE(items, '')) AS items_sha256, COALESCE(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op2_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS g FROM (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT doc_id, COALESCE(n.n, 0) AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n""",
}
