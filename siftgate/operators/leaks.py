"""Canary registries and leak analytics.

A text is matched in two steps, both in the JVM. Every form of a token holds an *anchor*: a run of
``GRAM`` characters of its squeezed lower-case view (``SHORT_GRAM`` for forms shorter than that),
one that begins with a character texts seldom use and is rare among the registry's forms. Of a
document only the runs that begin with such a character are looked at; those that are anchors name
the few tokens worth a full look, which :func:`siftgate.functions.tokens.match_kind` then takes.

A registry of at most ``PLAN_BYTES`` of forms travels in the plan and nothing is shuffled. Any
other stays a table (:func:`leak_pairs`): a Bloom filter of all anchors, built by an aggregate and
broadcast as bits (never as part of a plan), leaves out documents without a candidate before anything
is exploded; only hashes of their runs cross to Python. Of the rest, excerpts around candidates,
bounded by the longest form, meet the registry on salted anchors. No document's text and no row
without an anchor is shuffled, and documents are read once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgate.functions import tokens as K
from siftgate.functions.text import WS, let, require_string, strip
from siftgate.operators.layout import settle
from siftgate.options import OptionError
from siftgate.sources.storage import drop_scratch, scratch

GRAM, SHORT_GRAM = 8, 3
PLAN_BYTES = 1024 * 1024
MAP_BITS = 1 << 28  # at most (32 MiB); 16 bits per anchor and more below that
MANY_FIRSTS = 64  # with more first characters than this, every run is looked at
TRIED = 6  # runs of a form that are looked up in the registry to choose its anchor
EXCERPT = 1024
SALTS, SALTED_ROWS = 16, 1 << 22  # a registry is repeated per salt; up to so many rows
#: Letters from the seldom to the common; runs that begin with anything else are seldom still.
SELDOM = "qzjxkvbpgwyfmculdrhsnioate"
HIT_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("ord", T.IntegerType()),
            T.StructField("source_name", T.StringType()),
            T.StructField("token", T.StringType()),
            T.StructField("kind", T.StringType()),
        ]
    )
)


def _view(text: Column) -> Column:
    """What every form of a token shares with every text that leaks it (the two small sigmas are one)."""
    return F.translate(F.lower(K.squeezed(text)), "ς", "σ")


def _grams(view: Column, size: int) -> Column:
    return F.regexp_extract_all(view, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))


@cache
def _spellings() -> dict[str, list[str]]:
    """Characters by the first character of their lower case, where that is another one."""
    found: dict[str, list[str]] = {"σ": ["ς"]}
    for c in map(chr, range(0x41, 0x1F000)):
        low = c.lower()
        if low != c:
            found.setdefault(low[0], []).append(c)
    return found


def _text_grams(text: Column, firsts: Sequence[str] | None, size: int) -> Column:
    """The runs of a text's view that begin with one of ``firsts`` (any character if None), cut from the text itself."""
    gap = f"{WS}.\\-_"
    if firsts is None:
        begin = f"[^{gap}]"
    else:
        every = sorted({c for f in firsts for c in (f, *_spellings().get(f, []))})
        begin = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in every) + "]"
    runs = F.regexp_extract_all(text, F.lit(rf"(?s)(?=({begin}(?:[{gap}]*+[^{gap}]){{{size - 1}}}))"), F.lit(1))
    return F.transform(runs, lambda g: F.left(_view(g), F.lit(size)))


def _first_characters(anchors: Iterable[str]) -> list[str] | None:
    firsts = sorted({a[0] for a in anchors})
    return firsts if len(firsts) <= MANY_FIRSTS else None


def _forms(registry: DataFrame, encoding_resistant: bool, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row per token: its forms, an anchor for each that is long enough, and whether one is not.

    The runs are used twice: ``kept`` may store them, so that they are cut once.
    """
    ord = F.col("ord") if "ord" in registry.columns else F.lit(0)
    token = ["ord", "source_name", "token"]
    # a registry in one small file is one task otherwise, and its forms are many times its size
    rows = registry.where(F.length("token") > 0).select(ord.cast("int").alias("ord"), "source_name", "token").repartition(4 * registry.sparkSession.sparkContext.defaultParallelism, *token)
    form = K.forms(F.col("ord"), F.col("source_name"), F.col("token"))
    names = ("token", "b64", "hexed", "backwards") if encoding_resistant else ("token",)
    views = rows.select(*token, F.posexplode(F.array(*[_view(form[n]) for n in names])).alias("i", "view"))
    long = F.length("view") >= GRAM
    grams = F.when(long, _grams(F.col("view"), GRAM)).otherwise(_grams(F.col("view"), SHORT_GRAM))
    # a dot that lower-casing has added begins no run of a text, nor does half of a character
    plain = F.octet_length("view") == F.length("view")
    usable = F.when(plain, grams).otherwise(F.filter(grams, lambda g: ~F.startswith(g, F.lit("\u0307")) & F.contains("view", g)))
    ranked = F.transform(usable, lambda g: F.struct(F.instr(F.lit(SELDOM), F.left(g, F.lit(1))).alias("rank"), g.alias("gram")))
    seldom = let(ranked, lambda r: let(F.array_min(r)["rank"], lambda least: F.filter(r, lambda x: x["rank"] == least)))
    # of a long list, runs spread from its first to its last: any of them serves, and tails tell tokens of one shape apart
    last = F.lit(TRIED - 1)
    spread = let(
        F.array_distinct(seldom),
        lambda r: F.when(F.size(r) <= TRIED, r).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda k: F.get(r, F.floor(k * (F.size(r) - 1) / last).cast("int")))
        ),
    )
    runs = kept(views.select(*token, "i", F.explode_outer(spread).alias("r")).select(*token, "i", "r.gram"))
    counts = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # the optimizer takes the runs for as small as the registry's file: neither side may be broadcast
    best = runs.join(counts.hint("merge"), "gram", "left").groupBy(*token, "i").agg(
        F.min(F.when(F.col("gram").isNotNull(), F.struct("n", "gram"))).getField("gram").alias("anchor")
    )
    found = best.groupBy(*token).agg(
        F.collect_set("anchor").alias("anchors"),
        (F.count(F.lit(1)) > F.count("anchor")).alias("short"),
    )
    return found.select(form.alias("f"), "anchors", "short").select("f.*", "anchors", "short")


def _matches(forms: Column, text: Column, encoding_resistant: bool) -> Column:
    """Hits among ``forms``, in their order."""

    def scan(low: Column, tight: Column) -> Column:
        tried = F.transform(
            forms,
            lambda f: F.struct(
                f["ord"].alias("ord"),
                f["source_name"].alias("source_name"),
                f["token"].alias("token"),
                K.match_kind(f, text, low, tight, encoding_resistant).alias("kind"),
            ),
        )
        return F.filter(tried, lambda h: h["kind"].isNotNull())

    if not encoding_resistant:
        return scan(text, text)
    return let(F.lower(text), lambda low: let(K.squeezed(text), lambda tight: scan(low, tight)))


def _literal(rows: list) -> Column:
    """Collected forms as one constant, in registry order."""
    rows = sorted((r.asDict() for r in rows), key=lambda r: (r["ord"], r["source_name"] or ""))
    return F.from_json(F.lit(json.dumps(rows)), K.FORM_TYPE)


def leak_hits(
    docs: DataFrame,
    registry: DataFrame,
    text: str = "text",
    encoding_resistant: bool = True,
    plan_bytes: int = PLAN_BYTES,
) -> DataFrame:
    """Add ``hits``: ``ARRAY<STRUCT<ord, source_name, token, kind>>`` in registry order."""
    require_string(docs, text)
    require_string(registry, "token")
    size = F.sum(F.length(F.col("token")) * 10).alias("b")  # six forms, of which some are longer
    total = registry.agg(size).first()["b"] or 0
    if total > plan_bytes:
        return _joined_hits(docs, registry, text, encoding_resistant)
    rows = _forms(registry, encoding_resistant).collect()
    none = F.when(F.col(text).isNotNull(), F.array().cast(HIT_TYPE))
    if not rows:
        return docs.withColumn("hits", none)
    found = F.array().cast("array<string>")
    for size in (GRAM, SHORT_GRAM):
        anchors = sorted({a for r in rows for a in r["anchors"] if len(a) == size})
        if anchors:
            known = F.from_json(F.lit(json.dumps(anchors)), "array<string>")
            found = F.array_union(found, F.array_intersect(_text_grams(F.col(text), _first_characters(anchors), size), known))
    out = settle(docs.withColumn("_anchors", found), "_anchors")
    near = F.filter(_literal(rows), lambda f: f["short"] | F.arrays_overlap(f["anchors"], F.col("_anchors")))
    worth = F.lit(any(r["short"] for r in rows)) | (F.size("_anchors") > 0)
    found = F.when(F.col(text).isNotNull() & worth, _matches(near, F.col(text), encoding_resistant))
    return settle(out.withColumn("hits", F.coalesce(found, none)), "hits").drop("_anchors")


def _bit_map(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """Of an array of strings, those that may be among ``keys`` (one column ``a``, ``n`` rows): a Bloom filter of two hashes.

    Its bits are broadcast to the Python workers. As a constant of the plan they would be spelt out
    in every description of it that the driver keeps.
    """
    bits = 1 << 16
    while bits < min(MAP_BITS, 16 * n):
        bits *= 2
    mask = F.lit(bits - 1)
    hashed = F.xxhash64("a")
    places = F.array(hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 32).bitwiseAND(mask))
    words = (
        keys.select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("v"))
        .toArrow()
    )
    held = np.zeros(bits // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("v").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("array<boolean>")
    def marks(hashes: pd.Series) -> pd.Series:
        sizes = [0 if h is None else len(h) for h in hashes]
        h = np.concatenate([np.zeros(0, np.int64), *[x for x in hashes if x is not None]]).astype(np.int64)
        found = np.ones(len(h), bool)
        for p in (h & (bits - 1), (h >> 32) & (bits - 1)):
            found &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if sizes else [])

    def among(strings: Column) -> Column:
        told = marks(F.transform(strings, lambda g: F.xxhash64(g)))
        kept = F.filter(F.arrays_zip(strings.alias("s"), told.alias("m")), lambda z: z["m"])
        return F.transform(kept, lambda z: z["s"])

    return among


def _excerpts(text: Column, longest: int) -> Column:
    """The text in pieces that overlap by ``longest`` characters, so that each form lies whole in one of them."""
    size = max(EXCERPT, 2 * longest)

    def overlapping(parts: Column) -> Column:
        return F.transform(parts, lambda c, i: F.concat(c, F.coalesce(F.left(F.get(parts, i + 1), F.lit(longest)), F.lit(""))))

    cut = let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), overlapping)
    # the lower case of a capital sigma depends on what follows it: such texts stay whole
    whole = (F.length(text) <= size) | F.contains(text, F.lit("Σ"))
    return F.when(whole, F.array(text)).otherwise(cut)


def leak_pairs(
    docs: DataFrame, registry: DataFrame, id: str = "doc_id", text: str = "text", encoding_resistant: bool = True
) -> DataFrame:
    """``(id, ord, source_name, token, kind)``: one row per document and token it leaks, for a registry of any size.

    Rows with equal ids count as one document. Tokens with a form of under ``SHORT_GRAM``
    characters have no anchor and are tried on every document; they travel in the plan.
    """
    require_string(docs, text)
    require_string(registry, "token")
    pairs = _pairs(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), registry, encoding_resistant)
    return pairs.select(F.col("_id").alias(id), "ord", "source_name", "token", "kind")


def _pairs(docs: DataFrame, registry: DataFrame, encoding_resistant: bool) -> DataFrame:
    """As :func:`leak_pairs`, of ``(_id, _text)``."""
    spark = docs.sparkSession

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # asked several questions below: worked out once
    cut = scratch(spark, "runs")
    try:
        forms = stored(_forms(registry, encoding_resistant, lambda runs: stored(runs, cut)), scratch(spark, "registry"))
    finally:
        drop_scratch(spark, cut)
    names = [part.split(":")[0] for part in _form_fields() if not part.startswith(("anchors", "short"))]
    table = forms.select(F.struct(*names).alias("f"), "anchors", "short")
    anchored = table.select("f", F.explode("anchors").alias("_gram"))
    # a spaced form has up to three separators between its characters
    size = F.greatest(4 * F.length("token"), F.length("b64"), F.length("hexed"))
    told = forms.agg(F.max(size).alias("longest"), F.count_if("short").alias("n_short")).first()
    longest = told["longest"] or 1
    firsts = anchored.groupBy(F.length("_gram").alias("size")).agg(F.collect_set(F.left("_gram", F.lit(1))).alias("firsts")).collect()
    n = anchored.count()
    marked = _bit_map(anchored.select(F.col("_gram").alias("a")), n)

    def candidates(t: Column) -> Column:
        grams = [_text_grams(t, _first_characters(r["firsts"]), r["size"]) for r in firsts]
        return F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")

    seen = settle(docs.withColumn("_grams", candidates(F.col("_text"))), "_grams")
    near = settle(seen.withColumn("_near", marked(F.col("_grams"))).drop("_grams"), "_near").where(F.size("_near") > 0)
    parts = near.select("_id", "_near", F.explode(_excerpts(F.col("_text"), longest)).alias("_part"))
    # the more anchors, the less the copies may cost; a crowded anchor is then left to Spark's skew join
    salts = max(1, min(SALTS, SALTED_ROWS // max(1, n)))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt")
    runs = parts.select("_id", "_part", salt, F.explode(F.array_intersect(candidates(F.col("_part")), F.col("_near"))).alias("_gram"))
    salted = anchored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    # as above: salts and anchors multiply the registry, unseen by the optimizer
    met = runs.join(salted.hint("merge"), ["_gram", "_salt"])
    text = F.col("_part")
    # bound once: spelt out, both views are evaluated again in every branch
    kind = let(F.lower(text), lambda low: let(K.squeezed(text), lambda tight: K.match_kind(F.col("f"), text, low, tight, encoding_resistant)))
    found = settle(met.select("_id", F.struct("f.ord", "f.source_name", "f.token").alias("t"), kind.alias("kind")), "kind")
    if told["n_short"]:
        tiny = _literal([r["f"] for r in table.where("short").select("f").collect()])
        tried = docs.where("_text IS NOT NULL").select("_id", F.explode_outer(_matches(tiny, F.col("_text"), encoding_resistant)).alias("h"))
        found = found.unionByName(tried.select("_id", F.struct("h.ord", "h.source_name", "h.token").alias("t"), "h.kind"))
    order = F.array_position(F.array(*[F.lit(k) for k in K.KINDS]), F.col("kind"))
    first = found.where("kind IS NOT NULL").groupBy("_id", "t").agg(F.min(F.struct(order.alias("o"), "kind")).alias("k"))
    return first.select("_id", "t.*", "k.kind")


def _joined_hits(docs: DataFrame, registry: DataFrame, text: str, encoding_resistant: bool) -> DataFrame:
    """Hits of a registry too large for the plan, brought back by the digest of the text.

    Texts are read once for the pairs. A second Bloom filter, of the digests that have hits, keeps
    documents without any out of the join.
    """
    digest = F.sha2(F.col(text), 256)
    pairs = _pairs(docs.where(F.col(text).isNotNull()).select(digest.alias("_id"), F.col(text).alias("_text")), registry, encoding_resistant)
    path = scratch(docs.sparkSession, "leaks")
    pairs.write.parquet(path)
    kept = docs.sparkSession.read.schema(pairs.schema).parquet(path)
    hit = F.struct("ord", "source_name", "token", "kind")
    hits = kept.groupBy("_id").agg(F.array_sort(F.collect_list(hit)).cast(HIT_TYPE).alias("hits"))
    leaky = kept.select(F.col("_id").alias("a")).distinct()
    may = _bit_map(leaky, leaky.count())
    none = F.when(F.col(text).isNotNull(), F.array().cast(HIT_TYPE))
    told = docs.withColumn("_may", F.size(may(F.array(F.coalesce(digest, F.lit(""))))) > 0)
    clean = told.where(~F.col("_may")).withColumn("hits", none)
    rest = told.where("_may").withColumn("_id", digest).join(hits, "_id", "left")
    return clean.unionByName(rest.withColumn("hits", F.coalesce("hits", none)).drop("_id")).drop("_may")


def _form_fields() -> list[str]:
    """``name:type`` of each form field."""
    inner = K.FORM_TYPE.removeprefix("array<struct<").removesuffix(">>")
    return inner.split(",")


def leak_check(
    docs: DataFrame, registry: DataFrame, text: str = "text", encoding_resistant: bool = True, plan_bytes: int = PLAN_BYTES
) -> DataFrame:
    """Add ``leaked, found_tokens, sources, kinds``: one entry per leaked token, registry order."""
    out = leak_hits(docs, registry, text, encoding_resistant, plan_bytes)
    return (
        out.withColumn("leaked", F.size("hits") > 0)
        .withColumn("found_tokens", F.transform("hits", lambda h: h["token"]))
        .withColumn("sources", F.transform("hits", lambda h: h["source_name"]))
        .withColumn("kinds", F.transform("hits", lambda h: h["kind"]))
        .drop("hits")
    )


def leak_events(checked: DataFrame, tokens: int, encoding_resistant: bool = True, id: str = "doc_id") -> DataFrame:
    """One passed / blocked event of the canary per checked row; ``tokens`` is the registry's size."""
    told = F.struct("sources", F.lit(encoding_resistant).alias("encoding_resistant"))
    return checked.where(F.col("leaked").isNotNull()).select(
        F.col(id),
        F.lit("canary").alias("layer"),
        F.when(F.col("leaked"), "blocked").otherwise("passed").alias("verdict"),
        F.when(F.col("leaked"), F.concat(F.lit("Canary leaked from: "), F.array_join("sources", ", ")))
        .otherwise(F.lit(f"Clean: 0/{tokens} tokens found"))
        .alias("detail"),
        F.when(F.col("leaked"), F.to_json(told)).alias("metadata"),
    )


def hit_rows(hits: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per hit: ``(id, ord, source_name, token, kind)``.

    The outer form is deliberate: a plain explode makes the optimizer add ``size(hits) > 0`` below
    the matcher, which then runs twice.
    """
    rows = hits.select(id, F.explode_outer("hits").alias("h")).where(F.col("h").isNotNull())
    return rows.select(id, "h.*")


def leak_report(hits: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per source: documents leaked, first document, and how often each form was used.

    ``hits`` comes from :func:`leak_hits`; counts combine before the shuffle, so one token that
    leaks into a third of the corpus costs one row per task.
    """
    flat = hit_rows(hits, id)
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in K.KINDS]
    return flat.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("documents"), F.min(id).alias("first_doc"), *kinds
    )


# --- registry upkeep ----------------------------------------------------------------------------


def generate_tokens(
    sources: DataFrame, seed: str, prefix: str = "SIFT-CANARY", source: str = "source_name"
) -> DataFrame:
    """One ``prefix-TAG-hex16`` token per source, repeatable for the same secret seed."""
    if not seed:
        raise OptionError("token generation needs a secret seed")
    return sources.withColumn("token", K.generated_token(F.col(source), prefix, seed))


def generate_shaped(
    sources: DataFrame, shape: str | Column, seed: str, source: str = "source_name"
) -> DataFrame:
    """One credential-looking decoy per source."""
    if not seed:
        raise OptionError("token generation needs a secret seed")
    if isinstance(shape, str):
        if shape not in K.SHAPES:
            raise OptionError(f"unknown shape {shape!r}; available: {', '.join(K.SHAPES)}")
        shape = F.lit(shape)
    return sources.withColumn("token", K.shaped_token(shape, F.col(source), seed))


def plant_comments(
    docs: DataFrame,
    registry: DataFrame,
    format: Column,
    seed: str,
    text: str = "text",
    source: str = "source_name",
    prefix: str = "SIFT-CANARY",
) -> DataFrame:
    """Append each document's token as a comment; a source without a token gets a generated one.

    ``registry`` holds one row per source. Left for the optimizer to place: a small registry is
    broadcast by its measured size, a large one is joined by sort-merge with skew splitting.
    """
    tokens = registry.select(F.col("source_name").alias("_s"), F.col("token").alias("_t"))
    joined = docs.join(tokens, F.col(source) == F.col("_s"), "left")
    token = F.coalesce(F.nullif("_t", F.lit("")), K.generated_token(F.col(source), prefix, seed))
    return (
        joined.withColumn("comment", K.comment(token, format))
        .withColumn("planted", F.concat(F.col(text), F.lit("\n"), F.col("comment")))
        .drop("_s", "_t")
    )


def registry_violation(requests: DataFrame) -> DataFrame:
    """Add ``violation``: why an upsert request is refused, or null."""
    label = strip(F.col("label"))
    rule = (
        F.when(
            label.isNull() | (label == "") | label.rlike(f"[{WS}]") | (F.length(label) > 64),
            "label must be 1..64 chars with no whitespace",
        )
        .when(F.col("token").isNull() & F.col("shape").isNull(), "provide either token or shape")
        .when(F.col("token").isNull() & ~F.col("shape").isin(*K.SHAPES), "unknown shape")
        .when(F.length("token") < 8, "token must be at least 8 characters")
    )
    return requests.withColumn("violation", rule)


def upsert_registry(registry: DataFrame, requests: DataFrame, seed: str) -> DataFrame:
    """Apply accepted requests; the latest (highest ``seq``) per label wins.

    Latest-wins is a max over an ordered struct, so a label rotated a million times reduces
    map-side instead of being sorted in one task.
    """
    good = registry_violation(requests).where(F.col("violation").isNull())
    token = F.when(
        F.col("token").isNull(),
        K.shaped_token(
            F.coalesce("shape", F.lit("bearer")),
            F.concat_ws(":", "label", F.col("seq").cast("string")),
            seed,
        ),
    ).otherwise(F.col("token"))
    new = good.select(
        strip(F.col("label")).alias("source_name"),
        token.alias("token"),
        F.col("seq").cast("long").alias("seq"),
    )
    old = registry.select("source_name", "token", F.lit(-1).cast("long").alias("seq"))
    return (
        old.unionByName(new)
        .groupBy("source_name")
        .agg(F.max(F.struct("seq", "token")).alias("m"))
        .select("source_name", F.col("m.token").alias("token"))
    )


def delete_from_registry(registry: DataFrame, labels: DataFrame) -> DataFrame:
    return registry.join(labels.select(F.col("label").alias("source_name")), "source_name", "left_anti")
