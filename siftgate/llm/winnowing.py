"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut at its spaces; each run of ``K`` words has a polynomial (Rabin-Karp) hash modulo a
prime. Of every ``WINDOW`` consecutive hashes the smallest is kept, of equal ones the rightmost,
with its position. Two texts that share a run of ``K + WINDOW - 1`` words therefore share a kept
hash. Shorter texts are one run, or one window.

Hash and position travel packed in one long, the hash in the high half and the position counted
down in the low half, so the smallest long is the smallest hash at its rightmost place. Window
minima come from doubling: minima of 2, then 4, then 8 neighbours, each one pass over an array.

Defined results: a null text is an empty text and has no fingerprint; two empty fingerprints are
alike (1), an empty and another are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 4
WINDOW = 8
PRIME = (1 << 31) - 1
FACTOR = 1_000_003
LOW = (1 << 32) - 1


def with_prints(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the kept ``hash << 32 | LOW - position`` of column ``text`` in column ``out``."""
    words, grams = f"__{out}_words", f"__{out}_grams"
    hashed = F.transform(F.split(text, " "), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME).cast("long")))
    df = df.withColumn(words, F.when(F.col(text) != "", hashed).otherwise(F.array().cast("array<long>")))

    def gram(at: Column) -> Column:
        value = F.get(words, at)
        for k in range(1, K):
            value = (value * FACTOR + F.coalesce(F.get(words, at + k), F.lit(0).cast("long"))) % PRIME
        return value

    def packed(_: Column, at: Column) -> Column:
        return F.shiftleft(gram(at), 32) + (F.lit(LOW) - at)

    heads = F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - (K - 1)))
    df = df.withColumn(grams, F.transform(heads, packed))
    width = 1
    while width < WINDOW:  # column by column, as each pass reads the last one twice
        following = F.slice(grams, 1 + width, F.greatest(F.lit(1), F.size(grams)))
        df = df.withColumn(grams, F.zip_with(grams, following, lambda a, b: F.when(b < a, b).otherwise(a)))
        width *= 2
    whole = F.slice(grams, 1, F.greatest(F.lit(1), F.size(grams) - (WINDOW - 1)))
    return df.withColumn(out, F.array_distinct(whole)).drop(words, grams)


def hashes(prints: Column | str) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 32)))


def written_out(prints: str) -> Column:
    """``hash:position`` of each kept hash, comma-joined."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(LOW) - x.bitwiseAND(F.lit(LOW))).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Shared hashes of two columns of distinct hashes, as a part of all their hashes."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(both / every)


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a string in ``out``."""
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return with_prints(held, "body", "prints").select("row.*", written_out("prints").alias(out))


def with_next(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """``docs`` with ``next_<column>`` of the following row by ascending long ``key``; the last is followed by the first.

    Rows are dealt into ranges of the key by quantiles, as many as shuffle partitions; into each
    range goes a copy of the row that follows its last one. Null keys come first; equal keys are
    ordered by the hash of ``columns``.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    ids = docs.select(place.alias("place"))
    bounds = sorted(set(ids.agg(F.percentile_approx("place", ranks, 10_000)).first()[0] or ()))


    def part(at: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < at)) if bounds else F.lit(0)

    firsts = sorted((r.part, r.low) for r in ids.groupBy(part(F.col("place")).alias("part")).agg(F.min("place").alias("low")).collect())
    before = {low: firsts[k - 1][0] for k, (_, low) in enumerate(firsts)}
    tie = F.xxhash64(*columns)
    rows = docs.withColumns({"__part": part(place), "__place": place, "__ghost": F.lit(False), "__tie": tie})
    if before:
        held = rows.where(F.col("__place").isin(list(before)))
        moved = F.element_at(F.create_map(*[F.lit(v) for pair in before.items() for v in pair]), F.col("__place"))
        rows = rows.unionByName(held.withColumns({"__part": moved, "__ghost": F.lit(True)}))
    following = Window.partitionBy("__part").orderBy("__ghost", "__place", "__tie")
    led = rows.withColumns({f"next_{c}": F.lead(c).over(following) for c in columns})
    return led.where("NOT __ghost").drop("__part", "__place", "__ghost", "__tie")


def against_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its text with the second half replaced from the next document."""
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    paired = with_next(with_prints(own, "body", "prints"), key, "body", "prints")
    half = F.floor(F.char_length("body") / 2).cast("int")
    edited = F.concat(F.expr("left(body, char_length(body) - cast(floor(char_length(body) / 2) AS int))"), F.left("next_body", half))
    paired = paired.select(key, F.char_length("body").cast("long").alias("n_chars"), "prints", "next_prints", edited.alias("edited"))
    paired = with_prints(paired, "edited", "edited_prints")
    paired = paired.withColumns({"own": hashes("prints"), "other": hashes("edited_prints"), "following": hashes("next_prints")})
    return paired.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written_out("prints").alias("fingerprint"),
        written_out("edited_prints").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )
