"""Windows counted in subword tokens, over a vocabulary table.

A word (a run of up to ``WORD`` characters between white space; a longer run is several) is cut
into the longest piece of the vocabulary that begins it, then into the longest that goes on, and so
forth; a character that no piece fits is a piece by itself. Each distinct word of the corpus is cut
once: its substrings meet the vocabulary in one join, and the longest per position are followed
from the left. Documents then look their words up, and count along.

What is shuffled: distinct words with their substrings of at most the longest piece's length, and
the documents' words. Texts join their window bounds once, by id; ids must be unique and not null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftgate.functions.text import WS, let, require_string
from siftgate.options import WindowOptions

WORD = 100
MARK = "##"


def read_vocabulary(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(piece, initial)`` from a list of pieces in which those inside a word begin with ``##``."""
    inside = F.startswith(F.col(value), F.lit(MARK))
    piece = F.when(inside, F.substring(F.col(value), F.lit(len(MARK) + 1), F.length(value))).otherwise(F.col(value))
    return lines.select(piece.alias("piece"), (~inside).alias("initial")).where("piece <> ''").distinct()


def doc_words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, i, gap, word)``: each word with the white space before it."""
    pattern = F.lit(f"([{WS}]*)([^{WS}]{{1,{WORD}}})")
    gaps, words = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2))
    rows = docs.select(id, F.posexplode(F.arrays_zip(gaps.alias("gap"), words.alias("word"))).alias("i", "w"))
    return rows.select(id, "i", F.col("w.gap").alias("gap"), F.col("w.word").alias("word"))


def segment(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(word, cuts)`` of each distinct word: the pieces as ``(start, end)``, characters from 0."""
    longest = vocabulary.agg(F.max(F.length("piece"))).first()[0] or 1
    distinct = words.select("word").distinct()
    size = F.length("word")
    at = distinct.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("pos"))
    some = at.select("word", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("pos")))).alias("n"))
    tried = some.withColumn("piece", F.substring(F.col("word"), F.col("pos") + 1, F.col("n"))).withColumn("initial", F.col("pos") == 0)
    best = tried.join(vocabulary, ["piece", "initial"]).groupBy("word", "pos").agg(F.max("n").alias("n"))
    fits = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("fits"))

    def walk(known):
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,end:int>>").alias("cuts"))

        def step(acc, p):
            end = p + F.coalesce(F.try_element_at(known, p), F.lit(1))
            taken = F.struct(end.alias("next"), F.array_append(acc["cuts"], F.struct(p.alias("start"), end.alias("end"))).alias("cuts"))
            return F.when(p == acc["next"], taken).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda acc: acc["cuts"])

    return distinct.join(fits, "word", "left").select("word", let(F.col("fits"), walk).alias("cuts"))


def _counted(docs: DataFrame, vocabulary: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, at, first, cuts)``: where each word begins in the text, and the number of its first piece."""
    require_string(docs, text)
    words = doc_words(docs, id, text)
    rows = words.join(segment(words, vocabulary), "word")
    before = Window.partitionBy(id).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    width = F.length("gap") + F.length("word")
    at = F.coalesce(F.sum(width).over(before), F.lit(0)) + F.length("gap")
    first = F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0))
    return rows.select(id, at.alias("at"), first.alias("first"), "cuts")


def pieces(docs: DataFrame, vocabulary: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, piece, start, end)``: every piece by number, with its characters in the text."""
    rows = _counted(docs, vocabulary, id, text).select(id, "at", "first", F.posexplode("cuts").alias("k", "c"))
    return rows.select(id, (F.col("first") + F.col("k")).alias("piece"), (F.col("at") + F.col("c.start")).alias("start"), (F.col("at") + F.col("c.end")).alias("end"))


def subword_windows(
    docs: DataFrame, vocabulary: DataFrame, id: str = "doc_id", text: str = "text", windows: WindowOptions = WindowOptions()
) -> DataFrame:
    """``(id, window_index, n_windows, start, end, text)``: overlapping windows of pieces, cut from the text itself.

    Windows index from 1 and the last ends at the last piece; a text of one window is given whole.
    Texts without a word have one window too, null and empty texts none.
    """
    size, step = windows.window, windows.window - windows.overlap
    rows = _counted(docs, vocabulary, id, text)
    told = rows.select(id, "at", "first", F.posexplode("cuts").alias("k", "c"))
    p = F.col("first") + F.col("k")
    begins, ends = p % step == 0, (p >= size - 1) & ((p - (size - 1)) % step == 0)
    edges = told.where(begins | ends).select(
        id,
        F.explode(
            F.filter(
                F.array(
                    F.when(begins, F.struct((p / step).cast("long").alias("w"), (F.col("at") + F.col("c.start")).alias("start"), F.lit(None).cast("long").alias("end"))),
                    F.when(ends, F.struct(((p - (size - 1)) / step).cast("long").alias("w"), F.lit(None).cast("long").alias("start"), (F.col("at") + F.col("c.end")).alias("end"))),
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("e"),
    )
    bounds = edges.groupBy(id, F.col("e.w").alias("w")).agg(F.min("e.start").alias("start"), F.max("e.end").alias("end"))
    lists = bounds.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("w", "start", "end"))).alias("bounds"))
    last = rows.groupBy(id).agg(
        F.max(F.col("first") + F.size("cuts")).alias("n_pieces"), F.max(F.col("at") + F.element_at("cuts", -1)["end"]).alias("over")
    )
    out = docs.where(F.col(text) != "").select(id, text).join(last, id, "left").join(lists, id, "left")
    many = F.col("n_pieces") > size
    n = F.when(many, F.ceil((F.col("n_pieces") - size) / step).cast("long") + 1).otherwise(F.lit(1))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("start"), F.length(text).cast("long").alias("end")))
    cut = F.transform(
        F.slice("bounds", 1, n.cast("int")), lambda b: F.struct(b["w"].alias("w"), b["start"].alias("start"), F.coalesce(b["end"], F.col("over")).alias("end"))
    )
    found = out.select(id, text, n.alias("n_windows"), F.explode(F.when(many, cut).otherwise(whole)).alias("b"))
    part = F.substring(F.col(text), (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int"))
    return found.select(id, (F.col("b.w") + 1).alias("window_index"), "n_windows", "b.start", "b.end", part.alias("text"))
