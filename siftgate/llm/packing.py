"""Best-fit decreasing packing of token sequences, over all documents at once.

``pieces`` turns texts into ids, ends each document with an end id and cuts documents longer than a
sequence. ``place`` gives every piece its sequence and its offset there. ``sequences`` puts the ids
of each sequence together.

Best-fit decreasing looks at a piece's length only, and lengths are whole numbers up to the
capacity. So the decisions are taken once for the table of lengths, at most ``capacity`` rows at
any corpus size: lengths descend, and each finds the tightest open sequence in a segment tree over
what is left in the open ones, in steps logarithmic in the capacity. Sequences with the same room
are ranges of numbers, filled alike in one step; the outcome is what placing one piece after the
other gives. A step covers a run of pieces in the order of descending length, so each task places
its own pieces by their position in that order. Nothing but the table of lengths and the steps
reaches the driver, and a length that a third of all pieces share is dealt to many tasks.

Defined results: a null text is an empty text, its one piece holds the end id; null and repeated
keys are kept, each row by itself; an empty table gives no pieces. ``place`` keeps all columns but
``sequence_id`` and ``offset``, which it replaces, and refuses lengths below 1 or over the capacity.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftgate.llm.common import Recent, kept_as, mapped, ranked, slices
from siftgate.llm.token_files import LETTERS
from siftgate.options import OptionError
from siftgate.sources.storage import drop_scratch, scratch

CAPACITY = 4096
WORDS_KEPT = 250_000
SLICE_BYTES = 8 << 20
ROW_IDS = 1 << 22

#: The normalizer and the pre-tokenizer of the vocabulary whose words are read one by one.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": PIECE}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_PLAIN_ASCII = re.compile(r"[!-~]+").fullmatch
#: Letters whose lower case is one letter and which normalization leaves alone.
_PLAIN_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+").fullmatch


class Ids:
    """Texts to ids by the tokenizers library; each distinct word of a slice is looked up once.

    A vocabulary that drops white space encodes every word by itself. Words of plain letters go to
    the library's model directly, words of printable ASCII in the pieces of the fixed pattern, and
    all others through the whole library. Ids of recent words are kept. Texts for a vocabulary of
    another kind go through the library whole.
    """

    built: tuple | None = None

    def __init__(self, description: str):
        self.library = Tokenizer.from_str(description)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.recent, self.known = self.library.model, Recent(WORDS_KEPT), Recent(WORDS_KEPT)
        said = json.loads(description)
        added = [t for t in said.get("added_tokens") or [] if t["content"]]
        self.marks = tuple(t["content"] for t in added)
        plain = all(not (t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")) and t["content"].split() == [t["content"]] for t in added)
        self.by_word = plain and (said.get("normalizer") or {}).get("normalizers") == NORMALIZER and (said.get("pre_tokenizer") or {}).get("pretokenizers") == SPLITTER

    @staticmethod
    def of(description: str) -> Ids:
        if Ids.built is None or Ids.built[0] is not description:
            Ids.built = (description, Ids(description))
        return Ids.built[1]

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if _PLAIN_LETTERS(word):
            return self.piece(word.lower())
        if _PLAIN_ASCII(word) and not any(mark in word for mark in self.marks):
            return b"".join(map(self.piece, _ASCII_PIECES(word.lower())))
        return self.whole(word)

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None and (ids := self.known.find(piece)) is None:
            spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
            ids = self.known.put(piece, array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes())
        return ids

    def look_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.recent.get, words))
        if None in found:
            find, put = self.recent.find, self.recent.put
            for k, ids in enumerate(found):
                if ids is None:
                    ids = find(words[k])
                    found[k] = put(words[k], self.word(words[k])) if ids is None else ids
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and how many each text has with it."""
        texts = pc.fill_null(texts, "")
        if self.by_word:
            words = pc.ascii_split_whitespace(texts)
            ends = words.offsets.to_numpy()
            ends = (ends - ends[0])[1:]
            coded = words.flatten().dictionary_encode()
            index, found = coded.indices.to_numpy(), self.look_up(coded.dictionary.to_pylist())
        else:
            ends, index, found = np.arange(1, len(texts) + 1), np.arange(len(texts)), list(map(self.whole, texts.to_pylist()))
        index = np.insert(index.astype(np.int64), ends, len(found))
        found.append(array("I", [end]).tobytes())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.cumsum(size) - size
        store = np.frombuffer(b"".join(found), "<u4")
        n = size[index]
        stop = np.cumsum(n)
        ids = store[np.repeat(at[index] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        last = stop[ends + np.arange(len(ends))]
        return ids, np.diff(last, prepend=0)


def pieces(docs: DataFrame, description: str, *, key: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, start, length, ids)``: whole texts as ids (little-endian unsigned 32-bit), ``end`` behind each.

    Only documents longer than ``capacity`` are cut, into pieces of that length; the last may be
    shorter. ``start`` counts the document's ids before the piece. ``description`` is the
    tokenizer's JSON (a fixed vocabulary, broadcast once).
    """
    names = ["piece", "start", "length", "ids"]
    if key in names:
        raise OptionError(f"the key may not be called {key!r}")
    shared = docs.sparkSession.sparkContext.broadcast(description)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = Ids.of(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, n = encoder.encode(part.column("text"), end)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(capacity, n[row] - piece * capacity)
                stop = np.cumsum(length)
                cuts = np.searchsorted(stop, np.arange(ROW_IDS, (stop[-1] if len(stop) else 0) + ROW_IDS, ROW_IDS), "right")
                at = 0
                for to in np.unique(np.append(cuts, len(row))).tolist():
                    if to > at:
                        first = stop[at] - length[at]
                        offsets = np.append(0, stop[at:to] - first).astype(np.int32) * 4
                        body = np.ascontiguousarray(ids[first : stop[to - 1]])
                        held = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row[at:to])), pa.array(piece[at:to], pa.int32()), pa.array(piece[at:to] * capacity, pa.int64()), pa.array(length[at:to], pa.int64()), held], [key, *names])
                        at = to

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return mapped(source, run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


class Room:
    """Open sequences by the room left in them: a segment tree whose nodes say whether any below is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, n: int) -> None:
        """``n`` sequences numbered from ``first`` have room for ``left`` more."""
        if n and left:
            self.ranges[left].append((first, n))
            node = self.leaves + left
            while node and not self.open[node]:
                self.open[node] = 1
                node >>= 1

    def take(self, left: int) -> tuple[int, int]:
        taken = self.ranges[left].pop()
        node = self.leaves + left
        if not self.ranges[left]:
            self.open[node] = 0
            while node > 1 and not self.open[node ^ 1]:
                node >>= 1
                self.open[node] = 0
        return taken

    def tightest(self, least: int) -> int | None:
        """The smallest room of an open sequence that is not below ``least``."""
        node = self.leaves + least
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for ``counts[length]`` pieces: ``(steps, sequences used)``.

    A step is ``(position of its first piece in descending length, its first sequence, pieces of
    it that share a sequence, offset of the first of these)``.
    """
    room, steps, position, used = Room(capacity), [], 0, 0
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            left = room.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, n = used, -(-todo // each)
                used += n
            else:
                first, n = room.take(left)
                each = left // length
            full = min(n, todo // each)
            some = todo - full * each if full < n else 0
            steps.append((position, first, each, capacity - left))
            room.put(left - each * length, first, full)
            touched = full + (some > 0)
            if some:
                room.put(left - some * length, first + full, 1)
            room.put(left, first + touched, n - touched)
            position += full * each + some
            todo -= full * each + some
    return np.array(steps, np.int64).reshape(-1, 4), used


def place(pieces: DataFrame, *, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` (from 0) and ``offset``: sequences without gaps, no longer than ``capacity``."""
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    path = scratch(spark, "packing-pieces")
    rows = kept_as(pieces.select(F.struct(*columns).alias("row"), F.col(length).cast("long").alias("length")), path)
    fits = F.col("length").between(1, capacity)
    counts = dict(map(tuple, rows.groupBy(F.when(fits, F.col("length")).alias("length")).count().collect()))  # a row per length
    if None in counts:
        raise OptionError(f"{counts[None]} pieces are empty or longer than {capacity}")
    shared = spark.sparkContext.broadcast(plan(counts, capacity)[0])
    placed = ranked(rows, [-F.col("length")], "packing-order").select("row", "length", "position")
    drop_scratch(spark, path)

    def run(batches: Iterator[pa.RecordBatch]):
        begin, first, each, at = shared.value.T
        for batch in batches:
            position, size = (batch.column(c).to_numpy() for c in ("position", "length"))
            step = np.searchsorted(begin, position, "right") - 1
            k = position - begin[step]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(first[step] + k // each[step]), pa.array(at[step] + k % each[step] * size)], ["row", "sequence_id", "offset"])

    found = mapped(placed, run, f"row {placed.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return found.select("row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_ids, ids)`` from placed pieces with their ``ids``; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
