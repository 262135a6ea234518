"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words form one automaton; documents are streamed through it, which gives at each word
the longest match that ends there. A match of ``window`` words, or of a whole shorter item, marks
its words as hit. Spans of hit words are then removed, or the whole document where they cover most.

Test items are cut into blocks of at most ``BLOCK_BYTES`` of text; one automaton is broadcast at a
time and each block sees every document, so neither driver nor worker holds more than one block.

Defined results: null, empty or wordless texts have no words and no hits; items without words are
ignored; a null item id reads ``null``; repeated documents are separate rows with equal results;
without items nothing is hit. Other columns never take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import WORD_BYTES, column_bytes, mapped, plain_words, written

WINDOW = 10
BLOCK_BYTES = 1 << 20
PAIR_BITS = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class ItemAutomaton:
    """Every word sequence that occurs in an item, as states; root is state 0."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in plain_words(text)]
            if ids:
                sequences.append((item, ids))
        self.shortest = min([window, *(len(ids) for _, ids in sequences)])
        ends: dict[int, set[str]] = {}
        for item, ids in sequences:
            at = 0
            for w in ids:
                at = self._extend(at, w)
            if len(ids) < window:
                ends.setdefault(at, set()).add(item)
        self.ends = ends
        self.owners: dict[int, set[str]] = {}
        for item, ids in sequences:
            if len(ids) >= window:
                for state, matched in self.walk(ids):
                    if matched >= window:
                        self.owners.setdefault(self.windowed(state), set()).add(item)
        self._short: dict[int, list[tuple[int, set[str]]]] = {}
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, ids in sequences:
            a = np.array(ids, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B) & ((1 << PAIR_BITS) - 1)

    def _extend(self, last: int, w: int) -> int:
        """The state of ``last``'s string with ``w`` behind it."""
        made = self.next[last].get(w)
        if made is not None:
            if self.length[made] == self.length[last] + 1:
                return made
            return self._split(last, w, made)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _split(self, p: int, w: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def walk(self, ids) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest match that ends there."""
        state = matched = 0
        follow, link, length = self.next, self.link, self.length
        for w in ids:
            while state and w not in follow[state]:
                state = link[state]
                matched = length[state]
            if w in follow[state]:
                state = follow[state][w]
                matched += 1
            yield state, matched

    def windowed(self, state: int) -> int:
        """The state of the last ``window`` words of a match in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def short(self, state: int) -> list[tuple[int, set[str]]]:
        """Whole items shorter than the window that end here: ``(words, items)``."""
        known = self._short.get(state)
        if known is None:
            known, at = [], state
            while at > 0:
                if at in self.ends:
                    known.append((self.length[at], self.ends[at]))
                at = self.link[at]
            self._short[state] = known
        return known

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and by which items.

        Only stretches whose every neighbouring pair occurs in some item can hold a match of more
        than one word; the rest would bring the automaton back to its root and is passed over.
        """
        n = len(words)
        marks, items = np.zeros(n + 1, np.int32), set()
        if not self.words or n < self.shortest:
            return marks[:n] > 0, items
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        joined &= self.pairs[self._pair(ids[:-1], ids[1:])]
        cuts = np.flatnonzero(~joined) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
        for a, b in zip(starts.tolist(), stops.tolist()) if self.shortest == 1 else self._long(starts, stops):
            if ids[a] < 0:
                continue
            for at, (state, matched) in enumerate(self.walk(ids[a:b].tolist()), a + 1):
                if matched >= self.window:
                    marks[at - self.window] += 1
                    marks[at] -= 1
                    items |= self.owners[self.windowed(state)]
                if self.ends:
                    for size, whole in self.short(state):
                        if size <= matched:
                            marks[at - size] += 1
                            marks[at] -= 1
                            items |= whole
        return np.cumsum(marks[:n]) > 0, items

    def _long(self, starts, stops):
        keep = stops - starts >= self.shortest
        return zip(starts[keep].tolist(), stops[keep].tolist())


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


class _Block:
    """One broadcast block of items; its automaton is built once in each Python worker."""

    built: tuple | None = None

    def __init__(self, shared, window: int):
        self.shared, self.window = shared, window

    def automaton(self) -> ItemAutomaton:
        items = self.shared.value
        if _Block.built is None or _Block.built[0] is not items:
            _Block.built = (items, ItemAutomaton(items, self.window))
        return _Block.built[1]


def n_blocks(items: DataFrame, text: str) -> int:
    return (items.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) // BLOCK_BYTES + 1


def _blocks(items: DataFrame, item: str, text: str, window: int, n: int) -> Iterator[tuple[_Block, bool]]:
    """The items in ``n`` blocks of bounded size, broadcast one by one."""
    spark = items.sparkSession
    chosen = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.encode(F.col(text), "utf-8").alias("text"))
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for b in range(n):
        rows = [(r.item, bytes(r.text)) for r in chosen.where(F.col("block") == b).collect() if r.text]
        yield _Block(spark.sparkContext.broadcast(sorted(set(rows))), window), b == n - 1


_PAIRS = "array<struct<start:int,stop:int>>"
_HITS = f"n_words long, n_hit long, items array<string>, spans {_PAIRS}"


def scan(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, n_words, n_hit, items, spans)`` of each document; spans are word ranges, end exclusive."""
    kind = docs.schema[key].dataType.simpleString()
    state = docs.select(F.col(key), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    for block, last in _blocks(items, item, item_text, window, n_blocks(items, item_text)):

        def run(batches, block=block):
            automaton = block.automaton()
            for batch in batches:
                out: dict = {c: [] for c in ("n_words", "n_hit", "items", "spans")}
                for body, found, spans in zip(column_bytes(batch, "text"), batch.column("items").to_pylist(), batch.column("spans").to_pylist()):
                    words = plain_words(body)
                    hit, more = automaton.hits(words)
                    for s in spans:
                        hit[s["start"] : s["stop"]] = True
                    out["n_words"].append(len(words))
                    out["n_hit"].append(int(hit.sum()))
                    out["items"].append(sorted({*found, *more}))
                    out["spans"].append([{"start": a, "stop": b} for a, b in _runs(hit)])
                pair = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("text"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pair))], [key, *batch.schema.names[1:]])

        state = mapped(state, run, f"`{key}` {kind}, text string, {_HITS}")
        if not last:
            state = written(state, "decontamination")
    return state.drop("text")


def without(body: bytes, hit: np.ndarray, max_words: int, max_coverage: float) -> bytes | None:
    """``body`` without its spans of over ``max_words`` hit words; None where hits cover over ``max_coverage``."""
    if int(hit.sum()) > max_coverage * len(hit):
        return None
    spans = [(a, b) for a, b in _runs(hit) if b - a > max_words]
    if not spans:
        return body
    places = [m.span() for m in _WORD.finditer(body.translate(WORD_BYTES))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, body[at:]])


def remove_spans(body: bytes, automaton: ItemAutomaton, max_words: int, max_coverage: float) -> bytes | None:
    """``without`` of the hits of one automaton, until nothing changes.

    Where hits stay below both limits the text is returned as it is. What is left is streamed
    again, as removal may join the two halves of another item.
    """
    while True:
        left = without(body, automaton.hits(plain_words(body))[0], max_words, max_coverage)
        if left is None or left == body:
            return left
        body = left


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", length: str | None = "n_chars", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``, and without documents that hits mostly cover.

    All columns are kept; ``length`` (if there is such a column) is counted anew where text changed.

    With several blocks of items a round first gathers the hits of all of them on the same text,
    then decides and cuts; the changed documents go through further rounds until none changes. The
    result is the one that a single block would give.
    """
    n = n_blocks(items, item_text)
    if n == 1:
        (block, _), *_ = _blocks(items, item, item_text, window, n)

        def run(batches):
            automaton = block.automaton()
            for batch in batches:
                left = [body and remove_spans(body, automaton, max_words, max_coverage) for body in column_bytes(batch, text)]
                yield _kept(batch, text, length, left)

        return mapped(docs, run, docs.schema)

    name = _unused("hits", docs.columns)
    state = docs.withColumn(name, F.array().cast(_PAIRS))
    settled = []
    while True:
        for block, last in _blocks(items, item, item_text, window, n):
            state = written(mapped(state, _gathering(block, last, text, length, name, max_words, max_coverage), state.schema), "decontamination")
        settled.append(state.where(F.size(name) == 0).drop(name))
        state = state.where(F.size(name) > 0)
        if state.isEmpty():
            break
        state = state.withColumn(name, F.array().cast(_PAIRS))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _gathering(block: _Block, last: bool, text: str, length: str | None, name: str, max_words: int, max_coverage: float):
    """One block's pass of a round: its hits are added to ``name``; the last one cuts and leaves there one pair where the text changed."""

    def run(batches):
        automaton = block.automaton()
        for batch in batches:
            at, pairs, left = batch.schema.names.index(name), [], []
            for body, spans in zip(column_bytes(batch, text), batch.column(name).to_pylist()):
                hit, _ = automaton.hits(plain_words(body))
                for s in spans:
                    hit[s["start"] : s["stop"]] = True
                if last:
                    left.append(body and without(body, hit, max_words, max_coverage))
                    pairs.append([{"start": 0, "stop": 0}] * (left[-1] is not None and left[-1] != body))
                else:
                    pairs.append([{"start": a, "stop": b} for a, b in _runs(hit)])
            columns = [pa.array(pairs, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
            told = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield _kept(told, text, length, left) if last else told

    return run


def _kept(batch: pa.RecordBatch, text: str, length: str | None, left: list[bytes | None]) -> pa.RecordBatch:
    """``batch`` with the texts that are left, without the rows whose text is dropped."""
    keep = [b is not None or was is None for b, was in zip(left, column_bytes(batch, text))]
    return replaced(batch, text, length, left).filter(pa.array(keep, pa.bool_()))


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def replaced(batch: pa.RecordBatch, text: str, length: str | None, bodies: list[bytes | None]) -> pa.RecordBatch:
    """``batch`` with new texts, and lengths counted anew where the text has changed."""
    old, names = list(column_bytes(batch, text)), batch.schema.names
    columns = [batch.column(c) for c in range(batch.num_columns)]
    at = names.index(text)
    columns[at] = pa.array(bodies, pa.binary()).cast(columns[at].type)
    if length in names:
        k = names.index(length)
        counts = [v if a == b or b is None else len(b.decode()) for v, a, b in zip(columns[k].to_pylist(), old, bodies)]
        columns[k] = pa.array(counts, columns[k].type)
    return pa.RecordBatch.from_arrays(columns, names)
