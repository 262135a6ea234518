"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can stand last in its encoding.
``Merges.prefixes`` stores that token per prefix: it is the token ``t`` ending there for which the
prefix before ``t`` ends in a token that stays apart from ``t`` under the merge ranks. Reading the
table back from its end gives the encoding. Because an entry depends only on the entries of the
last ``longest`` bytes, bytes can be appended exactly, and after an edit the table is recomputed
only until ``longest`` entries agree with the old ones.

Texts are cut into pieces by the vocabulary's pattern first; ``Encoder`` does that and keeps the
ids of recent stretches. ``encode`` and ``decode`` are the DataFrame operators.

Defined results: a null text is an empty text, which has no ids; repeated rows have equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.llm.common import Recent, column_text, mapped, units

UNITS_KEPT = 300_000
PAIRS_KEPT = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Which tokens may stand next to each other, and the prefix table of a byte string."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.sizes.values(), default=1)
        found = ahocorasick.Automaton()
        for token, rank in ranks.items():
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        #: All tokens in a text of bytes, as ``(last byte, (token, bytes))``
        self.matches = found.iter
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._usable: dict[int, bool] = {}
        self._apart: dict[int, dict[int, bool]] = {rank: {} for rank in ranks.values()}
        self._room = PAIRS_KEPT
        self._edges: dict[tuple[int, int], list] = {}

    def merged(self, body: bytes, below: int | None = None) -> list[int]:
        """Plain greedy merging of the lowest ranks, those under ``below`` only."""
        ranks = self.ranks
        parts = [body[i : i + 1] for i in range(len(body))]
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60 or (below is not None and rank >= below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token no merge makes."""
        if token not in self._halves:
            body = self.tokens[token]
            parts = self.merged(body, token) if len(body) > 1 else ()
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def makes(self, token: int) -> bool:
        known = self._usable[token] = len(self.tokens[token]) == 1 or self.halves(token) is not None
        return known

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The parts of ``token`` on one side, largest first: ``(part, rank it is made at, rank it ends at)``."""
        known = self._edges.get((token, side))
        if known is None:
            known, end, part = [], 1 << 60, token
            while True:
                pair = self.halves(part)
                known.append((part, part if pair else -1, end))
                if not pair:
                    break
                end, part = part, pair[side]
            self._edges[token, side] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives just these two tokens.

        At every moment of the merging one part on the left's right edge touches one on the right's
        left edge. The two stay apart if no such pair would be merged before either part grows; of
        equal ranks the leftmost merge goes first.
        """
        if self._room == 0:
            self._room = PAIRS_KEPT
            for known in self._apart.values():
                known.clear()
        self._room -= 1
        known = self._apart[left][right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        ranks, tokens = self.ranks, self.tokens
        lefts, rights = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_made, a_end), (b, b_made, b_end) = lefts[i], rights[j]
            rank = ranks.get(tokens[a] + tokens[b])
            if rank is not None and rank < a_end and rank <= b_end:
                return False
            if a_made < 0 and b_made < 0:
                return True
            if a_made > b_made or (a_made == b_made and b_made >= 0):
                i += 1
            else:
                j += 1

    def prefixes(self, body: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix; ``known`` holds the entries of the first bytes."""
        usable, pairs, apart = self._usable, self._apart, self.apart
        last = list(known or ())
        first, done = max(0, len(last) - self.longest), len(last)
        for end, (token, size) in self.matches(body[first:].decode("latin-1") if first else body.decode("latin-1")):
            end += first
            if end < done:
                continue
            if end >= size:
                before = last[end - size]
                stay = pairs[before].get(token)
                if not (apart(before, token) if stay is None else stay):
                    continue
            if usable[token] if token in usable else self.makes(token):
                last.append(token)
                done += 1
        return last

    def read(self, last: list[int]) -> list[int]:
        out, at, sizes = [], len(last), self.sizes
        while at:
            out.append(last[at - 1])
            at -= sizes[last[at - 1]]
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.prefixes(piece))

    def edited(self, body: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """``body`` with ``[start, stop)`` replaced, and its table, recomputed only near the edit."""
        changed = body[:start] + new + body[stop:]
        table, shift, agreed = list(last[:start]), len(new) - (stop - start), 0
        while len(table) < len(changed):
            at = len(table)
            table = self.prefixes(changed[: at + 1], table)
            if at >= start + len(new):
                agreed = agreed + 1 if table[at] == last[at - shift] else 0
                if agreed >= self.longest:
                    return changed, table + last[at + 1 - shift :]
        return changed, table


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = UNITS_KEPT):
        self.merges = Merges(ranks)
        self.pieces = regex.compile(pattern).findall
        self.recent = Recent(kept)

    def unit(self, unit: str) -> tuple[int, ...]:
        encode = self.merges.encode_piece
        return tuple(i for piece in self.pieces(unit) for i in encode(piece.encode()))

    def encode(self, text: str) -> list[int]:
        first, rest = units(text)
        get, find, put, out = self.recent.get, self.recent.find, self.recent.put, list(self.unit(first))
        for u in rest:
            out += get(u) or find(u) or put(u, self.unit(" " + u))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


class Appending:
    """A piece's encoding while bytes are appended to it."""

    def __init__(self, merges: Merges):
        self.merges, self.body, self.last = merges, b"", []

    def append(self, more: bytes) -> list[int]:
        self.body += more
        self.last = self.merges.prefixes(self.body, self.last)
        return self.merges.read(self.last)


class Vocabulary:
    """A broadcast rank table (tens of thousands of entries, fixed) and one encoder per Python worker."""

    built: tuple | None = None

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.shared, self.pattern = spark.sparkContext.broadcast(read_ranks(path)), pattern

    def encoder(self) -> Encoder:
        ranks = self.shared.value
        if Vocabulary.built is None or Vocabulary.built[0] is not ranks or Vocabulary.built[1] != self.pattern:
            Vocabulary.built = (ranks, self.pattern, Encoder(ranks, self.pattern))
        return Vocabulary.built[2]


def encode(docs: DataFrame, path: str, pattern: str, *, keep: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and the ids of the whole text as ``array<int>``."""
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    frame = docs.select(*keep, F.col(text).alias("__text"))
    schema = frame.select(*keep, F.array().cast("array<int>").alias(ids)).schema

    def run(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            for small in _sliced(batch):
                found = pa.array([encoder.encode(t) if t else [] for t in column_text(small, "__text")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*small.columns[:-1], found], schema.names)

    return mapped(frame, run, schema)


def _sliced(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(frame: DataFrame, path: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the decoded bytes of ``ids`` in place of it."""
    vocabulary = Vocabulary(frame.sparkSession, path, pattern)
    kept = [c for c in frame.columns if c != ids]
    schema = frame.select(*kept, F.lit(b"").alias(out)).schema

    def run(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            body = pa.array([encoder.decode(i) for i in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), body], schema.names)

    return mapped(frame, run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep`` with ``n_tokens``, ``ids_sha256`` of the ids, and ``decoded_sha256`` of what they decode to.

    Encoding and decoding share a task, so the ids need not travel in between.
    """
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    frame = docs.select(*keep, F.col(text).alias("__text"))
    extra = [F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    schema = frame.select(*keep, *extra, *([F.array().cast("array<int>").alias("ids")] if with_ids else [])).schema

    def run(batches):
        encoder = vocabulary.encoder()
        for batch in batches:
            for small in _sliced(batch):
                counts, shas, bodies, all_ids = [], [], [], []
                for t in column_text(small, "__text"):
                    ids = encoder.encode(t) if t else []
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    bodies.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                found = [pa.array(counts, pa.int64()), pa.array(shas), pa.array(bodies)]
                if with_ids:
                    found.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*small.columns[:-1], *found], schema.names)

    return mapped(frame, run, schema)
