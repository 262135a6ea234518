"""Token ids in files: fixed-size blocks, transposed into byte or bit planes, each plane compressed.

``write`` puts documents in ascending key order, cuts each range of keys (a shard) into chunks of
whole documents, and stores one row per chunk: the chunk index (shard, chunk, first id, number of
ids, the documents with their lengths, the blocks with the compressed sizes of their planes) beside
the payload, which is the planes one behind the other. The rows are Parquet files written by
Spark's committer, so a lost task leaves nothing half written. ``read`` needs a chunk's row only.

Ids are unsigned 32-bit. A block of ``BLOCK`` ids becomes four byte planes (the k-th holds the k-th
byte of every id) or 32 bit planes; high planes of a small vocabulary are constant and vanish.

Defined results: a null text is an empty text and holds just the end id; null keys come first;
repeated keys keep all their rows, ordered by text; an empty table gives no chunks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftgate.llm.common import Recent, mapped, slices, units
from siftgate.sources.storage import scratch

BLOCK = 1 << 16
CHUNK_IDS = 1 << 20
UNITS_KEPT = 500_000
SLICE_BYTES = 8 << 20
LEVEL = 3

#: The published pre-tokenization pattern of byte-level vocabularies, and the letters that stand for bytes in them.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [np.packbits(plane).tobytes() for plane in np.unpackbits(raw, axis=1, bitorder="little").T]
    return [plane.tobytes() for plane in raw.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        raw = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")


def pack(ids: np.ndarray, bits: bool = False) -> tuple[list[list[int]], bytes]:
    """``(block index, payload)``; the index has, per block, its ids and then its planes' compressed sizes."""
    press, index, parts = zstandard.ZstdCompressor(level=LEVEL), [], []
    for at in range(0, len(ids), BLOCK):
        block = ids[at : at + BLOCK]
        planes = [press.compress(p) for p in to_planes(block, bits)]
        index.append([len(block), *map(len, planes)])
        parts += planes
    return index, b"".join(parts)


def unpack(index: list[list[int]], payload: bytes) -> np.ndarray:
    press, out, at, view = zstandard.ZstdDecompressor(), [], 0, memoryview(payload)
    for n, *sizes in index:
        planes = []
        for size in sizes:
            planes.append(press.decompress(view[at : at + size]))
            at += size
        out.append(from_planes(planes, n))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


#: A space before white space or the end, in the syntax of Arrow's patterns.
ODD_SPACE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"

#: A space in those letters, and marks that the pattern gives a piece of their own after a word.
SPACE = LETTERS[32]
CLOSING = ".,:;!?"


class Ids:
    """Texts to ids by the tokenizers library's own model; ids of recent stretches and pieces are kept as bytes.

    The library's full pipeline spends most of its time on alignments nobody reads. A byte-level
    vocabulary without normalizer needs only its two steps: the pieces of the pattern, in the
    printable letters that stand for bytes, each given to the model. The tokens added to the
    vocabulary are found in the text first, as the library does, and part it. Texts that hold an
    added token with a rule of its own (the white space or word borders around it, or rules that
    differ between tokens) go to the library as they are.
    """

    built: tuple | None = None

    def __init__(self, description: str):
        self.library = Tokenizer.from_str(description)
        self.model = self.library.model
        self.pieces = regex.compile(PIECES).findall
        added = [t for t in json.loads(description).get("added_tokens") or [] if t["content"]]
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        ruled = any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added)
        self.plainly = not ruled and len({bool(t.get("normalized")) for t in added}) < 2
        self.recent, self.known = Recent(UNITS_KEPT), Recent(UNITS_KEPT)

    @staticmethod
    def of(description: str) -> Ids:
        if Ids.built is None or Ids.built[0] is not description:
            Ids.built = (description, Ids(description))
        return Ids.built[1]

    def unit(self, unit: str) -> bytes:
        return b"".join(map(self.piece, self.pieces(unit)))

    def word(self, word: str) -> bytes:
        """The ids of a space and ``word``; plain letters, alone or before a closing mark, need no pattern."""
        if word.isascii():
            if word.isalpha():
                return self.tokens(SPACE + word)
            if word[-1] in CLOSING and (plain := word[:-1]).isalpha():
                ids = self.recent.get(plain) or self.recent.find(plain) or self.recent.put(plain, self.tokens(SPACE + plain))
                return ids + self.piece(word[-1])
        return self.unit(" " + word)

    def tokens(self, spelt: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None and (ids := self.known.find(piece)) is None:
            plain = piece[1:] if piece[0] == " " else piece
            if plain.isascii() and plain.isalpha():
                spelt = piece.replace(" ", SPACE)
            else:
                spelt = piece.encode().decode("latin-1").translate(LETTERS)
            ids = self.known.put(piece, self.tokens(spelt))
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text or self.marks is None or not self.marks.search(text):
            return self.stretch(text)
        if not self.plainly:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.marks.split(text)
        return b"".join(self.added[part] if k % 2 else self.stretch(part) for k, part in enumerate(parts))

    def stretch(self, text: str | None) -> bytes:
        """The ids of a text, or of a part of one, without added tokens."""
        if not text:
            return b""
        first, rest = units(text)
        return self.unit(first) + b"".join(self.look_up(rest))

    def look_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.recent.get, words))
        if None in found:
            find, put, word = self.recent.find, self.recent.put, self.word
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = find(words[k]) or put(words[k], word(words[k]))
        return found

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """As :meth:`encode` of each text; a stretch that several of them hold is looked up once.

        Texts in which a space is not followed by a word, or which hold an added token, go one by one.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for mark in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        stops = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        flat = split.flatten()
        head = np.zeros(len(flat), bool)
        head[stops[:-1]] = True
        coded = flat.filter(pa.array(~head)).dictionary_encode()
        found = self.look_up(coded.dictionary.to_pylist())
        index = np.empty(len(flat), np.int64)
        index[~head] = coded.indices.to_numpy()
        index[head] = len(found) + np.arange(len(stops) - 1)
        found += map(self.unit, flat.filter(pa.array(head)).to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, n = (np.cumsum(size) - size)[index], size[index]
        ends = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[stops]).tolist()
        plain = iter([ids[a:b] for a, b in zip(cuts, cuts[1:])])
        alone = iter(map(self.encode, texts.filter(odd).to_pylist()))
        return [next(alone if o else plain) for o in odd.to_pylist()]


def write(docs: DataFrame, description: str, path: str, *, key: str = "doc_id", text: str = "text", end: int = 0, bits: bool = False, shards: int | None = None) -> None:
    """Encode whole texts, append ``end`` to each document and write the chunks to ``path``.

    ``description`` is the tokenizer's JSON (a fixed vocabulary, broadcast once).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(description)
    kind = docs.schema[key].dataType.simpleString()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        ids = Ids.of(shared.value)
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        keys, bodies, size = [], [], 0

        def row():
            lengths = [len(b) // 4 for b in bodies]
            index, payload = pack(np.frombuffer(b"".join(bodies), "<u4"), bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([start], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([keys], pa.list_(batch.schema.field("key").type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([index], pa.list_(pa.list_(pa.int32()))), pa.array([payload], pa.binary())], names)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for k, body in zip(part.column("key").to_pylist(), ids.encode_many(part.column("text"))):
                    keys.append(k)
                    bodies.append(body + tail)
                    size += len(body) // 4 + 1
                    if size >= CHUNK_IDS:
                        yield row()
                        chunk, start = chunk + 1, start + size
                        keys, bodies, size = [], [], 0
        if keys:
            yield row()

    names = ["shard", "chunk", "start", "n_ids", "keys", "lengths", "blocks", "payload"]
    schema = f"shard int, chunk int, start long, n_ids long, keys array<{kind}>, lengths array<long>, blocks array<array<int>>, payload binary"
    mapped(ordered, run, schema).write.parquet(path)


def documents(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` read back from the chunks, with ``ids`` as little-endian bytes if wanted.

    ``start`` counts the ids of all documents before this one: those of earlier shards (one row per
    shard is summed up), of earlier chunks and of earlier documents in the chunk.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, keys, lengths, blocks, payload = (batch.column(c)[row].as_py() for c in ("shard", "start", "keys", "lengths", "blocks", "payload"))
                body = unpack(blocks, payload).tobytes()
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - np.array(lengths, np.int64)
                ids = [body[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([shard] * len(keys), pa.int32()), pa.array(keys, batch.schema.field("keys").type.value_type), pa.array(starts + start), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    names = ["shard", key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    found = mapped(chunks, run, f"shard int, `{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(before, "shard").select(key, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *names[5:])


def round_trip(docs: DataFrame, description: str, *, key: str = "doc_id", text: str = "text", end: int = 0, bits: bool = False, with_ids: bool = True) -> DataFrame:
    """Write the documents' ids to a fresh folder under the shared scratch folder and read them back."""
    path = scratch(docs.sparkSession, "token-files")
    write(docs, description, path, key=key, text=text, end=end, bits=bits)
    return documents(docs.sparkSession, path, key, with_ids)
