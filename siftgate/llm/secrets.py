"""Secret scans over every decoded layer of a text.

A worklist starts with the text itself. Each layer is scanned for secrets; then its URL escapes,
its Unicode and byte escapes, and each of its base64 runs (at all four alignments, over line breaks, as
UTF-8, UTF-16 or stretches of ASCII, and inflated where gzip, zlib, bzip2, xz or zstandard members
stand in the bytes) give further layers, until nothing new appears. A layer whose text stands
above it already is a cycle and ends. Every layer knows, for each of its characters, the range of
the original text it came from, so a secret found three layers down is reported where it stands in
the text; inside compressed bytes that is the whole run.

Defined results: a null text is an empty text; a layer beyond ``max_layer`` bytes is counted in
``n_refused`` and read in overlapping pieces of that size, ``PIECES`` of them in a text (the
protection against compression bombs; the text itself has no such bound); repeated rows have equal results; other columns never take part.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import LOWER, column_bytes, mapped
from siftgate.llm.decontamination import replaced

#: The kinds in their order, with the fewest characters that count.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 16

MAX_LAYER = 64 << 20
BASE64_LEAST = 20
#: Packed bytes given to a decompressor at once, and most that it gives back at once.
FEED, STEP = 1 << 10, 1 << 20
#: Layers beyond ``max_layer`` are read in pieces that overlap by so much, at most so many in a text.
OVERLAP, PIECES = 1 << 16, 64

_WORDS = (b"passw", b"secret", b"token", b"api")
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_B64_MAP = bytes(120 if chr(b).isalnum() and b < 128 or chr(b) in "+/-_" else 32 for b in range(256))
_B64_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % BASE64_LEAST)
_LINE = r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t>]*+"
_BREAK = re.compile(_LINE)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:%s[A-Za-z0-9+/_-]++)++={0,2}" % (BASE64_LEAST, _LINE))
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_STRETCH = re.compile(rb"[\x20-\x7e\t\n\r]{%d,}" % HEX_LEAST)
_WIDE = re.compile(rb"(?:[\x20-\x7e\t\n\r]\x00){%d,}" % HEX_LEAST)
_WIDE_BIG = re.compile(rb"(?:\x00[\x20-\x7e\t\n\r]){%d,}" % HEX_LEAST)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|((?:\\x[0-9A-Fa-f]{2})+)|\\U([0-9A-Fa-f]{8})")

Span = tuple[int, int, int]


def base_spans(text: str, body: bytes) -> Iterator[Span]:
    """``(kind number, start, end)`` of one layer. ``body`` is the text in UTF-8, for quick refusals."""
    low = body.translate(LOWER)
    if any(w in low for w in _WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield 0, *m.span()
    if b"AKIA" in body:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield 1, *m.span()
    if b"x" * HEX_LEAST in body.translate(_HEX_MAP):
        for m in _HEX_RUN.finditer(text):
            yield 2, *m.span()


class Layer:
    """A decoded text; character ``i`` came from ``[starts[i], stops[i])`` of the original (None: from itself)."""

    def __init__(self, text: str, starts: list[int] | None, stops: list[int] | None, above: frozenset[bytes]):
        self.text, self.starts, self.stops = text, starts, stops
        self.body = text.encode("utf-8", "surrogatepass")
        self.digest = hashlib.blake2b(self.body, digest_size=16).digest()
        self.above = above

    def origin(self, start: int, stop: int) -> tuple[int, int]:
        if self.starts is None:
            return start, stop
        return min(self.starts[start:stop]), max(self.stops[start:stop])

    def child(self, text: str, starts: list[int], stops: list[int]) -> Layer:
        return Layer(text, starts, stops, self.above | {self.digest})


def _rewritten(layer: Layer, pattern: re.Pattern, read) -> Layer | None:
    """The layer with every match replaced by ``read(match)``: a list of ``(character, from, to)`` within it."""
    pieces, starts, stops, at, text = [], [], [], 0, layer.text

    def plain(a: int, b: int) -> None:
        pieces.append(text[a:b])
        starts.extend(layer.starts[a:b] if layer.starts else range(a, b))
        stops.extend(layer.stops[a:b] if layer.stops else range(a + 1, b + 1))

    for m in pattern.finditer(text):
        got = read(m)
        if not got:
            continue
        plain(at, m.start())
        for c, a, b in got:
            pieces.append(c)
            lo, hi = layer.origin(m.start() + a, m.start() + b)
            starts.append(lo)
            stops.append(hi)
        at = m.end()
    if not at:
        return None
    plain(at, len(text))
    return layer.child("".join(pieces), starts, stops)


def _characters(raw: bytes, width: int) -> list[tuple[str, int, int]]:
    """Escaped bytes, each ``width`` characters wide, as characters with their places."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = None
    out, at = [], 0
    for c in text if text is not None else raw.decode("latin-1"):
        n = len(c.encode()) if text is not None else 1
        out.append((c, at * width, (at + n) * width))
        at += n
    return out


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    return _characters(bytes.fromhex(m[0].replace("%", "")), 3)


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    whole = len(m[0])
    if code := m[1] or m[4]:
        return [(chr(int(code, 16)), 0, whole)] if int(code, 16) < 0x110000 and not 0xD800 <= int(code, 16) < 0xE000 else []
    if m[3]:
        return _characters(bytes.fromhex(m[3].replace("\\x", "")), 4)
    units = bytes.fromhex(m[2].replace("\\u", ""))
    out, at = [], 0
    for c in units.decode("utf-16-be", "replace"):
        n = 2 if ord(c) > 0xFFFF else 1
        out.append((c, at * 6, (at + n) * 6))
        at += n
    return out


_ZLIB, _ZSTANDARD = type(zlib.decompressobj()), type(zstandard.ZstdDecompressor().decompressobj())


def _fed(unpacker, piece: bytes) -> Iterator[bytes]:
    """What one more piece of packed bytes gives, in parts of at most some STEP bytes."""
    waits = hasattr(unpacker, "needs_input")
    if isinstance(unpacker, _ZSTANDARD):
        yield unpacker.decompress(piece)
        return
    while True:
        out = unpacker.decompress(piece, STEP)
        yield out
        piece = b"" if waits else unpacker.unconsumed_tail
        if unpacker.eof or not (len(out) == STEP or piece or waits and not unpacker.needs_input):
            return


def _unpacker(magic: bytes, most: int):
    if magic[:2] == b"BZ":
        return bz2.BZ2Decompressor()
    if magic[:1] == b"\xfd":
        return lzma.LZMADecompressor(memlimit=most + (80 << 20))
    if magic[:1] == b"\x28":
        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(47)


def unpacked(raw: bytes, at: int, most: int, ends: list[int]) -> Iterator[bytes]:
    """What the compressed members that follow each other from ``at`` hold; ``ends`` gets the end of each whole one.

    A member that is cut or damaged gives what comes before that.
    """
    while m := _PACKED.match(raw, at):
        unpacker = _unpacker(m[0], most)
        try:
            for a in range(at, len(raw), FEED):
                yield from _fed(unpacker, raw[a : a + FEED])
                if unpacker.eof:
                    break
            else:
                if isinstance(unpacker, _ZLIB):
                    yield unpacker.flush()
                return
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError, MemoryError):
            return
        at = min(a + FEED, len(raw)) - len(unpacker.unused_data)
        ends.append(at)


def _texts(raw: bytes) -> Iterator[tuple[str, list[int]]]:
    """The texts in some bytes, each with the places of its characters and of its end.

    Bytes that are no text as a whole are read in stretches of printable ASCII, one or two bytes a
    character: no secret, escape or base64 run holds anything else, or is shorter.
    """
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = ""
    if text and sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.9 * len(text):
        yield text, [0, *accumulate(len(c.encode()) for c in text)]
    else:
        for m in _STRETCH.finditer(raw):
            yield m[0].decode("ascii"), list(range(m.start(), m.end() + 1))
    for pattern, skip in ((_WIDE, 0), (_WIDE_BIG, 1)):
        for m in pattern.finditer(raw):
            yield m[0][skip::2].decode("ascii"), list(range(m.start(), m.end() + 1, 2))


class Budget:
    """A text's limits: ``most`` bytes in a layer, and how many more of layers beyond that are read in pieces."""

    def __init__(self, most: int):
        self.most, self.left = most, PIECES * most


def _opened(layer: Layer, raw: bytes, place, stop: int, budget: Budget) -> Iterator[Layer | None]:
    """A layer for each text in ``raw`` and in what is compressed in it, at any place; None for one beyond the limit.

    ``place(a, b)`` is the range in the layer of the bytes from ``a`` to ``b``, ``stop`` the end of all.
    """
    for text, at in _texts(raw):
        spans = [layer.origin(*place(a, b)) for a, b in pairwise(at)]
        yield layer.child(text, [lo for lo, _ in spans], [hi for _, hi in spans])
    work, seen = [(raw, None)], set()
    while work:
        body, whole = work.pop()
        at = 0
        while m := _PACKED.search(body, at):
            at, ends = m.start(), []
            place_of = lambda end: whole or (place(at, at + 1)[0], stop if end is None or end >= len(raw) else place(at, end)[1])  # noqa: E731, B023
            for more, last in _pieces(unpacked(body, at, budget.most, ends), budget):
                if more is None:
                    yield None
                    continue
                span = place_of(ends[-1] if last and ends else None)
                digest = hashlib.blake2b(more, digest_size=16).digest()
                if (digest, span) in seen:
                    continue
                seen.add((digest, span))
                lo, hi = layer.origin(*span)
                for text, _ in _texts(more):
                    yield layer.child(text, [lo] * len(text), [hi] * len(text))
                if _PACKED.search(more):
                    work.append((more, span))
            at = max([at + 1, *ends])


def _pieces(parts: Iterator[bytes], budget: Budget) -> Iterator[tuple[bytes | None, bool]]:
    """The parts joined, and whether this is the last; beyond the limit in pieces that overlap, and a None."""
    held, over = bytearray(), False
    for part in parts:
        held += part
        if len(held) > budget.most:
            if not over:
                over = True
                yield None, False
            while len(held) > budget.most and budget.left > 0:
                yield bytes(held[: budget.most]), False
                budget.left -= budget.most
                del held[: budget.most - min(OVERLAP, budget.most // 2)]
            if budget.left <= 0:
                return
    if held:
        yield bytes(held), True


def _runs(layer: Layer, budget: Budget) -> Iterator[Layer | None]:
    """A layer for each text that a base64 run holds, directly or compressed; None for one beyond the limit.

    Runs are read from each of their first four characters, as letters and separators may stand
    before the coded part, and line by line as well as over line breaks.
    """
    for m in _B64_RUN.finditer(layer.text):
        yield from _decoded(layer, m[0].rstrip("="), range(*m.span()), m.end(), budget)
    for m in _WRAPPED.finditer(layer.text):
        places: list[int] = []
        at = m.start()
        for gap in _BREAK.finditer(layer.text, m.start(), m.end()):
            places.extend(range(at, gap.start()))
            at = gap.end()
        places.extend(range(at, m.end()))
        run = "".join(layer.text[i] for i in places).rstrip("=")
        yield from _decoded(layer, run, places, m.end(), budget)


def _decoded(layer: Layer, run: str, places, end: int, budget: Budget) -> Iterator[Layer | None]:
    for skip in range(4):
        part = run[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode((part + "=" * (-len(part) % 4)).translate({45: 43, 95: 47}))

        def place(a: int, b: int, skip=skip) -> tuple[int, int]:
            return places[skip + a * 4 // 3], places[skip + (b * 8 - 1) // 6] + 1

        yield from _opened(layer, raw, place, end, budget)


def find(text: str, body: bytes | None = None, max_layer: int = MAX_LAYER) -> tuple[list[Span], list[Span], int, int]:
    """``(base spans, all spans, layers, refused)`` of a text, spans sorted by start and kind."""
    body = text.encode() if body is None else body
    base = sorted(base_spans(text, body), key=_order)
    coded = b"%" in body or b"\\" in body or b"x" * BASE64_LEAST in body.translate(_B64_MAP)
    if not coded:
        return base, base, 1, 0
    found, refused, layers = set(base), 0, 0
    work, seen, budget = deque([Layer(text, None, None, frozenset())]), set(), Budget(max_layer)
    while work:
        layer = work.popleft()
        layers += 1
        if layer.starts is not None:
            found.update((k, *layer.origin(a, b)) for k, a, b in base_spans(layer.text, layer.body))
        children: list[Layer | None] = []
        if b"%" in layer.body:
            children.append(_rewritten(layer, _PERCENT, _percent) or layer)
        if b"\\" in layer.body:
            children.append(_rewritten(layer, _ESCAPE, _escape) or layer)
        if b"x" * BASE64_LEAST in layer.body.translate(_B64_MAP):
            children.extend(_runs(layer, budget))
        for child in children:
            if child is None:
                refused += 1
            elif child is not layer and child.digest not in child.above:
                place = (child.digest, *(child.origin(0, len(child.text)) if child.text else (0, 0)))
                if place not in seen:
                    seen.add(place)
                    work.append(child)
    return base, sorted(found, key=_order), layers, refused


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], span[0], span[2]


def told(spans: list[Span]) -> str:
    """``kind:start:end`` of each span, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, *, keep: list[str], text: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """``keep`` with ``n_assign, n_access, n_hex`` (of the text itself), ``base`` and ``spans`` as strings, ``n_layers``, ``n_refused``."""
    counts = [F.lit(0).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    more = [F.lit(0).cast("long").alias(c) for c in ("n_layers", "n_refused")]
    frame = docs.select(*keep, F.col(text).alias("__text"))
    schema = frame.select(*keep, *counts, F.lit("").alias("base"), F.lit("").alias("spans"), *more).schema

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for body in column_bytes(batch, "__text"):
                body = body or b""
                base, spans, layers, refused = find(body.decode(), body, max_layer)
                for k in range(3):
                    rows[k].append(sum(s[0] == k for s in base))
                for at, v in enumerate((told(base), told(spans), layers, refused), 3):
                    rows[at].append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, rows, kinds)], schema.names)

    return mapped(frame, run, schema)


def redacted(text: str, mark: str, max_layer: int = MAX_LAYER) -> str:
    """``text`` with every span replaced by ``mark``, until no scan finds more."""
    while True:
        spans = find(text, None, max_layer)[1]
        if not spans:
            return text
        pieces, at = [], 0
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if a >= at:
                pieces += [text[at:a], mark]
            at = max(at, b)
        text = "".join([*pieces, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", mark: str = "[secret removed]", max_layer: int = MAX_LAYER) -> DataFrame:
    """All columns of ``docs``; secrets in ``text`` are replaced, ``length`` counted anew where text changed."""

    def run(batches):
        for batch in batches:
            bodies = [body and redacted(body.decode(), mark, max_layer).encode() for body in column_bytes(batch, text)]
            yield replaced(batch, text, length, bodies)

    return mapped(docs, run, docs.schema)
