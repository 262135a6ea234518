"""MinHash near-duplicates with odd sketches.

1. Each text becomes its set of 64-bit hashes of five-word shingles, ``SAMPLES`` MinHash samples of
   the set, ``BANDS`` band keys, and an odd sketch: the samples' parities in ``SKETCH_BITS`` bits.
   Texts with the same set form one class, and only one of them goes on.
2. Classes sharing a band key meet in a bucket. Each class first takes one candidate, a bucket's
   smallest class whose sketch is nearest by the bit count of the exclusive or; candidates are
   confirmed on the full sets, which joins groups of near copies without looking at all their pairs.
3. Where a bucket still holds several components, their members are compared across components, in
   blocks and by sketch, and what the sketches leave is confirmed on the full sets, block by block.
   So every pair of a bucket is either inside one component or was decided, and what travels are
   members and joining links, never the pairs of a group.

A pair with similarity 0.75 shares no bucket once in 200,000 cases; a sketch refuses such a pair
once in some millions (the limit lies five standard deviations below). Both chances fall steeply
above 0.75. Hot buckets are streamed or cut into blocks, hot partners are salted, components are
contracted in DataFrames, and text is shuffled only for confirmation.

Defined results: a text without words (or null) has an empty set, no links, and is its own
component; equal sets are linked; repeated rows are linked and each has its row; null ids take part
and never become a component id while another member has one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import column_bytes, mapped, spaced_words, written

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Similarity below which a sketch refuses a pair.
REFUSED = 0.55
BLOCK = 256
LONG_WORD, CHUNK_WORDS = 1024, 50_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TIMES = _rng.integers(0, 1 << 64, SAMPLES, np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 64, SAMPLES, np.uint64)
_MIX = _rng.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    step = base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        step = step * step % (1 << 64)
        have += more
    return out


class _Powers:
    """Powers of the base and of its inverse, as far as a chunk has needed them."""

    up = _powers(_BASE, 1 << 14)
    down = _powers(_INVERSE, 1 << 14)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            size = 1 << n.bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole where it has fewer."""
    all_words = spaced_words(text)
    if not all_words:
        return np.zeros(0, np.uint64)
    if max(map(len, all_words)) > LONG_WORD:
        all_words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.blake2b(w).hexdigest().encode() for w in all_words]
    found = []
    for at in range(0, max(1, len(all_words) - words + 1), CHUNK_WORDS):
        body = np.frombuffer(b" ".join(all_words[at : at + CHUNK_WORDS + words - 1]), np.uint8)
        _Powers.reach(len(body) + 1)
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTE[body] * _Powers.up[: len(body)], out=sums[1:])
        gaps = np.flatnonzero(body == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(body)]))
        reach = min(words, len(starts)) - 1
        starts, ends = starts[: len(starts) - reach], ends[reach:]
        found.append(_mixed((sums[ends] - sums[starts]) * _Powers.down[starts]))
    return np.unique(found[0] if len(found) == 1 else np.concatenate(found))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    least = np.full(SAMPLES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512, None] * _TIMES + _PLUS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)
    return _mixed(keys).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Bit ``k`` tells whether an odd number of (sample, its value) pairs hash to ``k``."""
    places = _mixed(least ^ _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))) % np.uint64(SKETCH_BITS)
    odd = np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_apart(similarity: float) -> int:
    """The differing sketch bits to expect of two sets with this similarity."""
    differing = 2 * SAMPLES * (1 - similarity)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


def similarity(bits: int) -> float:
    """The similarity that so many differing bits tell."""
    share = min(2 * bits / SKETCH_BITS, 1 - 1e-9)
    return max(0.0, 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(1 - share))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(row_id, doc_id, text_hash, n, digest, sketch, bands)``, written."""
    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            sizes, digests, sketches, bands = [], [], [], []
            for body in column_bytes(batch, "text"):
                hashes = shingles(body)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                least = samples(hashes) if len(hashes) else None
                sketches.append(odd_sketch(least) if len(hashes) else [])
                bands.append(band_keys(least) if len(hashes) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, longs), pa.array(bands, longs)], ["row_id", "doc_id", "text_hash", "n", "digest", "sketch", "bands"])

    schema = f"row_id long, doc_id {kind}, text_hash long, n long, digest binary, sketch array<long>, bands array<long>"
    return written(mapped(frame, run, schema), "signatures")


def _stars(nodes: DataFrame) -> DataFrame:
    """``(band, node, hub)``: members of shared buckets, beside the smallest node of the bucket."""

    def run(batches):
        last, hub = None, 0
        for batch in batches:
            bands, ids = batch.column("band").to_numpy(), batch.column("node").to_numpy()
            if not len(bands):
                continue
            new = np.concatenate(([last is None or bands[0] != last], bands[1:] != bands[:-1]))
            hubs = ids[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))].copy()
            if not new[0]:
                run_end = int(np.argmax(new)) if new.any() else len(new)
                hubs[:run_end] = hub
            last, hub = bands[-1], hubs[-1]
            keep = ~new
            yield pa.RecordBatch.from_arrays([pa.array(bands[keep]), pa.array(ids[keep]), pa.array(hubs[keep])], ["band", "node", "hub"])

    rows = nodes.select("node", F.explode("bands").alias("band"))
    # parting by the band alone keeps a bucket in one run of sorted rows, which is streamed
    ordered = rows.repartition(F.col("band")).sortWithinPartitions("band", "node").select("band", "node")
    return mapped(ordered, run, "band long, node long, hub long")


def _near(a: str, b: str):
    """Sketches close and sizes compatible: two columns' worth of pre-test."""
    bits = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return bits, (low * 100 >= high * PERCENT)


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose full sets are similar, written.

    ``a``'s text meets those of its partners; more than ``BLOCK`` partners are dealt over salts.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    members = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / BLOCK)).alias("salt"))
    roles = members.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("role")).union(members.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("role")))
    want = roles.join(nodes.select("node", "doc_id", "text_hash"), "node")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    met = texts.join(want, texts.id.eqNullSafe(want.doc_id) & (texts.hash == want.text_hash)).select("a", "salt", "role", "node", "text")

    def run(batches):
        group, whole = None, None
        for batch in batches:
            out = []
            for a, salt, role, node, body in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "node")), column_bytes(batch, "text")):
                own = shingles(body)
                if role == 0:
                    group, whole = (a, salt), own
                elif group == (a, salt) and len(whole):
                    at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                    both = int((whole[at] == own).sum())
                    if 100 * both >= PERCENT * (len(whole) + len(own) - both):
                        out.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    ordered = met.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return written(mapped(ordered, run, "a long, b long"), "confirmed")


class _Group:
    """Members of one bucket's block, or pair of blocks, that may be similar across components."""

    def __init__(self, rows: list[dict]):
        self.node, self.component, self.n, self.block = (np.array([r[c] for r in rows], np.int64) for c in ("node", "component", "n", "block"))
        # unsigned: counting the bits of a negative number would count those of its magnitude
        self.sketch = np.array([r["sketch"] for r in rows], np.int64).view(np.uint64)
        self.earlier = np.array([r["bands"][: r["place"]] for r in rows], np.int64).reshape(len(rows), -1)
        self.crossing = rows[0]["i"] != rows[0]["j"]

    def partners(self, at: int) -> np.ndarray:
        """Later members that no test rules out and that share no earlier band (which has decided the pair)."""
        rest = slice(at + 1, None)
        ok = self.component[rest] != self.component[at]
        if self.crossing:
            ok &= self.block[rest] != self.block[at]
        ok &= np.minimum(self.n[rest], self.n[at]) * 100 >= np.maximum(self.n[rest], self.n[at]) * PERCENT
        left = np.flatnonzero(ok) + at + 1
        left = left[np.bitwise_count(self.sketch[left] ^ self.sketch[at]).sum(axis=1) <= bits_apart(REFUSED)]
        return left[~(self.earlier[left] == self.earlier[at]).any(axis=1)]


def _grouped(batches, key: tuple[str, ...]):
    """Runs of equal ``key`` in sorted rows, as lists of dicts."""
    group: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if group and any(row[c] != group[0][c] for c in key):
                    yield group
                    group = []
                group.append(row)
    if group:
        yield group


_MEMBER = "band long, i int, j int, block int, place int, node long, component long, n long, sketch array<long>, bands array<long>"


def _across(rows: DataFrame) -> DataFrame:
    """The members, by bucket and block pair, that the sketches leave similar to one of another component.

    At most every member comes out, never their pairs.
    """
    counts = rows.groupBy("band").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = counts.where("low < high").select("band", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.join(mixed, "band").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    names = [c.split()[0] for c in _MEMBER.split(", ")]

    def run(batches):
        for rows in _grouped(batches, ("band", "i", "j")):
            if len(rows) < 2:
                continue
            group, left = _Group(rows), np.zeros(len(rows), bool)
            for at in range(len(rows) - 1):
                partners = group.partners(at)
                left[partners] = True
                left[at] |= len(partners) > 0
            if left.any():
                yield pa.RecordBatch.from_pylist([r for r, k in zip(rows, left) if k], schema=schema)

    schema = pa.schema([(c, pa.list_(pa.int64()) if t.startswith("array") else pa.int64() if t == "long" else pa.int32()) for c, t in (x.split(" ", 1) for x in _MEMBER.split(", "))])
    ordered = dealt.select(*names).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return mapped(ordered, run, _MEMBER)


def _decided(docs: DataFrame, nodes: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """Links ``(a, b)`` between components, confirmed on the full sets of each group's members, written.

    A link is given only where it joins two components that the group has not joined yet.
    """
    want = members.join(nodes.select("node", "doc_id", "text_hash"), "node")
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    met = texts.join(want, texts.id.eqNullSafe(want.doc_id) & (texts.hash == want.text_hash)).drop("id", "hash", "doc_id", "text_hash")

    def run(batches):
        for rows in _grouped(batches, ("band", "i", "j")):
            rows = list({r["node"]: r for r in rows}.values())
            group, sets = _Group(rows), [shingles(r["text"].encode()) for r in rows]
            hashes, where = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum([len(x) for x in sets])
            own = [where[e - len(x) : e] for e, x in zip(ends, sets)]
            above: dict[int, int] = {}

            def top(c: int, above=above) -> int:
                while c in above:
                    c = above[c]
                return c

            out, held = [], np.zeros(len(hashes), bool)
            for at in range(len(rows) - 1):
                mine = top(int(group.component[at]))
                partners = [k for k in group.partners(at).tolist() if top(int(group.component[k])) != mine]
                if not partners:
                    continue
                held[own[at]] = True
                sizes = np.array([len(own[k]) for k in partners])
                both = np.add.reduceat(held[np.concatenate([own[k] for k in partners])].astype(np.int64), np.cumsum(sizes) - sizes)
                held[own[at]] = False
                for k in np.flatnonzero(100 * both >= PERCENT * (len(own[at]) + sizes - both)).tolist():
                    mine, other = top(int(group.component[at])), top(int(group.component[partners[k]]))
                    if mine != other:
                        above[other] = mine
                        out.append((int(group.node[at]), int(group.node[partners[k]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    ordered = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return written(mapped(ordered, run, "a long, b long"), "decided")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the undirected ``(a, b)``; a component's nodes share the root.

    In each round every node steps to the neighbour (or itself) with the least hash of that round,
    and the graph of the nodes stepped to is what remains; on average at least half of it goes.
    """
    steps = []
    while True:
        order = F.xxhash64(F.col("v"), F.lit(len(steps)))
        own = edges.select(F.col("a").alias("u"), F.explode(F.array("a", "b")).alias("v")).union(edges.select(F.col("b").alias("u"), F.explode(F.array("a", "b")).alias("v")))
        step = written(own.groupBy("u").agg(F.min(F.struct(order.alias("h"), "v")).getField("v").alias("to")), "steps")
        steps.append(step)
        left, right = step.select(F.col("u").alias("a"), F.col("to").alias("x")), step.select(F.col("u").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    roots = steps[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        after = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(after, "to", "left").select(F.col("u").alias("node"), F.coalesce("root", "to").alias("root"))
    return written(roots, "roots")


def link(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row_id, doc_id, text_hash, n, root)`` for each row; rows of a component share ``root`` (null: empty set)."""
    signed = signatures(docs, key, text)
    full = signed.where("n > 0")
    classes = written(full.groupBy("digest").agg(F.min("row_id").alias("node")), "classes")
    nodes = written(full.join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "node").drop("digest"), "nodes")

    shared = written(_stars(nodes), "buckets")
    light = nodes.select("node", "n", "sketch")
    a, b = light.alias("a"), light.alias("b")
    bits, sized = _near("a", "b")
    stars = shared.select("hub", F.col("node").alias("member")).distinct()
    scored = stars.join(a, F.col("hub") == F.col("a.node")).join(b, F.col("member") == F.col("b.node")).where(sized).select("hub", "member", bits.alias("bits")).where(F.col("bits") <= bits_apart(REFUSED))
    tried = written(scored.groupBy("member").agg(F.min(F.struct("bits", "hub")).getField("hub").alias("a")).select("a", F.col("member").alias("b")), "tried")
    links = _confirmed(docs, nodes, tried, key, text)

    first = components(links)
    known = shared.select("band", "node").union(shared.select("band", F.col("hub").alias("node")).distinct())
    rows = known.join(first, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    rows = rows.join(nodes.select("node", "n", "sketch", "bands"), "node").withColumn("place", (F.array_position("bands", F.col("band")) - 1).cast("int"))
    members = written(_across(rows), "across")
    if not members.isEmpty():
        first = components(links.union(_decided(docs, nodes, members, key, text)))
    rooted = classes.join(first, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return signed.select("row_id", "doc_id", "text_hash", "n", "digest").join(rooted, "digest", "left").drop("digest")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``."""
    rows = written(link(docs, key=key, text=text), "linked")
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, all columns kept: the one with the smallest id."""
    rows = written(link(docs, key=key, text=text), "linked")
    group = F.coalesce(F.col("root"), -1 - F.col("row_id"))  # an empty set is its own group
    chosen = rows.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r"))
    keys = chosen.select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash")).distinct()
    held = docs.select(F.struct("*").alias("row"), F.col(key).alias("own"), F.xxhash64(F.col(text)).alias("own_hash"))
    kept = held.join(keys, F.col("own").eqNullSafe(F.col("__id")) & (F.col("own_hash") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["own", "own_hash"]).select("row.*")
