"""Packing, periodic runs and the Merkle manifest against plain Python."""

import bisect
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_texts import LONG, ODD, odd_docs
from tokenizers import Tokenizer

from siftgate.llm import manifest, packing, periodic_runs, queries
from siftgate.llm.common import ranked, slices
from siftgate.options import OptionError

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def description():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


def as_table(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    """A folder with ``documents.parquet``, as the queries read it."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# --- ordered positions and slices ---------------------------------------------------------------


def test_positions_follow_the_order_whatever_is_common(spark):
    rows = [(None if i % 7 == 0 else "same" if i % 3 else f"g{i % 5}", i % 4) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(spark.createDataFrame(rows, "g string, k long").repartition(6), ["g", "k"], "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.position for r in out) == list(range(400))
    got = [(r.g, r.k) for r in sorted(out, key=lambda r: r.position)]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert len({r.part for r in out if r.g == "same"}) > 1


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["", "abc", None, "x" * 50, "de", "f"])], ["text"])
    parts = list(slices(batch, "text", 4))
    assert [p.column("text").to_pylist() for p in parts] == [["", "abc", None], ["x" * 50], ["de", "f"]]
    assert list(slices(batch.slice(0, 0), "text", 4)) == []


# --- packing ------------------------------------------------------------------------------------


def best_fit_by_hand(lengths, capacity):
    """Number of sequences when pieces are placed one after the other."""
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            used, left = used + 1, capacity
        else:
            left = rooms.pop(k)
        bisect.insort(rooms, left - n)
    return used


@pytest.mark.parametrize("capacity", [1, 7, 64, 4096])
@pytest.mark.parametrize("seed", range(4))
def test_the_plan_is_best_fit_decreasing(capacity, seed):
    rng = random.Random(seed)
    lengths = [min(capacity, max(1, int(rng.paretovariate(0.7) * rng.choice([1, capacity / 20])))) for _ in range(rng.choice([1, 50, 3000]))]
    steps, used = packing.plan(Counter(lengths), capacity)
    assert used == best_fit_by_hand(lengths, capacity)
    fill = defaultdict(list)
    for position, n in enumerate(sorted(lengths, reverse=True)):
        begin, first, each, at = steps[np.searchsorted(steps[:, 0], position, "right") - 1].tolist()
        fill[first + (position - begin) // each].append((at + (position - begin) % each * n, n))
    assert sorted(fill) == list(range(used))
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity


def test_room_finds_the_tightest():
    rng, room, held = random.Random(3), packing.Room(100), Counter()
    for _ in range(3000):
        least = rng.randint(1, 100)
        want = min((r for r in held if r >= least and held[r]), default=None)
        assert room.tightest(least) == want
        if want is not None and rng.random() < 0.6:
            room.take(want)
            held[want] -= 1
        elif (left := rng.randint(0, 100)):
            room.put(left, 0, 1)
            held[left] += 1


WORDS = ["Plain", "don't", "rock'n'roll", "'tis", "--'s", "x1y22", "Straße", "ÉCOLE", "İstanbul", "ΣΑΣ", "漢字", "🙂🙂", "áb", "́c", "no break", "a b", "ﬁne", "<|endoftext|>", "x<|startoftext|>y", "<|EndOfText|>", "\x00\x1c", "a\x85b", "ŉ", "ſ", "K", "...!?", "3.14", "l'été", "can't've"]


def mixed_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t\r\n", "\x0b", "\x0c "]) for _ in range(n))


def test_ids_are_the_librarys(description):
    rng = random.Random(5)
    texts = [None, "", " ", *WORDS, *[mixed_text(rng, rng.randint(1, 60)) for _ in range(300)]]
    library = Tokenizer.from_str(description)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    encoder = packing.Ids(description)
    assert encoder.by_word
    ids, n = encoder.encode(pa.array(texts, pa.string()), 1)
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    ids, n = encoder.encode(pa.array(["zz", *texts], pa.string()).slice(1), 1)  # an array that begins inside another
    assert ids.tolist() == [i for w in want for i in w]


def test_other_vocabularies_go_through_the_library_whole():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        description = f.read()
    encoder, library = packing.Ids(description), Tokenizer.from_str(description)
    assert not encoder.by_word
    ids, n = encoder.encode(pa.array(["two  words", None]), 9)
    assert ids.tolist() == [*library.encode("two  words", add_special_tokens=False).ids, 9, 9] and n[-1] == 1


def test_packing_gives_whole_documents_back(spark, description, monkeypatch):
    monkeypatch.setattr(packing, "ROW_IDS", 1000)
    rng = random.Random(8)
    extra = [(i, mixed_text(rng, rng.choice([0, 1, 5, 40, 300]))) for i in range(100, 260)] + [(i, "") for i in range(300, 500)]
    docs = odd_docs(spark, extra).repartition(5)
    pieces = packing.pieces(docs, description, capacity=128).withColumn("offset", F.lit("other"))
    placed = packing.place(pieces, capacity=128)
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = placed.collect()
    library = Tokenizer.from_str(description)
    want = Counter()
    for key, text in [*ODD, *extra]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 128):
            want[key, k // 128, k, tuple(ids[k : k + 128])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in rows) == want
    assert all(r.length == len(r.ids) // 4 for r in rows)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in filled.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= 128
    assert len(filled) == best_fit_by_hand([r.length for r in rows], 128)
    whole = packing.sequences(placed).collect()
    assert {r.sequence_id: bytes(r.ids) for r in whole} == {k: b"".join(p[2] for p in v) for k, v in filled.items()}


def test_packing_refuses_what_does_not_fit_and_takes_empty_tables(spark, description):
    for length in (0, 11, None):
        with pytest.raises(OptionError):
            packing.place(spark.createDataFrame([(1, length)], "doc_id long, length long"), capacity=10)
    empty = packing.place(packing.pieces(odd_docs(spark).limit(0), description))
    assert empty.count() == 0 and packing.sequences(empty).count() == 0
    with pytest.raises(OptionError):
        packing.pieces(spark.createDataFrame([("a", "b")], "piece string, text string"), description, key="piece")


def test_op11_query(spark, tmp_path, description):
    rows = [(k, t, None, None, None) for k, t in ODD]
    got = queries.op11_packing(spark, as_table(spark, tmp_path, rows)).collect()
    library = Tokenizer.from_str(description)
    want = Counter()
    for key, text in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[key, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


# --- periodic runs ------------------------------------------------------------------------------


def runs_by_hand(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            end = i
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end - i + q
            if length >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def periodic_text(rng):
    parts = []
    for _ in range(rng.randint(1, 5)):
        q, letters = rng.choice([1, 1, 2, 3, 5, 8, 9, 11, 16, 17, 24, 33, 70]), rng.choice([1, 2, 3, 500])
        block = [f"w{rng.randrange(letters)}" for _ in range(q)]
        n = int(q * rng.choice([0.5, 2, 2.9, 3, 3.1, 6])) + rng.randint(0, 25)
        parts += (block * (n // q + 1))[:n]
        if rng.random() < 0.4:
            parts.append(f"x{rng.randrange(9)}")
    return parts


#: Each pair of stretches follows another twice within a period, so no short gram comes again after just one period.
ABC = [[f"{c}{i}" for i in range(9)] for c in "ab"]
TWICE = [w for c in "00011101" for w in ABC[int(c)]] * 4


def test_runs_as_by_hand(spark):
    rng = random.Random(21)
    lists = [periodic_text(rng) for _ in range(150)] + [TWICE, ["a"] * 23, ["a"] * 24, list("ab") * 12, (["a"] * 30 + ["b"]) * 4, (list("aab") * 9 + ["c"]) * 3]
    rows = [(k, rng.choice([" ", "\n\t", "  "]).join(w) + rng.choice(["", " "])) for k, w in enumerate(lists)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in periodic_runs.find(docs).collect():
        want = runs_by_hand(lists[r.doc_id])
        assert [tuple(x) for x in r.runs] == want
        assert r.collapsed == collapsed_by_hand(lists[r.doc_id], want) and r.n_words == len(lists[r.doc_id])
        assert (r.best and tuple(r.best)) == (min(want, key=lambda x: (-x[1] / x[2], x[0], x[2])) if want else None)
    for r in periodic_runs.find(docs.limit(40), least=9, times=4).collect():
        assert [tuple(x) for x in r.runs] == runs_by_hand(lists[r.doc_id], 9, 4)


def test_runs_of_odd_rows(spark):
    rows = periodic_runs.find(odd_docs(spark, [(9, "again " * 100_000)])).collect()
    assert len(rows) == len(ODD) + 1
    by = {r.doc_id: r for r in rows}
    assert [(by[k].n_words, by[k].runs, by[k].best, by[k].collapsed) for k in (1, 2, 3)] == [(0, [], None, "")] * 3
    assert [tuple(x) for x in by[9].runs] == [(0, 100_000, 1)] and by[9].collapsed == "again"
    assert [tuple(x) for x in by[4].runs] == [(0, 120_000, 1954)] and by[4].collapsed == " ".join(LONG.split()[:1954])
    assert periodic_runs.find(odd_docs(spark).limit(0)).count() == 0
    with pytest.raises(OptionError):
        periodic_runs.find(spark.createDataFrame([("a", "b")], "runs string, text string"), key="runs")
    with pytest.raises(OptionError):
        periodic_runs.find(odd_docs(spark), times=2)


def test_op12_query(spark, tmp_path):
    rng = random.Random(4)
    lists = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 9, 30, 200, 700]))] for _ in range(120)]
    rows = [(k if k % 9 else -k, " \n".join(w), None, None, None) for k, w in enumerate(lists, 1)] + [(None, "x " * 30, None, None, None), (5000, None, None, None, None)]
    got = queries.op12_periodic_runs(spark, as_table(spark, tmp_path, rows)).collect()
    by, planted = {r.doc_id: r for r in got}, 0
    assert len(got) == len(rows)
    for key, text, *_ in rows:
        w = SPLIT.findall(text or "")
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w)
        planted += h % 10 == 0 and bool(runs)
        r = by[key]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(w, runs).encode()).hexdigest()
    assert planted > 3


# --- Merkle manifest ----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree_by_hand(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def proof_by_hand(levels, i):
    steps = []
    for level in levels[:-1]:
        at = i % 16
        run = level[i - at : i - at + 16]
        steps.append((at, "".join(run[:at] + run[at + 1 :])))
        i //= 16
    return steps


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0], leaf_by_hand(r[0], r[3], r[2], r[4], r[1])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree_by_hand([h for _, h in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order]
    top = tree_by_hand([t[-1][0] for t in trees])
    out = defaultdict(list)
    for k, (g, tree) in enumerate(zip(order, trees)):
        for i, h in enumerate(tree[0]):
            out[h].append((tree[-1][0], top[-1][0], proof_by_hand(tree, i) + proof_by_hand(top, k)))
    return out


def corpus(sizes):
    rng, rows = random.Random(2), []
    for source, n in sizes:
        for i in range(n):
            text = rng.choice([None, "", "Text É %d" % rng.randrange(10**6), "AB cd"])
            rows.append((rng.choice([None, 7, rng.randrange(10**9), -rng.randrange(10**6)]), text, rng.choice([None, "en", ""]), source, rng.choice([None, 0, len(text or "")])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [[("a", 1)], [("a", 2), (None, 1)], [("hot", 5000), (None, 257), ("", 256), ("é", 17), ("z", 16), ("Z", 15), ("b", 4097)], [(f"s{i}", i % 3 + 1) for i in range(700)]],
)
def test_manifest_as_by_hand(spark, sizes):
    rows = corpus(sizes)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit("x")).withColumn("bucket", F.lit(1))
    want = manifest_by_hand(rows)
    got = manifest.manifest(docs.repartition(7), carry={"own_id": F.col("doc_id"), "of": F.col("source")})
    assert got.columns == ["doc_id", "own_id", "of", "leaf", "subroot", "root", "proof"]
    held = defaultdict(list)
    got = got.withColumn("back", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    for r in got:
        held[r.leaf].append((r.subroot, r.root, [tuple(s) for s in r.proof]))
        assert r.back == r.root and r.own_id == r.doc_id
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in want.items()}


def test_missing_nodes_are_the_fewest():
    """What a stretch of leaves asks for is just what its proofs need and it cannot fold itself."""
    rng = random.Random(6)
    for n in (1, 2, 16, 17, 300, 5000):
        for _ in range(20):
            low = rng.randrange(n)
            high = rng.randint(low + 1, n)
            need, own = set(), {(0, i) for i in range(low, high)}
            for level, count in enumerate(manifest.heights(n)[:-1]):
                on_path = {i // 16**level for i in range(low, high)}
                need |= {(level, s) for i in on_path for s in range(i - i % 16, min(count, i - i % 16 + 16)) if s not in on_path}
            asked = manifest.missing(low, high, n)
            assert len(asked) == len(set(asked)) and set(asked) == need and not need & own


def test_op13_query(spark, tmp_path):
    rows = corpus([("a", 40), (None, 3), ("b", 300)]) + [(k, "Upper CASE É", "en", "c", 1) for k in range(60)] + [(k, t, None, None, None) for k, t in ODD]
    got = queries.op13_manifest(spark, as_table(spark, tmp_path, rows)).collect()
    want, by_leaf = manifest_by_hand(rows), defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = {}
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        tampered[leaf_by_hand(r[0], r[3], r[2], r[4], r[1])] = leaf_by_hand(r[0], r[3], r[2], r[4], r[1].translate(lower) if touched else r[1])
    assert len(got) == len(rows) and not all(r.verified for r in got) and any(r.verified for r in got)
    for r in got:
        by_leaf[r.leaf].append((r.subroot, r.root, r.proof_sha256))
        assert r.verified == (r.folded_root == r.root) == (tampered[r.leaf] == r.leaf)
        if len(want[r.leaf]) == 1:
            held = tampered[r.leaf]
            for at, siblings in want[r.leaf][0][2]:
                held = sha(siblings[: at * 64], held, siblings[at * 64 :])
            assert r.folded_root == held
    assert {k: sorted(v) for k, v in by_leaf.items()} == {k: sorted((s, t, sha(*[x for _, x in p])) for s, t, p in v) for k, v in want.items()}
    empty = as_table(spark, tmp_path / "none", [])
    assert queries.op13_manifest(spark, empty).count() == 0 and json.dumps(queries.op13_manifest(spark, empty).columns)
