"""Periodic runs of words inside a document, found by seeds that are extended along their diagonal.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends, of at
least ``times`` periods and ``least`` words. Put beside itself ``q`` words later, such a run overlaps
in at least ``max(least - q, (times - 1) * q)`` words. So k-grams of that minimum guaranteed overlap
(16 words for 24 and 3) are indexed within the document, and two neighbouring occurrences of a
k-gram are a seed on the diagonal of their distance, the lag. With ``k >= lag`` neighbours suffice:
inside a run every k-gram comes again after exactly ``q`` words and not before, or ``q`` were not the
smallest period. Longer lags are met by k-grams of twice, four times ... as many words, which their
longer overlap guarantees. Thus a position has one seed at most for each doubling, and the pairs
of a word that fills the document are never listed.

A seed is extended to both sides, and a table of the furthest word covered on each lag stops a
seed that lies on a diagonal already extended. K-grams are numbered exactly (no hashes), and those
that occur once in their document drop out at each doubling.

One document is the unit of work, its words are numbers in arrays, nothing is shuffled; rows are
taken in slices of ``SLICE_BYTES`` of text or one longer text.

Defined results: null, empty and white-space texts have no words and no runs, ``collapsed`` is then
empty; null and repeated keys are kept, each row by itself; an empty table gives an empty table.
Other columns of the table are not returned; a key called like a result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import mapped, slices
from siftgate.options import OptionError

LEAST, TIMES = 24, 3
SLICE_BYTES = 8 << 20


def guaranteed(least: int, times: int) -> int:
    """The fewest words in which a run overlaps itself one period later."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def equal_on(x: np.ndarray, i: int, j: int) -> int:
    """How many entries from ``i`` on equal those from ``j > i`` on, one by one."""
    n, done, block = len(x) - j, 0, 64
    while done < n:
        m = min(block, n - done)
        differ = x[i + done : i + done + m] != x[j + done : j + done + m]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, block = done + m, 2 * block
    return n


def seeds(words: np.ndarray, k: int, most: int) -> Iterator[tuple[int, int]]:
    """``(position, lag)`` of neighbouring equal grams, by the doubling of the gram; a chain of them gives its first.

    ``words`` numbers a word of a document, so that grams over the border of two documents are
    unlike all others. Grams of ``k`` words or less serve lags up to their length, of ``2 * k`` those
    up to that, and so on to lags of ``most``.
    """
    name, size = words, 1
    alive = np.arange(len(words))
    while len(alive):
        _, number, count = np.unique(name[alive], return_inverse=True, return_counts=True)
        often = count[number] > 1
        alive, number = alive[often], number[often]
        if size >= k:
            order = np.argsort(number, kind="stable")
            i, lag = alive[order][:-1], np.diff(alive[order])
            near = (np.diff(number[order]) == 0) & (lag <= size) & ((lag > size // 2) | (size == k))
            i, lag = i[near], lag[near]
            order = np.lexsort((i, lag))
            i, lag = i[order], lag[order]
            head = np.ones(len(i), bool)
            head[1:] = (np.diff(i) != 1) | (np.diff(lag) != 0)
            order = np.argsort(i[head], kind="stable")
            yield from zip(i[head][order].tolist(), lag[head][order].tolist())
            if size >= most:
                return
        held = np.full(len(words), -1, np.int64)
        held[alive] = number
        alive = alive[alive + size < len(words)]
        alive = alive[held[alive + size] >= 0]
        name = np.full(len(words), -1, np.int64)
        name[alive] = held[alive] * len(words) + held[alive + size]
        size *= 2


def runs_in(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(first word, length, period)`` of all runs; ``longest`` is the number of words of the longest document."""
    k = 1 << (guaranteed(least, times).bit_length() - 1)
    found, covered = [], {}
    back = words[::-1]
    for i, lag in seeds(words, k, longest // times):
        if covered.get(lag, -1) > i:
            continue
        start = i - equal_on(back, len(words) - i - lag, len(words) - i)
        end = i + lag + equal_on(words, i, i + lag)
        covered[lag] = end - lag
        if end - start >= max(least, times * lag):
            found.append((start, end - start, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with most periods; the earliest, then that of the smallest period, among equal ones."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def as_structs(rows: list[tuple[int, int, int] | None]) -> pa.Array:
    columns = list(zip(*[r or (0, 0, 0) for r in rows])) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_RUN), mask=pa.array([r is None for r in rows], pa.bool_()))


def scan(texts: pa.Array, least: int, times: int) -> list[pa.Array]:
    """``n_words, runs, best, collapsed`` of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    edges = np.append(0, np.cumsum(real))[ends - ends[0]]
    flat, n = flat.filter(pa.array(real)), np.diff(edges)
    coded = flat.dictionary_encode()
    doc = np.repeat(np.arange(len(n)), n)
    key = doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    words = np.unique(key, return_inverse=True)[1] if len(key) else key
    each: list[list] = [[] for _ in range(len(n))]
    gone = np.zeros(len(flat) + 1, np.int64)
    for start, length, period in runs_in(words, int(n.max(initial=0)), least, times):
        d = int(doc[start])
        each[d].append((start - int(edges[d]), length, period))
        gone[start + period] += 1
        gone[start + length] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    kept = np.append(0, np.cumsum(stay))[edges]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(stay))), " ")
    counts = np.append(0, np.cumsum([len(r) for r in each]))
    runs = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), as_structs([r for rs in each for r in rs]))
    return [pa.array(n, pa.int64()), runs, as_structs([best_of(r) if r else None for r in each]), collapsed]


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(key, n_words, runs, best, collapsed)`` for every row.

    ``runs`` are structs of ``start`` (word number from 0), ``length`` and ``period`` by start, then
    period; ``best`` is the one with most periods (ties: smallest start, then period) or null;
    ``collapsed`` is the text with, of every run, its first period only, its words joined by one
    space. Words are what ASCII white space parts.
    """
    names = ["n_words", "runs", "best", "collapsed"]
    if key in names:
        raise OptionError(f"the key may not be called {key!r}")
    if times < 3 or least < times:
        raise OptionError("a run has three periods at least, and no fewer words than periods")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("key"), *scan(part.column("text"), least, times)], [key, *names])

    shape = "struct<start: bigint, length: bigint, period: bigint>"
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return mapped(source, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, runs array<{shape}>, best {shape}, collapsed string")
