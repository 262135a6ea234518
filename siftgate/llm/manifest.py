"""A Merkle manifest of a dataset: one root for all rows, and for each row the proof that it belongs.

Rows are leaves. Each group (a source, say) is a tree of its rows by key, 16 children to a node; the
groups' roots, in the order of the groups, are the leaves of one more tree, whose root stands for
the dataset. A node is the lowercase hex SHA-256 of its children's digests, as hex, one behind the
other.

Proofs are made by octopus multiproof. A leaf partition (a bucket) is about ``BUCKET`` neighbouring
leaves, made of whole blocks of 256. It works out, from positions and counts alone, the minimal union
of nodes that the proofs of all its leaves need and that it cannot derive itself: on each level the
siblings to the left and to the right of what it holds. Each of these coordinates is fetched once
per bucket, in one join for all buckets. The bucket then folds its leaves upwards with what it
fetched, shares the interior nodes among them, and expands one proof per leaf without asking again.

Where rows travel: texts are hashed where they are read. Key, group and digest are put in order by
range partitions that cut through groups (``ranked``), so a group with a third of all rows is many
partitions; blocks and buckets are bounded whatever the groups are. Levels above the blocks are
grouped by parent, 16 rows to a group, each level written. Requests are pre-aggregated per bucket:
a coordinate near the root meets one row per bucket, not per leaf. The driver gets two counts.

Defined results: null groups come first, then groups by their bytes; within a group null keys come
first, and rows with equal keys go by their digest (equal rows are interchangeable); a null field is
``-``, an empty one ``0:``; an empty table gives an empty manifest. Extra columns of the table play
no part unless named as fields or carried columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import ranked, written
from siftgate.sources.storage import drop_scratch, scratch, ship

WIDTH = 16
BLOCK_LEVELS = 2
BLOCK = WIDTH**BLOCK_LEVELS
BUCKET = 1024
#: The number of the tree above all groups.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """The digest of a row: each field as ``-`` or as its UTF-8 byte count, a colon and its value."""
    spelt = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in spelt]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of a proof give; a row verifies if it is the known root."""

    def up(held: Column, step: Column) -> Column:
        left = F.substring(step["siblings"], F.lit(1), step["at"] * 64)
        right = F.substring(step["siblings"], step["at"] * 64 + 1, F.length(step["siblings"]))
        return F.sha2(F.concat(left, held, right), 256)

    return F.aggregate(proof, leaf, up)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def heights(n: int) -> list[int]:
    """Nodes on each level of a tree of ``n`` leaves, from the leaves to the one that remains."""
    levels = [n]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // WIDTH))
    return levels


def missing(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """``(level, index)`` of the nodes that the proofs of leaves ``low`` to ``high - 1`` need from elsewhere."""
    found = []
    for level, count in enumerate(heights(n)[:-1]):
        first, last = low // WIDTH**level, (high - 1) // WIDTH**level
        begin, stop = first - first % WIDTH, min(count, last - last % WIDTH + WIDTH)
        found += [(level, i) for i in (*range(begin, first), *range(last + 1, stop))]
    return found


class Branch:
    """What a bucket knows of one tree: its own leaves and the fetched nodes, folded upwards."""

    def __init__(self, low: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.levels, held, first = [], leaves, low
        for level, count in enumerate(heights(n)[:-1]):
            last = first + len(held) - 1
            begin, stop = first - first % WIDTH, min(count, last - last % WIDTH + WIDTH)
            whole = [fetched[level, i] for i in range(begin, first)] + held + [fetched[level, i] for i in range(last + 1, stop)]
            self.levels.append((begin, whole))
            held = [_hash(whole[k : k + WIDTH]) for k in range(0, len(whole), WIDTH)]
            first = begin // WIDTH
        self.root = held[0]
        self.tails: dict[tuple[int, int], tuple[list[int], list[str]]] = {}

    def proof(self, index: int, level: int = 0) -> tuple[list[int], list[str]]:
        """Places among the siblings, and the siblings, of each level from ``level`` up; interiors are shared."""
        if level == len(self.levels):
            return [], []
        if (found := self.tails.get((level, index))) is None:
            at, siblings = self.proof(index // WIDTH, level + 1)
            begin, whole = self.levels[level]
            k = index % WIDTH
            run = whole[index - begin - k : index - begin - k + WIDTH]
            found = [k, *at], ["".join(run[:k] + run[k + 1 :]), *siblings]
            if level:
                self.tails[level, index] = found
        return found


def trees_of(rows: pa.Table) -> list[tuple[int, int, int, int, int]]:
    """``(tree, first position, leaves in the tree, from row, to row)`` for rows sorted by tree and position."""
    tree, position, n = (rows.column(c).to_numpy() for c in ("tree", "position", "n"))
    cuts = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
    return [(int(tree[a]), int(position[a]), int(n[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(tree)])]


def block_roots(rows: pa.Table, n_trees: int) -> pa.Table:
    """A bucket's block roots, and, with null digests, the coordinates that it has to fetch."""
    rows = rows.sort_by([("tree", "ascending"), ("position", "ascending")])
    leaves, bucket = rows.column("leaf").to_pylist(), rows.column("bucket")[0].as_py()
    trees, out = trees_of(rows), []
    for tree, low, n, a, b in trees:
        held, level = leaves[a:b], 0
        while level < BLOCK_LEVELS and -(-n // WIDTH**level) > 1:
            held, level = [_hash(held[k : k + WIDTH]) for k in range(0, len(held), WIDTH)], level + 1
        out += [(tree, level, low // WIDTH**level + k, h, n) for k, h in enumerate(held)]
        out += [(tree, level, i, None, n) for level, i in missing(low, low + b - a, n)]
    out += [(TOP, level, i, None, n_trees) for level, i in missing(trees[0][0], trees[-1][0] + 1, n_trees)]
    columns = list(zip(*out))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    return pa.table([pa.array([bucket] * len(out), pa.int64()), *map(pa.array, columns, types)], ["bucket", "tree", "level", "position", "digest", "n"])


def expanded(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """One proof per row of a bucket from its own leaves and the nodes it fetched."""
    rows = rows.sort_by([("tree", "ascending"), ("position", "ascending")])
    known: dict[int, dict[tuple[int, int], str]] = {}
    for tree, level, position, held in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "position", "digest"))):
        known.setdefault(tree, {})[level, position] = held
    leaves, trees = rows.column("leaf").to_pylist(), trees_of(rows)
    branches = [Branch(low, leaves[a:b], n, known.get(tree, {})) for tree, low, n, a, b in trees]
    top = Branch(trees[0][0], [b.root for b in branches], rows.column("n_trees")[0].as_py(), known.get(TOP, {}))
    ats, siblings, stops, subroots = [], [], [0], []
    for (tree, low, _, a, b), branch in zip(trees, branches):
        above = top.proof(tree)
        for index in range(low, low + b - a):
            for own in (branch.proof(index), above):
                ats += own[0]
                siblings += own[1]
            stops.append(len(ats))
        subroots += [branch.root] * (b - a)
    steps = pa.StructArray.from_arrays([pa.array(ats, pa.int32()), pa.array(siblings, pa.string())], ["at", "siblings"])
    proofs = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), steps)
    return pa.table([rows.column("row"), rows.column("leaf"), pa.array(subroots), pa.array([top.root] * len(leaves)), proofs], ["row", "leaf", "subroot", "root", "proof"])


def in_trees(docs: DataFrame, group: str, key: str, fields: tuple[str, ...], carry: dict[str, Column]) -> tuple[DataFrame, int]:
    """``(bucket, tree, position, n, leaf, row)`` of every row, written, and the number of trees."""
    spark = docs.sparkSession
    path = scratch(spark, "manifest-leaves")
    row = F.struct(F.col(key).alias(key), *[c.alias(name) for name, c in carry.items()])
    docs.select(F.col(group).alias("group"), F.col(key).alias("key"), digest(*map(F.col, fields)).alias("leaf"), row.alias("row")).write.parquet(path)
    leaves = ranked(spark.read.parquet(path), ["group", "key", "leaf"], "manifest-order")
    drop_scratch(spark, path)
    stretches = leaves.groupBy("part", "group").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    groups = stretches.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    trees = ranked(written(groups, "manifest-groups"), ["first"], "manifest-trees").select(F.col("group").alias("of"), "first", "n", F.col("position").alias("tree"))
    named = stretches.select("part", "group").join(trees, F.col("group").eqNullSafe(F.col("of")))
    named = named.select(F.col("part").alias("in_part"), "of", "first", "n", "tree")
    placed = leaves.join(named, (F.col("part") == F.col("in_part")) & F.col("group").eqNullSafe(F.col("of")))
    position = F.col("position") - F.col("first")
    bucket = F.floor((F.col("position") - position % BLOCK) / BUCKET).cast("long")
    found = written(placed.select(bucket.alias("bucket"), "tree", position.alias("position"), "n", "leaf", "row"), "manifest-rows")
    return found, trees.count()


def levels_above(nodes: DataFrame) -> DataFrame:
    """All nodes from ``nodes`` (one level) to the last that remains: ``(tree, level, position, digest, n)``; ``n`` counts leaves."""
    every, held = nodes, nodes
    on_level = F.ceil(F.col("n") / F.pow(F.lit(float(WIDTH)), F.col("level"))).cast("long")
    while True:
        rest = held.where(on_level > 1)
        if rest.isEmpty():
            return every
        children = F.array_sort(F.collect_list(F.struct("position", "digest")))
        up = rest.groupBy("tree", "n", "level", F.floor(F.col("position") / WIDTH).alias("parent")).agg(children.alias("children"))
        parent = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        held = written(up.select("tree", (F.col("level") + 1).alias("level"), F.col("parent").alias("position"), parent.alias("digest"), "n"), "manifest-level")
        every = every.unionByName(held)


def manifest(docs: DataFrame, *, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """``(key, carried columns, leaf, subroot, root, proof)`` for every row.

    ``proof`` is an array, from the leaf to the root, of ``at`` (the node's place among its parent's
    children) and ``siblings`` (the digests of the other children, one behind the other). ``carry``
    names further columns to take along, small ones such as the digest of a changed row.
    """
    ship(docs.sparkSession)
    rows, n_trees = in_trees(docs, group, key, tuple(fields), carry or {})
    kind = rows.schema["row"].dataType.simpleString()
    node = "bucket long, tree long, level int, position long, digest string, n long"
    asked = rows.select("bucket", "tree", "position", "n", "leaf").groupBy("bucket")
    local = written(asked.applyInArrow(lambda t: block_roots(t, n_trees), node), "manifest-blocks")
    own = local.where("digest IS NOT NULL").select("tree", "level", "position", "digest", "n")
    nodes = levels_above(own)
    roots = nodes.where(F.ceil(F.col("n") / F.pow(F.lit(float(WIDTH)), F.col("level"))) == 1)
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("position"), "digest", F.lit(n_trees).cast("long").alias("n"))
    every = nodes.unionByName(levels_above(written(top, "manifest-top"))).select("tree", "level", "position", "digest")
    fetched = local.where("digest IS NULL").select("bucket", "tree", "level", "position").join(every, ["tree", "level", "position"])
    left = rows.withColumn("n_trees", F.lit(n_trees).cast("long")).groupBy("bucket")
    shape = f"row {kind}, leaf string, subroot string, root string, proof array<struct<at: int, siblings: string>>"
    return left.cogroup(fetched.groupBy("bucket")).applyInArrow(expanded, shape).select("row.*", "leaf", "subroot", "root", "proof")
