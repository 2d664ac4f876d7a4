"""Operator 12: Merkle manifest of a dataset, with witnesses that grow as nodes are appended.

Nodes of one tree are appended in their order. Each open subtree holds the witnesses of its nodes as far as they go: when two of
one height meet, the left one's root is a further sibling to all nodes of the right one and the right one's to all of the left. Positions are
known beforehand, so a tree is cut into aligned blocks of 2**LEVELS nodes, each appended in a task of its own; the roots of full blocks are
nodes like any other and are appended again, until one block holds them all. The roots of all trees make one more tree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from atollkit.llm.common import pinned, skew_join

#: Levels within a block.
LEVELS = 12
#: Columns of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: bytes) -> bytes:
    """Lowercase hexadecimal SHA-256 of the inputs one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(columns: list[Column]) -> Column:
    """The leaf of a row by built-in functions: each column as "-" where it is null, else its UTF-8 length, a colon and itself."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said), 256)


class Append:
    """Nodes appended one by one to a tree or an aligned block of one.

    wit[k][i] is the sibling of node i's path at level k (empty: none). open holds (height, first node, root) of each open
    subtree, from the highest to the lowest."""

    def __init__(self, most: int):
        self.n, self.most = 0, most
        self.wit: list[np.ndarray] = []
        self.open: list[tuple[int, int, bytes]] = []

    def _level(self, k: int) -> np.ndarray:
        while len(self.wit) <= k:
            self.wit.append(np.zeros(self.most, "S64"))
        return self.wit[k]

    def _meet(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            (height, middle, right), (_, first, left) = self.open.pop(), self.open.pop()
            siblings = self._level(height)
            siblings[first:middle], siblings[middle : self.n] = right, left
            self.open.append((height + 1, first, h(left, right)))

    def add(self, node: bytes) -> None:
        self.open.append((0, self.n, node))
        self.n += 1
        self._meet()

    def close(self, height: int | None = None) -> bytes:
        """The root once nothing is added: a last node without a sibling is hashed alone, level by level, until one node
        remains (with height, until it has this height, as in a tree that goes on beside it)."""
        while len(self.open) > 1 or (height is not None and self.open[-1][0] < height):
            k, first, node = self.open.pop()
            self.open.append((k + 1, first, h(node)))
            self._meet()
        return self.open[0][2]

    def witness(self, i: int) -> bytes:
        """All siblings of node i so far, lowest level first."""
        return b"".join(w[i] for w in self.wit)


def fold(node: bytes, siblings: bytes, pos: int, n: int) -> tuple[bytes, bytes]:
    """The root of a tree of n nodes above the node at pos, by its siblings alone, and what they leave over."""
    at = 0
    while n > 1:
        if pos & 1 or pos + 1 < n:
            other = siblings[at : at + 64]
            node, at = (h(other, node) if pos & 1 else h(node, other)), at + 64
        else:
            node = h(node)
        pos, n = pos >> 1, (n + 1) >> 1
    return node, siblings[at:]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0, in the order of the given columns within each tree) and n, the tree's number of nodes.

    Rows are dealt out by ranges of (tree, order) and sorted within them; counts by partition and tree, a small table, give
    each range's first position. Equal rows follow each other in any order, and a number of the input row tells ranges of them apart."""
    names = rows.columns
    keys = ["tree", *order, "_row"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def places(batches):
        """Numbers rows within their partition and tree."""
        tree, n = None, 0
        for b in batches:
            col = b.column("tree")
            size = len(b)
            place = np.arange(size, dtype=np.int64)
            if size:
                change = np.flatnonzero(np.append(True, pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False))) if size > 1 else np.zeros(1, np.int64)
                start = np.repeat(change, np.diff(np.append(change, size)))
                place -= start
                if col[0].as_py() == tree:
                    place[start == 0] += n
                tree, n = col[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "_place"])

    held = pinned(held.drop("_row").mapInArrow(places, StructType([*[f for f in held.schema.fields if f.name != "_row"], StructField("_place", LongType())])))
    counts = held.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    counts = counts.select(F.concat_ws(" ", "_part", "tree").alias("_key"), "_before", "n")
    placed = skew_join(held.withColumn("_key", F.concat_ws(" ", "_part", "tree")), counts, "_key", "inner")
    return placed.select(*names, (F.col("_before") + F.col("_place")).alias("pos"), "n")


def _closed(node: list[bytes], n: int, levels: int) -> tuple[Append, bytes]:
    """A block's nodes appended; n is the tree's number of nodes at this level."""
    a = Append(len(node))
    for x in node:
        a.add(x)
    return a, a.close(levels if n > 1 << levels else None)


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels))


def rooted(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, block, upper, root) for each aligned block of nodes (tree, pos, n, node): upper holds the siblings of the block's root up to the tree's."""
    def root(key, t):
        t = t.sort_by("pos")
        n = t.column("n")[0].as_py()
        _, top = _closed([x.encode() for x in t.column("node").to_pylist()], n, levels)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // (1 << levels))], pa.int64()), "node": pa.array([top.decode()], pa.string())})

    roots = pinned(_blocks(nodes.select("tree", "pos", "n", "node"), levels).groupBy("tree", "block").applyInArrow(root, "tree string, pos long, n long, node string"))
    whole = roots.where("n = 1").select("tree", F.lit(0).cast("long").alias("block"), F.lit("").alias("upper"), F.col("node").alias("root"))
    more = roots.where("n > 1")
    if more.isEmpty():
        return whole
    above = rooted(more, levels)

    def extend(key, t, up):
        t = t.sort_by("pos")
        a, _ = _closed([x.encode() for x in t.column("node").to_pylist()], t.column("n")[0].as_py(), levels)
        rest, top = up.column("upper")[0].as_py(), up.column("root")[0].as_py()
        m = len(t)
        return pa.table({"tree": t.column("tree"), "block": t.column("pos"), "upper": pa.array([a.witness(i).decode() + rest for i in range(m)], pa.string()), "root": pa.array([top] * m, pa.string())})

    return whole.unionByName(_blocks(more, levels).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(extend, "tree string, block long, upper string, root string"))


def manifest(docs: DataFrame, tampered: Column | None = None, proofs: bool = True, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (hexadecimal digests, or proof_sha256 of them) of every row, and folded_root and verified.

    A leaf stands for doc_id, source, lang, n_chars and text of a row. The rows of one lang, in the order of doc_id (null first; rows of one
    id by their leaves), make a tree, whose root is subroot; the subroots in the order of lang (null first, then by
    bytes) make the last tree. proof has the siblings of a leaf up to root, lowest first. folded_root is worked out from the row's present leaf and
    its proof; it is root unless the row has been tampered with. tampered is a condition of rows whose n_chars is then one more than
    the manifest saw (null stays null); without it none is. Repeated rows are leaves each. An empty table has no rows.

    A lang that holds most rows is cut into blocks like any other; no group holds more than 2**levels nodes."""
    d = F.col("doc_id").cast("long")
    cols = {"doc_id": d, "source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars").cast("long"), "text": F.col("text")}
    now = F.when(F.coalesce(tampered, F.lit(False)), cols["n_chars"] + 1).otherwise(cols["n_chars"]) if tampered is not None else cols["n_chars"]
    present = leaf_digest([now if c == "n_chars" else cols[c] for c in FIELDS]) if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("-"))  # null first, then by bytes
    leaves = docs.select(d.alias("doc_id"), tree.alias("tree"), leaf_digest(list(cols.values())).alias("node"), present.alias("present"))
    nodes = pinned(numbered(leaves, ["doc_id", "node"]))
    blocks = pinned(rooted(nodes, levels))
    subroots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node"))
    subroots = pinned(numbered(subroots, ["of"]))
    top = rooted(subroots, levels)

    def name(key, t, up):
        t = t.sort_by("pos")
        a, _ = _closed([x.encode() for x in t.column("node").to_pylist()], t.column("n")[0].as_py(), levels)
        rest, root, m = up.column("upper")[0].as_py(), up.column("root")[0].as_py(), len(t)
        return pa.table({"of": t.column("of"), "tree_pos": t.column("pos"), "trees": t.column("n"), "above": pa.array([a.witness(i).decode() + rest for i in range(m)], pa.string()), "top": pa.array([root] * m, pa.string())})

    named = _blocks(subroots, levels).groupBy("tree", "block").cogroup(top.groupBy("tree", "block")).applyInArrow(name, "of string, tree_pos long, trees long, above string, top string")
    blocks = skew_join(blocks.withColumn("of", F.col("tree")), named, "of", "inner")
    kind = pa.string()
    schema = f"doc_id long, leaf string, subroot string, root string, {'proof' if proofs else 'proof_sha256'} string, folded_root string, verified boolean"

    def finish(key, t, up):
        t = t.sort_by("pos")
        up = up.to_pylist()[0]
        node, present, n = [x.encode() for x in t.column("node").to_pylist()], t.column("present").to_pylist(), t.column("n")[0].as_py()
        a, _ = _closed(node, n, levels)
        upper, above, root = up["upper"].encode(), up["above"].encode(), up["top"].encode()
        proof, folded = [], []
        for i, (pos, x, y) in enumerate(zip(t.column("pos").to_pylist(), node, present, strict=True)):
            path = a.witness(i) + upper + above
            sub, rest = fold(x if y is None else y.encode(), path, pos, n)
            folded.append(fold(sub, rest, up["tree_pos"], up["trees"])[0])
            proof.append(path if proofs else h(path))
        m = len(node)
        fixed = [pa.array([v] * m, kind) for v in (up["root"], up["top"])]
        strings = [pa.array([x.decode() for x in xs], kind) for xs in (proof, folded)]
        return pa.table([t.column("doc_id"), t.column("node"), *fixed, *strings, pa.array([x == root for x in folded])], names=[c.split()[0] for c in schema.split(", ")])

    return _blocks(nodes, levels).groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(finish, schema)


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the decimal id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary"))

