"""Operator 7: exact top-k inner products by dual-tree search over cover trees.

An upper tree over a bounded sample cuts all vectors into cells, neighbours among which share a zone. A group of queries first
searches a block of its own cell; with the scores found there it walks the upper tree, leaves out every cell whose covering radius
keeps all of it below the group's worst kth score, and goes to the zones of the others. There the same is done with cover trees of the
queries and of each block, down to single rows, and what one block gives raises the scores that the next must reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atollkit.session import written

#: Rows of a node that are told apart no more, and queries that search together.
LEAF, TOGETHER = 8, 32
#: Each level's radius over that of the level below.
RATIO = 1.6
#: Rows of the sample, and so cells, at most.
SAMPLE = 2048
#: Zones are made smaller until there are so many, and hold no more bytes of vectors, as doubles, than this.
ZONES, ZONE_BYTES = 256, 1 << 26


def net(x: np.ndarray, rows: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, each row's centre, its distance): centres are more than scale apart, every row has the first one within scale."""
    own, away, centres = np.zeros(len(rows), np.int64), np.zeros(len(rows)), []
    left, norms = np.arange(len(rows)), (x[rows] * x[rows]).sum(1)
    while len(left):
        c = left[:64]
        d = np.sqrt(np.maximum(0, norms[left, None] + norms[None, c] - 2 * (x[rows[left]] @ x[rows[c]].T)))
        close, free, chosen = d[: len(c)] <= scale, np.ones(len(c), bool), []
        for j in range(len(c)):
            if free[j]:
                chosen.append(j)
                free &= ~close[:, j]
        d = d[:, chosen]
        d[np.array(chosen), np.arange(len(chosen))] = 0
        near = d <= scale
        has, which = near.any(1), near.argmax(1)
        own[left[has]], away[left[has]] = len(centres) + which[has], d[has, which[has]]
        centres += c[chosen].tolist()
        left = left[~has]
    return np.array(centres, np.int64), own, away


class Tree:
    """A cover tree in flat arrays. A node has a centre (a row of x), the radius that covers all rows below it, and children
    side by side; a node without children is its row. Each level's centres are a net of those rows at a radius smaller by
    RATIO; equal rows and those of small nodes become children at once."""

    def __init__(self, x: np.ndarray):
        self.x = x
        everything = np.arange(len(x))
        d = np.sqrt(((x - x[0]) ** 2).sum(1)) if len(x) else np.zeros(0)
        parts = [(np.zeros(min(1, len(x)), np.int64), d.max(keepdims=True) if len(x) else d)]
        first, size, n, todo = {}, {}, len(parts[0][0]), [(0, everything)] if len(x) > 1 else []
        while todo:
            node, rows = todo.pop()
            radius = self._radius(parts, node)
            first[node] = n
            if len(rows) <= LEAF or radius == 0:
                parts.append((rows, np.zeros(len(rows))))
                size[node] = len(rows)
            else:
                centres, own, away = net(x, rows, radius / RATIO)
                wide = np.zeros(len(centres))
                np.maximum.at(wide, own, away)
                count = np.bincount(own, minlength=len(centres))
                order = np.argsort(own, kind="stable")
                ends = np.cumsum(count)
                parts.append((rows[centres], wide))
                size[node] = len(centres)
                todo += [(n + k, rows[order[ends[k] - count[k] : ends[k]]]) for k in np.flatnonzero(count > 1).tolist()]
            self._starts.append(n)
            n += size[node]
        self.centre = np.concatenate([c for c, _ in parts])
        self.radius = np.concatenate([r for _, r in parts])
        self.first, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if first:
            at = np.fromiter(first, np.int64, len(first))
            self.first[at], self.size[at] = np.fromiter(first.values(), np.int64, len(first)), np.fromiter(size.values(), np.int64, len(size))
        self.norm = np.sqrt((x * x).sum(1))[self.centre]
        self._below: dict[int, np.ndarray] = {}

    def _radius(self, parts: list, node: int) -> float:
        if node == 0:
            self._starts = [0]
            return float(parts[0][1][0])
        k = int(np.searchsorted(self._starts, node, "right")) - 1
        return float(parts[k][1][node - self._starts[k]])

    def children(self, nodes: np.ndarray) -> np.ndarray:
        n = self.size[nodes]
        return np.repeat(self.first[nodes] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def rows(self, node: int) -> np.ndarray:
        if node not in self._below:
            nodes, out = np.array([node]), []
            while len(nodes):
                out.append(self.centre[nodes[self.size[nodes] == 0]])
                nodes = self.children(nodes)
            self._below[node] = np.concatenate(out)
        return self._below[node]


def bounds(c: np.ndarray, radius: float, tree: Tree, nodes: np.ndarray) -> np.ndarray:
    """The most that any inner product of a vector within radius of c and one below each node can be, rounding included."""
    norm = float(np.sqrt(c @ c))
    b = tree.x[tree.centre[nodes]] @ c + radius * tree.norm[nodes] + tree.radius[nodes] * (norm + radius)
    return b + np.abs(b) * 1e-9 + 1e-6


class Best:
    """The k best candidates of each query so far; floor holds scores that are known to be reached."""

    def __init__(self, q_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = q_ids, k
        self.score, self.id, self.row = np.full((len(q_ids), k), -np.inf), np.zeros((len(q_ids), k), np.int64), np.full((len(q_ids), k), -1)
        self.kth = np.full(len(q_ids), -np.inf) if floor is None else floor.astype(np.float64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, at: np.ndarray, same: bool) -> None:
        bar = self.kth[rows].astype(scores.dtype)
        r, c = np.nonzero(scores >= bar[:, None])
        if same:
            r, c = (z[ids[c] != self.ids[rows[r]]] for z in (r, c))
        many = np.flatnonzero(np.bincount(r, minlength=len(rows)) > self.k)
        if len(many):
            dense = np.full(scores.shape, -np.inf, scores.dtype)
            dense[r, c] = scores[r, c]
            bar[many] = np.partition(dense[many], -self.k, axis=1)[:, -self.k]
            r, c = (z[scores[r, c] >= bar[r]] for z in (r, c))
        if not len(r):
            return
        old_r, old_c = np.nonzero(self.row[rows] >= 0)
        owner = np.concatenate([r, old_r])
        s = np.concatenate([scores[r, c], self.score[rows][old_r, old_c]])
        i = np.concatenate([ids[c], self.id[rows][old_r, old_c]])
        w = np.concatenate([at[c], self.row[rows][old_r, old_c]])
        order = np.lexsort((w, i, -s, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order, owner, rank = order[rank < self.k], owner[rank < self.k], rank[rank < self.k]
        q = rows[owner]
        self.score[q, rank], self.id[q, rank], self.row[q, rank] = s[order], i[order], w[order]
        self.kth[rows] = np.maximum(self.kth[rows], self.score[rows, -1])


def dual_tree(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, same: bool = True, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query row, candidate row, score) of each query's k best among the candidates, ties to smaller ids, and the share of all
    pairs of rows that were worked on (a bound of a single row is its score).

    Query and candidate nodes go down together; a pair of nodes is left out when no inner product below it can reach the
    worst kth score of the query node. Few queries left go on together, each with its own bounds. With same, a candidate of the
    query's own id is none; floor gives scores that each query's kth is known to reach."""
    best, scored = Best(q_ids, k, floor), 0
    if len(q) and len(x):
        scored = search(best, q, Tree(q), Tree(x), x_ids, same=same)
    r, n = np.nonzero(best.row >= 0)
    return r, best.row[r, n], best.score[r, n].astype(np.int64), scored / max(1, len(q) * len(x))


def search(best: Best, q: np.ndarray, queries: Tree, tree: Tree, x_ids: np.ndarray, base: int = 0, same: bool = True) -> int:
    """Adds the tree's rows, numbered from base, to the best of q, of which queries is the tree; the number of pairs of rows worked on.

    Rows are scored as they are met, all of them in one product: a bound would be that score."""
    scored, last = 0, None
    norms = np.sqrt((q * q).sum(1)).max(initial=0) * np.sqrt((tree.x * tree.x).sum(1)).max(initial=0)
    kind = np.float32 if norms < 1 << 24 else np.float64  # no sum of products is larger, so whole numbers are exact
    for rows, below in descents(q, best.kth, tree, queries):
        own, narrow_own, front, most = q[rows], q[rows].astype(kind), below[:0], np.zeros((len(rows), 0))
        while len(below) or len(front):
            if last is None or last[0] is not below:
                single = tree.size[below] == 0
                at = tree.centre[below[single]]
                last = below, below[~single], at, tree.x[at].astype(kind), x_ids[at]
            _, below, at, x, ids = last
            if len(at):
                best.add(rows, narrow_own @ x.T, ids, base + at, same)
                scored += len(rows) * len(at)
            front, most = np.concatenate([front, below]), np.concatenate([most, each_bound(own, tree, below)], 1)
            good = (most >= best.kth[rows][:, None]).any(0)
            front, most = front[good], most[:, good]
            order = np.argsort(-most.max(0), kind="stable") if len(front) else np.zeros(0, np.int64)
            n = max(TOGETHER // 4, len(order) // 4) if np.isfinite(best.kth[rows]).all() else 2  # without a kth score nothing can be left out yet
            below, front, most = tree.children(front[order[:n]]), front[order[n:]], most[:, order[n:]]
    return scored


def each_bound(q: np.ndarray, tree: Tree, nodes: np.ndarray) -> np.ndarray:
    """The most that each query's inner product with a vector below each node can be, rounding included."""
    b = q @ tree.x[tree.centre[nodes]].T + np.sqrt((q * q).sum(1))[:, None] * tree.radius[nodes]
    return b + np.abs(b) * 1e-9 + 1e-6


def descents(q: np.ndarray, kth: np.ndarray, tree: Tree, queries: Tree | None = None):
    """(query rows, nodes) for sets of TOGETHER queries at most, near each other where there are such: the nodes that are left to them after the
    query tree's upper nodes have been compared with the tree's. kth may rise between two of them."""
    queries = queries or Tree(q)
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, front = stack.pop()
        rows = queries.rows(node)
        if len(rows) <= TOGETHER:
            yield rows, front
            continue
        c, radius = q[queries.centre[node]], float(queries.radius[node])
        front = front[bounds(c, radius, tree, front) >= kth[rows].min()]
        wide = (tree.radius[front] > radius) & (tree.size[front] > 0)
        front = np.concatenate([front[~wide], tree.children(front[wide])])
        front = front[bounds(c, radius, tree, front) >= kth[rows].min()]
        some: list[np.ndarray] = []
        for child in queries.children(np.array([node])).tolist():
            below = queries.rows(child)
            if len(below) > TOGETHER // 2:
                stack.append((child, front))
                continue
            if sum(map(len, some)) + len(below) > TOGETHER:
                yield np.concatenate(some), front
                some = []
            some.append(below)
        if some:
            yield np.concatenate(some), front


class Cells:
    """Centres of the cells, by vector length, and once they are counted their rows and radii.

    A length that the sample has not met is one cell round the origin, numbered by its negative."""

    def __init__(self, sample: list[np.ndarray], want: int):
        self.centres, self.begin, n = {}, {}, 0
        for dim in sorted({len(v) for v in sample}):
            x = np.array([v for v in sample if len(v) == dim])
            self.begin[dim], self.centres[dim] = n, x[self._cut(Tree(x), max(1, want * len(x) // len(sample)))]
            n += len(self.centres[dim])
        self.count: dict[int, int] = {}
        self.radius: dict[int, float] = {}
        self.place: dict[int, tuple[int, int, int, int, int]] = {}
        self._upper: dict[int, tuple[Tree, np.ndarray]] = {}

    @staticmethod
    def _cut(tree: Tree, want: int) -> np.ndarray:
        """Centres of an upper part of the tree: the widest nodes are opened until there are enough."""
        nodes = np.zeros(1, np.int64)
        while len(nodes) < want and (tree.radius[nodes] > 0).any():
            wide = nodes[np.argsort(-tree.radius[nodes], kind="stable")[: max(1, len(nodes) // 4)]]
            wide = wide[tree.radius[wide] > 0]
            nodes = np.concatenate([np.setdiff1d(nodes, wide), tree.children(wide)])
        return tree.centre[nodes]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and its distance from the centre."""
        dim = x.shape[1]
        if dim not in self.centres:
            return np.full(len(x), -dim), np.sqrt((x * x).sum(1))
        c = self.centres[dim]
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        at = d.argmin(1)
        return self.begin[dim] + at, np.sqrt(((x - c[at]) ** 2).sum(1))

    def length(self, cell: int) -> int:
        """Components of a cell's vectors."""
        return -cell if cell < 0 else max((n, dim) for dim, n in self.begin.items() if n <= cell)[1]

    def settle(self, block: int) -> None:
        """Once all cells are counted: the upper trees, and each cell's place (the first zone of its length, rows of that length
        before it, its rows, its blocks, rows of a zone). Cells follow each other as in the upper tree, so a zone's are near each other."""
        n, first = sum(self.count.values()), 0
        for dim in sorted({self.length(c) for c in self.count}):
            tree, names = self._upper[dim] = self.upper(dim)
            deep, start = min(max(block // 2, n // ZONES), max(block, ZONE_BYTES // (8 * dim))), 0
            for c in names[tree.rows(0)].tolist():
                self.place[c] = (first, start, self.count[c], -(-self.count[c] // block), deep)
                start += self.count[c]
            tree._below.clear()
            first += -(-start // deep)

    def zones(self, cell: int) -> np.ndarray:
        """Where the cell's blocks are."""
        first, start, n, parts, deep = self.place[cell]
        return np.unique(first + (start + np.arange(parts) * n // parts) // deep)

    def upper(self, dim: int) -> tuple[Tree, np.ndarray]:
        """A tree over the centres of all cells of this length that hold rows, its radii widened to cover them, and their numbers."""
        if dim in self._upper:
            return self._upper[dim]
        own = [c for c in self.count if (c == -dim if dim not in self.centres else self.begin[dim] <= c < self.begin[dim] + len(self.centres[dim]))]
        centres = np.array([np.zeros(dim) if c < 0 else self.centres[dim][c - self.begin[dim]] for c in own]).reshape(-1, dim)
        tree = Tree(centres)
        wide = np.array([self.radius[c] for c in own])
        for node in range(len(tree.centre) - 1, -1, -1):
            tree.radius[node] += wide[tree.rows(node)].max()
        return tree, np.array(own, np.int64)


def reached(q: np.ndarray, floor: np.ndarray, tree: Tree) -> list[tuple[np.ndarray, int]]:
    """(query rows, cell) for sets of queries that search together: those of them that may find a score of theirs in the cell."""
    out = []
    for rows, front in descents(q, floor, tree):
        while len(front):
            most = each_bound(q[rows], tree, front) >= floor[rows][:, None]
            good = most.any(0)
            single = (tree.size[front] == 0) & good
            out += [(rows[most[:, i]], int(tree.centre[front[i]])) for i in np.flatnonzero(single)]
            front = tree.children(front[good & ~single])
    return out


#: Types of packed components by their bytes.
PACKED = {2: "<i2", 4: "<i4", 8: "<f8"}


def narrow(x: np.ndarray) -> np.ndarray:
    """x, of whole numbers, in the shortest of the packed types that holds it."""
    most = np.abs(x).max(initial=0)
    return x.astype(PACKED[2 if most < 1 << 15 else 4 if most < 1 << 31 else 8])


def _vectors(blobs: list[bytes], counts: list[int], dim: int) -> np.ndarray:
    """The vectors of blobs that hold so many each."""
    parts = [np.frombuffer(raw, PACKED[len(raw) // (n * dim)]) for raw, n in zip(blobs, counts, strict=True)]
    return np.concatenate([np.zeros(0), *parts]).reshape(-1, dim)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, vec_id long, score long"


def packed(rows: DataFrame, scale: float, cells: Cells | None = None) -> DataFrame:
    """id, cell, away (distance from its centre) and v (packed floor(scale * x)) of rows of id and v, without those that take no part; the
    centres go along with the function. Without cells, cell is the vector's length and away 0."""
    def run(batches):
        for b in batches:
            lists = b.column("v")
            size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends, bad = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(~np.isfinite(lists.flatten().to_numpy(zero_copy_only=False))))
            fine = np.flatnonzero((size > 0) & (bad[ends[1:]] == bad[ends[:-1]]) & b.column("id").is_valid().to_numpy(zero_copy_only=False))
            flat, begin, size = np.clip(flat, -(2.0**63), 2.0**63), ends[fine], size[fine]  # as a cast to long does
            cell, away, v = size.copy(), np.zeros(len(size)), [b""] * len(size)
            for dim in np.unique(size).tolist():
                for at in np.array_split(np.flatnonzero(size == dim), 1 + int((size == dim).sum()) // 1024):
                    x = flat[begin[at][:, None] + np.arange(dim)]
                    if cells:
                        cell[at], away[at] = cells.nearest(x)
                    raw = memoryview(narrow(x).tobytes())
                    wide = len(raw) // max(1, len(at))
                    for n, i in enumerate(at.tolist()):
                        v[i] = raw[n * wide : (n + 1) * wide]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(fine)), pa.array(cell), pa.array(away), pa.array(v, pa.binary())], ["id", "cell", "away", "v"])

    return rows.select("id", "v").mapInArrow(run, "id long, cell long, away double, v binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 8192, query_block: int = 512, cell_rows: int = 2048, sample: int = SAMPLE, crowd: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest integer inner products with rows of vectors.

    Components become floor(scale * x). A query's own vec_id is no candidate; ties go to the smaller vec_id; all candidates
    come back if there are fewer than k. Rows with a null id, or a vector that is null, empty or holds null or non-finite
    components, take no part; repeated rows are candidates each (of queries, one row an id). Vectors of one length are compared with
    each other alone.

    The upper tree is fitted on the `sample` rows with the smallest hashes, which the driver holds; every row gets its nearest cell. A
    cell of more than `block` rows, say of copies, is cut into blocks by a hash of the id. Neighbouring blocks make a zone. A query goes to the
    zones that its kth score in a block of its own cell does not rule out; where nothing can be ruled out that is all of them, and the
    work is queries times rows. A zone's rows are sent once for each `crowd` of queries that go there, so what is shuffled stays
    a small part of the work: rows times queries / crowd, and queries times zones. Memory of a task is bounded by a zone and a crowd."""
    spark, tasks = vectors.sparkSession, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def clean(df):
        v = F.col("embedding")
        return df.select(F.col("vec_id").cast("long").alias("id"), (v if dict(df.dtypes)["embedding"] in ("array<float>", "array<double>") else v.cast("array<double>")).alias("v"))

    drawn = packed(clean(vectors), float(scale)).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample).collect()
    drawn = [_vectors([r.v], [1], r.cell)[0] for r in drawn]
    cells = Cells(drawn, max(1, min(sample, vectors.count() // cell_rows)) if drawn else 1)
    points, asked = written(packed(clean(vectors), float(scale), cells)), written(packed(clean(queries), float(scale), cells).dropDuplicates(["id"]))
    for r in points.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        cells.count[r.cell], cells.radius[r.cell] = r.n, r.radius
    cells.settle(block)
    places = F.broadcast(spark.createDataFrame([(c, *place) for c, place in cells.place.items()], "cell long, zone0 long, start long, n long, parts long, deep long"))
    part = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), "parts").alias("part")
    zone = F.expr("zone0 + (start + (part * n) div parts) div deep").alias("zone")
    points = points.join(places, "cell").select("*", part("part")).select("id", "cell", "part", zone, "v")
    asked = asked.join(places, "cell", "left").select("*", part("asked")).select("id", "cell", zone, "v").fillna(-1, ["zone"])  # -1: a cell without points

    def lots_of(counts: DataFrame) -> dict[int, int]:
        """Into how many lots the queries of a zone are dealt, where that is more than one, of counts (zone, n)."""
        return {r.zone: -(-r.n // crowd) for r in counts.where(F.col("n") > crowd).collect()}

    def with_lots(df: DataFrame, lots: dict[int, int]) -> DataFrame:
        if not lots:
            return df.withColumn("lots", F.lit(1).cast("long"))
        return df.join(F.broadcast(spark.createDataFrame(sorted(lots.items()), "zone long, lots long")), "zone", "left").fillna(1, ["lots"])

    def met(left: DataFrame, lots: dict[int, int], found) -> DataFrame:
        """left (zone, lot, ...) with the zone's points, which go to each of its lots."""
        right = with_lots(points, lots).withColumn("lot", F.explode(F.expr("sequence(0L, lots - 1)"))).drop("lots")
        left, right = (t.repartition(tasks, "zone", "lot").groupBy("zone", "lot") for t in (left, right))
        return left.cogroup(right).applyInArrow(found, FOUND_DDL)

    def searched(q_ids: np.ndarray, floor: np.ndarray | None, q: np.ndarray, b: pa.Table, dim: int) -> pa.Table:
        """The best of a zone's points for each query."""
        b, out = b.sort_by([("cell", "ascending"), ("part", "ascending"), ("id", "ascending")]), []
        for at in np.array_split(np.arange(len(q)), -(-len(q) // query_block)):
            out.append((Best(q_ids[at], k, None if floor is None else floor[at]), q[at], Tree(q[at])))
        ids = b.column("id").to_numpy()
        for lo in range(0, len(ids), block):
            tree = Tree(_vectors(b.column("v")[lo : lo + block].to_pylist(), [1] * min(block, len(ids) - lo), dim))
            for best, some, queries in out:
                search(best, some, queries, tree, ids[lo : lo + block], lo)
        tables = []
        for best, *_ in out:
            r, n = np.nonzero(best.row >= 0)
            tables.append(pa.table([best.ids[r], ids[best.row[r, n]], best.score[r, n].astype(np.int64)], schema=FOUND))
        return pa.concat_tables(tables)

    def near(key, a, b):
        if not len(a) or not len(b):
            return FOUND.empty_table()
        a, dim = a.sort_by([("cell", "ascending"), ("id", "ascending")]), cells.length(b.column("cell")[0].as_py())
        return searched(a.column("id").to_numpy(), None, _vectors(a.column("v").to_pylist(), [1] * len(a), dim), b, dim)

    # First the own zone; of a cell in several zones each query takes one.
    here = asked.groupBy("zone").agg(F.count("*").alias("n"))
    lots = lots_of(here)
    seeds = met(with_lots(asked, lots).withColumn("lot", F.pmod(F.xxhash64("id", F.lit("lot")), "lots")).drop("lots"), lots, near)
    kth = seeds.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("least").cast("double").alias("floor"))
    floors = written(asked.join(kth.hint("merge"), "id", "left").fillna(float("-inf"), ["floor"]))

    def groups(batches):
        """(ids, vectors, floors, zones, which query goes to which) of groups of queries, near each other where there are such."""
        for b in batches:
            cell, zone = b.column("cell").to_numpy(), b.column("zone").to_numpy()
            dims = np.array([cells.length(c) for c in cell.tolist()], np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                rows = rows[np.lexsort((cell[rows], zone[rows]))]
                tree, names = cells.upper(dim)
                to = [cells.zones(c) for c in names.tolist()]
                zones = np.unique(np.concatenate([np.zeros(0, np.int64), *to]))
                to = [np.searchsorted(zones, z) for z in to]
                for at in np.array_split(rows, -(-len(rows) // query_block)) if len(names) else ():
                    some = b.take(pa.array(at))
                    q, floor = _vectors(some.column("v").to_pylist(), [1] * len(at), dim), some.column("floor").to_numpy()
                    goes = np.zeros((len(at), len(zones)), bool)
                    for own, centre in reached(q, floor, tree):
                        goes[own[:, None], to[centre]] = True
                    yield some.column("id").to_numpy(), q, floor, zones, goes

    def count(batches):
        for _, _, _, zones, goes in groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(zones, pa.int64()), pa.array(goes.sum(0), pa.int64())], ["zone", "n"])

    dealt = floors.repartition(tasks, "zone", F.pmod(F.xxhash64("id"), F.lit(8)))
    lots = lots_of(dealt.mapInArrow(count, "zone long, n long").groupBy("zone").agg(F.sum("n").alias("n"))) if floors.count() > crowd else {}

    def ask(batches):
        for ids, q, floor, zones, goes in groups(batches):
            v, mixed, out = narrow(q), ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40), []
            for z in np.flatnonzero(goes.any(0)).tolist():
                some = np.flatnonzero(goes[:, z])
                lot = (mixed[some] % np.uint64(lots.get(int(zones[z]), 1))).astype(np.int64)
                for n in np.unique(lot).tolist():
                    at = some[lot == n]
                    out.append((int(zones[z]), n, ids[at].astype("<i8").tobytes(), floor[at].astype("<f8").tobytes(), v[at].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (*[pa.int64()] * 2, *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], ["zone", "lot", "ids", "floors", "vs"])

    def far(key, a, b):
        if not len(a) or not len(b):
            return FOUND.empty_table()
        dim, sets = cells.length(b.column("cell")[0].as_py()), sorted(zip(*(a.column(c).to_pylist() for c in ("ids", "floors", "vs")), strict=True))
        q_ids, floor = np.frombuffer(b"".join(s[0] for s in sets), "<i8"), np.frombuffer(b"".join(s[1] for s in sets), "<f8")
        return searched(q_ids, floor, _vectors([s[2] for s in sets], [len(s[0]) // 8 for s in sets], dim), b, dim)

    found = met(dealt.mapInArrow(ask, "zone long, lot long, ids binary, floors binary, vs binary"), lots, far)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
