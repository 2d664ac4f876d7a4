"""Operator 11: hard negatives by Kronecker-packed products.

Several candidates' components are made non-negative by a bias and set into separated fields of one wide integer, so that one
product for each component of an anchor, summed over the components, scores all of them. Fields are as wide as the greatest sum that the block's
numbers allow. Words of WORD bits hold what fits, and go through a matrix product of doubles, which is exact below 2**53; where one
field alone is wider, integers of any width are used. Every row scores against every anchor once as a possible positive of its
own label and once as a possible negative, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atollkit.llm.common import pinned, skew_join

#: Bits of a word: whole numbers below 2**53 are exact as doubles.
WORD = 53
#: Rows of a block, anchors of a crowd, and anchors that are scored at a time.
BLOCK, CROWD, TOGETHER = 2048, 1024, 256
LOWEST = np.iinfo(np.int64).min


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of each row of q with each row of x, whole numbers as doubles; beyond 64 bits they end at its limits.

    With bias b and offset s, the field of candidate j in sum(q_d * word_d) + s is q.(x_j + b) + s, which is never negative and below 2 ** width:
    no field runs into the next one."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    bias = -min(0, int(x.min()))
    sums = [sum(map(int, row)) for row in q] if np.abs(q).max() >= 1 << 40 else q.sum(1).astype(np.int64).tolist()
    greatest = max(1, int(x.max()) + bias) * max(1, int(np.abs(q).sum(1).max() * (1 + 1e-9)) + 1)
    width = (2 * greatest).bit_length()
    if width > WORD:
        return wide(q, x, bias, sums, greatest, width)
    fields = WORD // width
    m = -(-len(x) // fields)
    held = np.zeros((m * fields, x.shape[1]))
    held[: len(x)] = x + bias
    words = sum(held[j * m : (j + 1) * m] * float(1 << (width * j)) for j in range(fields))
    offset = greatest * sum(1 << (width * j) for j in range(fields))
    made = (q @ words.T).astype(np.int64) + offset
    out = np.concatenate([(made >> (width * j)) & ((1 << width) - 1) for j in range(fields)], 1)[:, : len(x)]
    return out - greatest - bias * np.array(sums, np.int64)[:, None]


def wide(q: np.ndarray, x: np.ndarray, bias: int, sums: list[int], greatest: int, width: int) -> np.ndarray:
    """products() where a field is wider than a word: all candidates in one integer."""
    size = -(-width // 8)
    words = [int.from_bytes(b"".join((int(v) + bias).to_bytes(size, "little") for v in column), "little") for column in x.T]
    offset = int.from_bytes(greatest.to_bytes(size, "little") * len(x), "little")
    out = np.empty((len(q), len(x)), np.int64)
    for i, row in enumerate(q):
        raw = (sum(int(c) * w for c, w in zip(row, words, strict=True)) + offset).to_bytes(size * len(x), "little")
        less = greatest + bias * sums[i]
        out[i] = [max(LOWEST + 1, min(-LOWEST - 1, int.from_bytes(raw[k : k + size], "little") - less)) for k in range(0, len(raw), size)]
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row; of equal ones the left columns. LOWEST is none."""
    r, c = np.nonzero((scores > LOWEST) & (scores >= (np.partition(scores, -k, 1)[:, -k] if scores.shape[1] > k else np.full(len(scores), LOWEST))[:, None]))
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    few = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[few], c[few]


def clean(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """id, label, kind (of label and vector length) and v of the rows that take part."""
    whole = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    fine = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    there = F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine
    return rows.where(there).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.concat_ws(":", label.cast("long"), F.size("embedding")).alias("kind"), whole.alias("v"))


def packed(key, t):
    """One row of a group: ids, labels, lengths and components, in the order of (id, label, components)."""
    rows = sorted(zip(t.column("id").to_pylist(), t.column("label").to_pylist(), t.column("v").to_pylist(), strict=True))
    blob = lambda x, kind: np.array(x, kind).tobytes()
    made = [blob([r[0] for r in rows], "<i8"), blob([r[1] for r in rows], "<i8"), blob([len(r[2]) for r in rows], "<i4"), blob([c for r in rows for c in r[2]], "<f8")]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in made)], names=["block", "ids", "labels", "sizes", "v"])


class Rows:
    """What packed() made, or anchors as they come."""

    def __init__(self, ids, labels, sizes, v):
        self.id, self.label, self.size = ids, labels, sizes
        self.v, self.end = v, np.append(0, np.cumsum(sizes))

    @staticmethod
    def of(r: dict) -> Rows:
        return Rows(*(np.frombuffer(r[c], kind) for c, kind in (("ids", "<i8"), ("labels", "<i8"), ("sizes", "<i4"), ("v", "<f8"))))

    @staticmethod
    def listed(t: pa.Table) -> Rows:
        v = t.column("v").combine_chunks()
        return Rows(t.column("id").to_numpy(), t.column("label").to_numpy(), np.array(v.value_lengths(), np.int64), np.array(v.flatten(), np.float64))

    def vectors(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.v[self.end[at][:, None] + np.arange(size)]


def met(a: Rows, b: Rows):
    """(anchors, candidates, scores) for some anchors at a time, of one vector length; candidates ascend by id."""
    for size in np.intersect1d(a.size, b.size).tolist():
        mine, theirs = np.flatnonzero(a.size == size), np.flatnonzero(b.size == size)
        x = b.vectors(theirs, size)
        for lo in range(0, len(mine), TOGETHER):
            some = mine[lo : lo + TOGETHER]
            yield some, theirs, products(a.vectors(some, size), x)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Components become floor(scale * x); scores are integer inner products, higher ones first, ties to smaller vec_id. An anchor's positives are its
    first `positives` other rows of the same label; for each, the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score come back: all, if there are fewer, and none where there is none.

    Rows with a null id or label, or a vector that is null, empty or holds null or non-finite components, take no part. Vectors of
    different lengths are not compared. Repeated rows are candidates each; rows with an anchor's id are never its positives nor its negatives, and of the rows of
    one anchor id the least (by label, then components) is the anchor. label is a column expression (default: label), anchors
    a condition on the rows.

    Rows lie in blocks: a kind (label and length) of more than `block` rows has blocks of its own, dealt by a number of the input row, so equal rows and
    ids spread too; smaller kinds lie together, each in one block. Positives are looked for in the blocks of the anchor's kind, negatives in all. The work is anchors
    times rows; a task holds one block and one crowd of anchors."""
    spark = vectors.sparkSession
    rows = clean(vectors, F.col("label") if label is None else label, scale)
    asked = clean(vectors.where(anchors), F.col("label") if label is None else label, scale)
    kinds = rows.groupBy("kind").agg(F.count("*").alias("rows"))
    small = kinds.where(F.col("rows") <= block).agg(F.sum("rows")).first()[0] or 0
    pools = -(-small // block)
    # One row a kind that fills blocks of its own: at most one for every `block` rows. Blocks 0 to pools - 1 hold the other kinds.
    large = kinds.where(F.col("rows") > block).select("kind", F.ceil(F.col("rows") / block).alias("parts"))
    large = pinned(large.withColumn("first", pools + F.sum("parts").over(Window.orderBy("kind")) - F.col("parts")))
    blocks = pools + (large.agg(F.sum("parts")).first()[0] or 0)
    of_kind = lambda df: skew_join(df, large, "kind").withColumns({"first": F.coalesce("first", F.pmod(F.xxhash64("kind"), F.lit(max(1, pools)))), "parts": F.coalesce("parts", F.lit(1))})
    dealt = of_kind(rows.withColumn("_row", F.monotonically_increasing_id())).withColumn("block", F.col("first") + F.pmod(F.xxhash64("_row"), F.col("parts")))
    held = pinned(dealt.select("block", "id", "label", "v").groupBy("block").applyInArrow(packed, "block long, ids binary, labels binary, sizes binary, v binary"))
    asked = asked.groupBy("id").agg(F.min(F.struct("label", "v", "kind")).alias("r")).select("id", "r.label", "r.v", "r.kind")
    crowds = -(-asked.count() // crowd)
    if not blocks or not crowds:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = pinned(of_kind(asked).select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(crowds)).alias("crowd"), "first", "parts"))
    spread = held.withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(crowds - 1).cast("long"))))

    def places(df: DataFrame, first: Column, parts: Column, search, schema: str) -> DataFrame:
        """search(anchors, block) for the blocks first, ... of each anchor."""
        at = df.withColumn("block", F.explode(F.sequence(first, first + parts - 1)))
        return at.groupBy("block", "crowd").cogroup(spread.groupBy("block", "crowd")).applyInArrow(search, schema)

    def nearest(key, a, b):
        out = []
        if len(a) and len(b):
            mine, theirs = Rows.listed(a), Rows.of(b.to_pylist()[0])
            for i, j, s in met(mine, theirs):
                s[(mine.label[i][:, None] != theirs.label[j]) | (mine.id[i][:, None] == theirs.id[j])] = LOWEST
                r, c = best(s, positives)
                out.append((mine.id[i[r]], theirs.id[j[c]], s[r, c]))
        return table(out, ["id", "positive_id", "positive_score"])

    found = places(asked, F.col("first"), F.col("parts"), nearest, "id long, positive_id long, positive_score long")
    order = Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id")
    found = pinned(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
    bars = found.groupBy("id").agg(F.array_sort(F.collect_set("positive_score")).alias("bars"))  # of `positives` scores at most
    seeking = asked.join(bars, "id").select("id", "label", "v", "crowd", "bars")

    def between(key, a, b):
        out = []
        if len(a) and len(b):
            mine, theirs = Rows.listed(a), Rows.of(b.to_pylist()[0])
            bars = a.column("bars").to_pylist()
            for i, j, s in met(mine, theirs):
                s[(mine.label[i][:, None] == theirs.label[j]) | (mine.id[i][:, None] == theirs.id[j])] = LOWEST
                for n in range(max(len(bars[k]) for k in i)):
                    has = np.array([p for p, k in enumerate(i) if len(bars[k]) > n], np.int64)
                    bar = [bars[i[p]][n] for p in has]
                    least, most = (np.array(x)[:, None] for x in ([-(-low * v // 100) for v in bar], [high * v // 100 for v in bar]))
                    t = np.where((s[has] >= least) & (s[has] <= most), s[has], LOWEST)
                    r, c = best(t, negatives)
                    out.append((mine.id[i[has[r]]], np.array(bar, np.int64)[r], theirs.id[j[c]], t[r, c]))
        return table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    near = places(seeking, F.lit(0).cast("long"), F.lit(int(blocks)).cast("long"), between, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = found.select(F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return pairs.join(near, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def table(parts: list, names: list[str]) -> pa.Table:
    cols = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(names)
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in cols], names=names)
