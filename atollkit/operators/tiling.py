"""Cells that spatial joins meet on: a quadtree fitted to where the boxes are."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boxes of the sample, nodes of the tree, and levels of equal cells below one of its leaves, at most.
SAMPLE, NODES, BELOW = 16384, 4096, 12
#: Boxes of a cell aimed at, and how often a split may repeat its boxes.
ROWS, REPEAT = 256, 2.5
CELLS = "array<struct<cell:long,x0:double,y0:double,x1:double,y1:double>>"


def halves(b: np.ndarray) -> np.ndarray:
    """The quarters of boxes (x0, y0, x1, y1): four rows for each."""
    x0, y0, x1, y1 = b.T
    mx, my = x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2
    return np.stack([np.stack(c, 1) for c in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1))], 1).reshape(-1, 4)


def meets(box: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether closed boxes meet cells that have their lower and left edges, not the others."""
    return (box[..., 0] < cell[..., 2]) & (box[..., 2] >= cell[..., 0]) & (box[..., 1] < cell[..., 3]) & (box[..., 3] >= cell[..., 1])


class Tiling:
    """A quadtree over a sample of boxes, each of which stands for `weight` rows.

    A node is split while it stands for more than ROWS boxes that do not cover it whole (those cannot be told apart by
    splitting) and its quarters do not repeat its boxes more than REPEAT times. A leaf of too few sampled boxes to go on is
    cut into equal cells for the rows that it stands for. A cell is a leaf's number and its path below it."""

    def __init__(self, sample: np.ndarray, weight: float, extent: tuple[float, float, float, float], rows: int = ROWS):
        x0, y0, x1, y1 = extent
        bounds, first, below = [(x0, y0, np.nextafter(x1, math.inf), np.nextafter(y1, math.inf))], [-1], [0]
        todo = [(0, sample)]
        while todo:  # the nearest to the root first: where the nodes run out, they run out everywhere alike
            node, inner = todo.pop(0)
            cell = np.array(bounds[node])
            part = inner[~((inner[:, :2] <= cell[:2]) & (inner[:, 2:] >= cell[2:])).all(1)]
            load = len(part) * weight
            if load <= rows:
                continue
            quarters = halves(cell[None])
            held = meets(part[:, None], quarters[None])
            if len(part) > 8 and len(bounds) + 4 <= NODES:
                if held.sum() > REPEAT * len(part) or (quarters[:, :2] >= quarters[:, 2:]).any():
                    continue
                first[node] = len(bounds)
                for k in range(4):
                    todo.append((len(bounds), part[held[:, k]]))
                    bounds.append(tuple(quarters[k]))
                    first.append(-1)
                    below.append(0)
                continue
            size, mean = cell[2:] - cell[:2], (part[:, 2:] - part[:, :2]).mean(0)
            for depth in range(1, BELOW + 1):
                if load / 4**depth < rows / 4 or (mean * 2**depth / size + 1).prod() > 4 * REPEAT:
                    break
                below[node] = depth
        self.bounds, self.first, self.below = np.array(bounds), np.array(first), np.array(below)

    @staticmethod
    def even(extent: tuple[float, float, float, float], size: float) -> Tiling:
        """Equal cells of about the given size at most."""
        out = Tiling(np.zeros((0, 4)), 1, extent)
        out.below[0] = min(BELOW, max(0, math.ceil(math.log2(max(extent[2] - extent[0], extent[3] - extent[1], size) / size))))
        return out

    def cells(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, cell's bounds) for every cell that each box meets."""
        row = np.flatnonzero(meets(box, self.bounds[:1]))
        node, depth, path, at = np.zeros(len(row), np.int64), np.full(len(row), self.below[0]), np.zeros(len(row), np.int64), np.repeat(self.bounds[:1], len(row), 0)
        done = [(row[:0], path[:0], at[:0])]
        while len(row):
            end = (self.first[node] < 0) & (depth == 0)
            done.append((row[end], (node[end] << (2 * BELOW)) | path[end], at[end]))
            row, node, depth, path, at = (v[~end] for v in (row, node, depth, path, at))
            quarter, inner = np.tile(np.arange(4), len(row)), np.repeat(self.first[node] >= 0, 4)
            real = np.repeat(self.first[node], 4) + quarter
            row, node, depth, path, at = np.repeat(row, 4), np.where(inner, real, np.repeat(node, 4)), np.where(inner, self.below[np.where(inner, real, 0)], np.repeat(depth, 4) - 1), np.where(inner, 0, np.repeat(path, 4) * 4 + quarter), halves(at)
            go = meets(box[row], at)
            row, node, depth, path, at = (v[go] for v in (row, node, depth, path, at))
        row, cell, at = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], cell[order], at[order]

    def listed(self, *ends: pa.Array) -> pa.Array:
        """Lists of cells (CELLS) of boxes; none where an end is null."""
        b = np.stack([c.to_numpy(zero_copy_only=False) for c in ends], 1)
        row, cell, at = self.cells(b)
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(b)))).astype(np.int32)
        inner = pa.StructArray.from_arrays([pa.array(cell), *(pa.array(at[:, k]) for k in range(4))], ["cell", "x0", "y0", "x1", "y1"])
        return pa.ListArray.from_arrays(pa.array(ends), inner)

    def column(self, box: Column) -> Column:
        """All cells (CELLS) of a box column (struct of x0, y0, x1, y1); the tree goes along with the function."""
        def run(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
            return self.listed(x0, y0, x1, y1)

        return F.arrow_udf(run, CELLS)(*(box[c] for c in ("x0", "y0", "x1", "y1")))


def fitted(*sides: DataFrame, size: float | None = None, rows: int = ROWS) -> tuple[Tiling, list[int]]:
    """The tree for the boxes of several tables, and how many of each are not rectangles: surveyed() without the rest."""
    return surveyed(*sides, size=size, rows=rows)[:2]


def surveyed(*sides: DataFrame, size: float | None = None, rows: int = ROWS) -> tuple[Tiling, list[int], list[bool], int]:
    """The tree for the boxes (x0, y0, x1, y1, and own and key if there are other shapes) of several tables, how many of each are not
    rectangles, which tables repeat their boxes (half as many different ones or fewer), and how many boxes there are where those of such
    a table count once. One pass for extent and numbers, one for the sample of about SAMPLE boxes that the driver holds (each box is drawn or not by
    itself, so no task sends more than its share). Joins give the same rows whatever the sample is."""
    odd = lambda df: F.when(F.col("own"), 0).otherwise(1) if "own" in df.columns else F.lit(0)
    kinds, boxes = range(len(sides)), None
    for k, df in enumerate(sides):
        key = F.col("key") if "key" in df.columns else F.lit(None).cast("string")
        part = df.select("x0", "y0", "x1", "y1", key.alias("key"), F.lit(k).alias("side"), odd(df).alias("odd"))
        boxes = part if boxes is None else boxes.unionByName(part)
    of = lambda k, c: F.when(F.col("side") == k, c)
    counts = [f(k) for k in kinds for f in (lambda k: F.count(of(k, F.lit(1))), lambda k: F.coalesce(F.sum(of(k, F.col("odd"))), F.lit(0)), lambda k: F.approx_count_distinct(of(k, F.struct("x0", "y0", "x1", "y1", "key"))))]
    e = tuple(boxes.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), *counts).first())
    extent, n, others, different = e[:4], e[4::3], list(e[5::3]), e[6::3]
    if not sum(n):
        return Tiling(np.zeros((0, 4)), 1, (0.0, 0.0, 0.0, 0.0)), [0] * len(sides), [False] * len(sides), 0
    repeated = [n[k] > rows and 2 * different[k] <= n[k] for k in kinds]
    total = sum(different[k] if repeated[k] else n[k] for k in kinds)
    if size:
        return Tiling.even(extent, size), others, repeated, total
    drawn = np.zeros((0, 4))
    if total > rows:
        once = None
        for k in kinds:
            part = boxes.where(F.col("side") == k).drop("side", "odd")
            part = part.distinct() if repeated[k] else part
            once = part if once is None else once.unionByName(part)
        drawn = np.array([tuple(r)[:4] for r in once.where(F.rand(1) < SAMPLE / total).collect()], float).reshape(-1, 4)
    return Tiling(drawn, total / max(1, len(drawn)), extent, rows), others, repeated, total
