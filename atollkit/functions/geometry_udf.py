"""Vectorised functions of geometry columns, over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from atollkit.functions.crs import GEOMETRY

ARROW_GEOMETRY = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
KINDS = {"boolean": pa.bool_(), "double": pa.float64(), GEOMETRY: ARROW_GEOMETRY, f"array<{GEOMETRY}>": pa.list_(ARROW_GEOMETRY)}


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ends of each row's items among all, after a first 0, and the items."""
    return np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64), column.flatten()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rings up to each row, points up to each ring, points) of a geometry column, from its flat buffers."""
    rows, rings = _lists(column)
    ends, points = _lists(rings)
    x, y = (points.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return rows, ends, np.stack([x, y], 1) if len(x) else np.zeros((0, 2))


def polygons(column: pa.Array) -> list:
    """Each row's rings as arrays of points, None for null; the arrays are views of one."""
    rows, ends, points = flat(column)
    rings = [points[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    out: list = [rings[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
            out[i] = None
    return out


def arrow_polygons(rows: list) -> pa.Array:
    """A geometry column from lists of rings of points."""
    rings = [np.asarray(r, float).reshape(-1, 2) for g in rows if g is not None for r in g]
    points = np.concatenate(rings) if rings else np.zeros((0, 2))
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rings])), pa.int32()), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
    ends = np.append(0, np.cumsum([0 if g is None else len(g) for g in rows]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, mask=pa.array([g is None for g in rows], pa.bool_()))


def lists_of_polygons(rows: list) -> pa.Array:
    """A column of lists of geometries, None for null."""
    ends = np.append(0, np.cumsum([0 if v is None else len(v) for v in rows]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), arrow_polygons([g for v in rows if v is not None for g in v]), mask=pa.array([v is None for v in rows], pa.bool_()))


def _column(values: list, kind: str) -> pa.Array:
    if kind == GEOMETRY:
        return arrow_polygons(values)
    if kind == f"array<{GEOMETRY}>":
        return lists_of_polygons(values)
    return pa.array(values, KINDS[kind])


def rowwise(fn: Callable, kind: str):
    """fn of one row's values (geometries as lists of arrays of points) as a column function that returns kind; null where the
    first value is null.

    Kernels are numpy code on one polygon; its points are views of the batch's flat buffers."""
    def run(*columns: pa.Array) -> pa.Array:
        values = [polygons(c) if pa.types.is_list(c.type) else c.to_pylist() for c in columns]
        return _column([None if row[0] is None else fn(*row) for row in zip(*values, strict=True)], kind)

    return F.arrow_udf(run, kind)


BOX = "x0 double, y0 double, x1 double, y1 double, own boolean, key string"


def boxes_of(column: pa.Array) -> dict[str, pa.Array]:
    """Fields of BOX for each geometry: its ends (null where it has no points, or some that are not finite), whether it is just that rectangle, and else a key of 128 bits
    that equal shapes share."""
    rows, ends, p = flat(column)
    first, last = ends[rows[:-1]], ends[rows[1:]]
    some = np.flatnonzero(last > first)
    b = np.zeros((len(first), 4))
    if len(some):
        for k, end in ((0, np.minimum), (2, np.maximum)):
            b[some, k : k + 2] = end.reduceat(p, first[some], axis=0)
    own = np.zeros(len(first), bool)
    five = some[(np.diff(rows)[some] == 1) & ((last - first)[some] == 5)]
    c, e = p[first[five][:, None] + np.arange(5)].reshape(-1, 5, 2), b[five][:, None]
    corner = ((c == e[..., :2]) | (c == e[..., 2:])).all((1, 2))
    moved = c[:, 1:] != c[:, :-1]
    own[five] = corner & (moved[..., 0] != moved[..., 1]).all(1) & (c[:, 0] == c[:, 4]).all(1) & (b[five, :2] < b[five, 2:]).all(1)
    key: list = [None] * len(first)
    sizes = np.diff(ends).astype("<i8")
    for i in np.flatnonzero(~own & (last > first)).tolist():
        key[i] = hashlib.blake2b(sizes[rows[i] : rows[i + 1]].tobytes() + p[first[i] : last[i]].astype("<f8").tobytes(), digest_size=16).hexdigest()
    none = (last <= first) | ~np.isfinite(b).all(1)
    return {**{n: pa.array(b[:, k], mask=none) for k, n in enumerate(("x0", "y0", "x1", "y1"))}, "own": pa.array(own), "key": pa.array(key, pa.string())}
