"""Spatial joins over an adaptive tree of cells, shared and outer boundaries, and dissolved area."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from atollkit.functions import crs, kernels
from atollkit.functions.geometry_udf import BOX, KINDS, boxes_of, flat, lists_of_polygons
from atollkit.functions.overlay import Overlay, Shapes, covered, inside, portions
from atollkit.operators.tiling import CELLS, Tiling, fitted, surveyed
from atollkit.session import written

#: Boxes of a task of a join; fewer than DEALT of them are left to Spark's own numbers of partitions.
TASK, DEALT = 32768, 8 * 32768
#: Rows of a file of boxes, so that a table that was read by one task is read by many from there on.
ROWS_A_FILE = 1 << 17
PREDICATES = {"intersects": kernels.intersects, "contains": kernels.contains, "touches": kernels.touches}
ENDS = ("x0", "y0", "x1", "y1")
TESTS = {"intersects": Overlay.intersects, "contains": Overlay.contains, "touches": Overlay.touches}


def of_boxes(name: str, p: Column, q: Column) -> Column:
    """The same test of two rectangles, by built-in functions."""
    meet = (p.x0 <= q.x1) & (q.x0 <= p.x1) & (p.y0 <= q.y1) & (q.y0 <= p.y1)
    if name == "intersects":
        return meet
    if name == "contains":
        return (p.x0 <= q.x0) & (q.x1 <= p.x1) & (p.y0 <= q.y0) & (q.y1 <= p.y1)
    return meet & ~((p.x0 < q.x1) & (q.x0 < p.x1) & (p.y0 < q.y1) & (q.y0 < p.y1))


def boxed(df: DataFrame, geom: str, name: str, tree: Tiling | None = None, keep: bool = False) -> DataFrame:
    """df's rows with a geometry, which gives way to its box (name: BOX, and with a tree the cells that it meets), found over Arrow batches.

    Rows without points, or with points that are not finite, drop out; with keep the geometry stays."""
    def run(column: pa.Array) -> pa.Array:
        made = boxes_of(column)
        if tree is not None:
            made["cells"] = tree.listed(*(made[c] for c in ENDS))
        return pa.StructArray.from_arrays(list(made.values()), list(made))

    rows = df.where(F.col(geom).isNotNull()).withColumn(name, F.arrow_udf(run, _kind(tree is not None))(F.col(geom))).where(F.col(f"{name}.x0").isNotNull())
    return rows if keep else rows.drop(geom)


def boxed_once(df: DataFrame, geom: str) -> DataFrame:
    """df's rows, boxes in place of their geometries as in boxed(), and _shape (the geometry where it is no rectangle), written once and read again.

    A join looks at its sides several times, for the extent, the sample, each kind of shape and the rows of equal boxes, and Spark would make and box every geometry
    anew each time (twice where a filter on a box is pushed below it). No filter follows the boxes before they are written."""
    rows = df.where(F.col(geom).isNotNull()).withColumn("_box", F.arrow_udf(_boxes, _kind(False))(F.col(geom)))
    rows = rows.withColumn("_shape", F.when(~F.col("_box.own"), F.col(geom))).drop(geom).withColumnRenamed("_box", geom)
    return written(rows, most=ROWS_A_FILE).where(F.col(geom).x0.isNotNull())


def _boxes(column: pa.Array) -> pa.Array:
    made = boxes_of(column)
    return pa.StructArray.from_arrays(list(made.values()), list(made))


def _kind(cells: bool) -> str:
    return f"struct<{BOX}{f', cells {CELLS}' if cells else ''}>".replace(" double", ":double").replace(" boolean", ":boolean").replace(" string", ":string").replace("cells ", "cells:")


def in_cells(rows: DataFrame, name: str, bounds: bool) -> DataFrame:
    """A row for each cell (_cell) that the box meets, with the cell's bounds (_in) where they are wanted; without cells _cell is null, which joins nothing.

    The inner explode would have Spark filter on the number of cells below all else, which finds the cells of every row twice, equal boxes included."""
    plain = F.struct(*(F.col(f"{name}.{c}").alias(c) for c in (*ENDS, "own", "key")))
    cells = rows.withColumn("_in", F.explode_outer(f"{name}.cells")).withColumn("_cell", F.col("_in.cell")).withColumn(name, plain)
    return cells if bounds else cells.drop("_in")


def met(left: DataFrame, right: DataFrame, boxes: int = 0) -> DataFrame:
    """Pairs of left (_a) and right (_b) whose boxes meet, each once, with the cell where they met.

    A pair stays only in the cell of the lower left corner of the boxes' overlap, so no distinct is needed. Boxes and keys are shuffled, no geometry. Spark
    takes the size of a side from that of its file, which says nothing of boxes in cells: both are shuffled, none is broadcast, and many boxes
    (their number is given) are dealt out to a number of partitions that goes with it, which Spark does not put together."""
    p, q, c = F.col("_a"), F.col("_b"), F.col("_in")
    x, y = F.greatest(p.x0, q.x0), F.greatest(p.y0, q.y0)
    corner = (c.x0 <= x) & (x < c.x1) & (c.y0 <= y) & (y < c.y1)
    dealt = (lambda df: df.repartition(-(-boxes // TASK), "_cell")) if boxes >= DEALT else (lambda df: df)
    return dealt(in_cells(left, "_a", True)).join(dealt(in_cells(right, "_b", False)).hint("merge"), "_cell").where(of_boxes("intersects", p, q) & corner).drop("_in")


def spread(pairs: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    """pairs of which one side has each box once, with that side's rows: those with the same ends and the same key."""
    same = [F.col(f"{side}.{c}") == F.col(f"_of.{c}") for c in ENDS]
    same.append(F.coalesce(f"{side}.key", F.lit("")) == F.coalesce("_of.key", F.lit("")))
    return pairs.join(rows.withColumnRenamed(side, "_of").hint("merge"), same).drop("_of")


def shapes_of(df: DataFrame, geom: str) -> DataFrame:
    """(key, shape) of the geometries that are no rectangles, each once."""
    return boxed(df.select(geom), geom, "_b", keep=True).where("NOT _b.own").select(F.col("_b.key").alias("key"), F.col(geom).alias("shape")).dropDuplicates(["key"])


def _rectangle(b: Column) -> Column:
    return crs.box_geometry(b.x0, b.y0, b.x1, b.y1)


def worked_out(pairs: DataFrame, shapes: DataFrame, kernel: Callable, kind: str, points: bool = False) -> DataFrame:
    """pairs (_a, _b, _cell) with _value, kernel(Overlay) of the pairs of a cell at once (of points: kernel(shapes, row, x, y)).

    Only the shapes that a cell's pairs need are sent to it, each once; rectangles are made of their boxes there."""
    sides = ["_b"] if points else ["_a", "_b"]
    wanted = [pairs.select(F.col("_cell").alias("_at"), F.col(f"{c}.key").alias("key")).where("key IS NOT NULL") for c in sides]
    wanted = (wanted[0] if points else wanted[0].unionByName(wanted[1])).distinct()
    sent = wanted.join(shapes.hint("merge"), "key").select("_at", "key", "shape")
    schema = StructType(list(pairs.schema.fields)).add("_value", DataType.fromDDL(kind))

    def side(t: pa.Table, name: str, keys: dict) -> tuple[Shapes, np.ndarray]:
        """All shapes of a side: those sent, then the rectangles among the pairs; and each pair's shape."""
        b = t.column(name).combine_chunks()
        own = b.field("own").to_numpy(zero_copy_only=False)
        box = np.stack([b.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], 1)[own]
        corners = box[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]].reshape(-1, 5, 2)
        at = np.array([keys.get(k, -1) for k in b.field("key").to_pylist()], np.int64)
        at[own] = len(keys) + np.arange(int(own.sum()))
        return corners, at

    def run(key, t, s):
        if not len(t):
            return pa.Table.from_batches([], t.schema).append_column("_value", pa.array([], KINDS[kind]))
        order = {k: i for i, k in enumerate(s.column("key").to_pylist())}
        rows, ends, xy = flat(s.column("shape").combine_chunks()) if len(s) else (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((0, 2)))

        def shapes(name):
            corners, at = side(t, name, order)
            n, m = len(corners), len(xy)
            return Shapes(np.append(rows, rows[-1] + 1 + np.arange(n)), np.append(ends, m + 5 * (1 + np.arange(n))), np.concatenate([xy, corners.reshape(-1, 2)])), at

        if points:
            b, j = shapes("_b")
            x, y = (t.column("_a").combine_chunks().field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0"))
            return t.append_column("_value", pa.array(kernel(b, j, x, y)))
        (a, i), (b, j) = shapes("_a"), shapes("_b")
        size = np.diff(a.begin)[i] + np.diff(b.begin)[j]
        parts = [kernel(Overlay(a, b, i[r], j[r])) for r in portions(size)]
        made = pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in parts])
        return t.append_column("_value", made)

    return pairs.groupBy("_cell").cogroup(sent.groupBy("_at")).applyInArrow(run, schema)


def valued(a: DataFrame, b: DataFrame, a_geom: str, b_geom: str, native: Callable[[Column, Column], Column], kernel: Callable, kind: str, size: float | None = None, points: bool = False, distinct: bool = False) -> DataFrame:
    """Pairs whose boxes meet, with a's and b's other columns, their boxes (_a, _b) and _value.

    Where both are rectangles _value is native(_a, _b), built-in functions alone; only pairs with another shape go to kernels, over the flat buffers of all of a
    cell's pairs at once. The two kinds are parted before the join, so that neither pays for the other. Where a side repeats its boxes (as counted
    with the extent) each different one is worked on once, and its rows join the pairs afterwards. With distinct b's equal rows count once."""
    full = [a if points else boxed_once(a, a_geom), boxed_once(b, b_geom)]
    rows = [x.drop("_shape") for x in full]
    rows = [(x.distinct() if d else x).withColumnRenamed(g, n) for x, d, g, n in zip(rows, (False, distinct), (a_geom, b_geom), ("_a", "_b"), strict=True)]
    tree, odd, repeated, boxes = surveyed(*(x.select(f"{n}.*") for x, n in zip(rows, ("_a", "_b"), strict=True)), size=size)

    def placed(k: int, name: str) -> DataFrame:
        once = rows[k].select(name).distinct() if repeated[k] else rows[k]
        return once.withColumn(name, F.struct(f"{name}.*", tree.column(F.col(name)).alias("cells")))

    left, right = placed(0, "_a"), placed(1, "_b")
    whole, other = (lambda df, n: df.where(F.col(f"{n}.own"))), (lambda df, n: df.where(~F.col(f"{n}.own")))
    out = met(whole(left, "_a"), whole(right, "_b"), boxes) if any(odd) else met(left, right, boxes)
    out = out.withColumn("_value", native(F.col("_a"), F.col("_b"))).drop("_cell")
    # Where a side has no other shapes its part of the plan is left out.
    rest = ([met(other(left, "_a"), right, boxes)] if odd[0] else []) + ([met(whole(left, "_a") if odd[0] else left, other(right, "_b"), boxes)] if odd[1] else [])
    if rest:
        shapes = [x.where(~F.col(g).own).select(F.col(g).key.alias("key"), F.col("_shape").alias("shape")) for x, g, some in zip(full, (a_geom, b_geom), odd, strict=True) if some]
        # Told apart by their hash: to take one of each key's, Spark would sort all of them.
        shapes = (shapes[0] if len(shapes) == 1 else shapes[0].unionByName(shapes[1])).distinct()
        out = out.unionByName(worked_out(rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1]), shapes, kernel, kind, points).drop("_cell"))
    for k, name in enumerate(("_a", "_b")):
        out = spread(out, rows[k], name) if repeated[k] else out
    return out.select(*rows[0].columns, *rows[1].columns, "_value")


def with_geometry(pairs: DataFrame, df: DataFrame, geom: str, side: str) -> DataFrame:
    """pairs with the geometry of one side again: shapes by their keys, rectangles by their boxes (anticlockwise from the lower left corner)."""
    shapes = shapes_of(df, geom).withColumnsRenamed({"key": "_key", "shape": "_shape"})
    joined = pairs.join(shapes.hint("merge"), F.col(f"{side}.key") == F.col("_key"), "left")
    return joined.withColumn(geom, F.when(F.col(side).own, _rectangle(F.col(side))).otherwise(F.col("_shape"))).drop("_key", "_shape")


def spatial_join(a: DataFrame, b: DataFrame, a_geom: str = "geometry", b_geom: str = "other", pred: str = "intersects", how: str = "inner", size: float | None = None, geometries: bool = True, distinct: bool = False) -> DataFrame:
    """Pairs of rows whose geometries intersect (touching counts), or the first contains the second, or they only touch.

    Column names of the two sides must differ. left_semi keeps a's rows that have any partner. Two rectangles are told
    by built-in functions, other pairs by kernels over all pairs of a cell. Cells come from a tree fitted to the boxes, or are even ones of
    the given size; the result does not depend on them. Without geometries the two geometry columns are left out, which
    saves two joins; rows without a geometry, or with one that is empty or not finite, drop out. With distinct equal rows of b count once."""
    if how not in ("inner", "left_semi"):
        raise ValueError(f"unknown join {how!r}")
    test = TESTS[pred]
    pairs = valued(a, b, a_geom, b_geom, lambda p, q: of_boxes(pred, p, q), lambda o: test(o), "boolean", size, distinct=distinct).where("_value").drop("_value")
    if how == "left_semi":
        pairs = with_geometry(pairs, a, a_geom, "_a") if a_geom in a.columns and geometries else pairs
        return pairs.select([c for c in a.columns if geometries or c != a_geom]).distinct()
    if geometries:
        pairs = with_geometry(with_geometry(pairs, a, a_geom, "_a"), b, b_geom, "_b").select(*a.columns, *b.columns)
    return pairs.drop("_a", "_b")


def shared_area(p: Column, q: Column) -> Column:
    """The area that two rectangles share."""
    side = lambda low, high: F.greatest(F.least(p[high], q[high]) - F.greatest(p[low], q[low]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def overlap_areas(a: DataFrame, b: DataFrame, a_geom: str = "geometry", b_geom: str = "other", size: float | None = None) -> DataFrame:
    """Pairs (a's and b's columns without geometries) with the area that they share, over 0."""
    return valued(a, b, a_geom, b_geom, shared_area, lambda o: o.area(), "double", size).withColumnRenamed("_value", "area").where("area > 0").drop("_a", "_b")


def overlay_polygons(a: DataFrame, b: DataFrame, a_geom: str = "geometry", b_geom: str = "other", size: float | None = None) -> DataFrame:
    """Pairs (a's and b's other columns) with geometry, a row for each polygon that they share, with its holes. Shapes that only touch share none."""
    def common(p: Column, q: Column) -> Column:
        low, high = (lambda e: F.greatest(p[e], q[e])), (lambda e: F.least(p[e], q[e]))
        whole = F.array(crs.box_geometry(low("x0"), low("y0"), high("x1"), high("y1")))
        return F.when(shared_area(p, q) > 0, whole)

    pairs = valued(a, b, a_geom, b_geom, common, lambda o: lists_of_polygons(o.polygons()), f"array<{crs.GEOMETRY}>", size)
    return pairs.drop("_a", "_b").select("*", F.explode("_value").alias("geometry")).drop("_value")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float | None = None, geometries: bool = True) -> DataFrame:
    """Rows of points (x, y) with the columns of each polygon (geometry) they lie in; lower and left edges count.

    Rectangles are told by built-in functions, other polygons over all edges of a cell's pairs at once. Without geometries that column is left out."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    at = points.where(finite(x) & finite(y)).withColumn("_a", F.struct(x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), F.lit(True).alias("own"), F.lit(None).cast("string").alias("key")))
    within = lambda p, q: (p.x0 < q.x1) & (p.y0 < q.y1)
    pairs = valued(at, polygons, "", "geometry", within, inside, "boolean", size, points=True)
    pairs = pairs.where("_value")
    if not geometries:
        return pairs.select(*points.columns, *(c for c in polygons.columns if c != "geometry"))
    return with_geometry(pairs, polygons, "geometry", "_b").select(*points.columns, *polygons.columns)


def edge_keys(units: DataFrame, digits: int = 6) -> DataFrame:
    """(id, key, length): every edge of the shells of units (id, geometry), its rounded ends in order as key."""
    ring = F.col("geometry")[0]
    n = F.size(ring) - 1
    pairs = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = units.select("id", F.explode(pairs).alias("e"))
    end = lambda c: F.struct(F.round(F.col(c).x, digits).alias("x"), F.round(F.col(c).y, digits).alias("y"))
    length = F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y"))
    return rows.select("id", F.array_sort(F.array(end("e.a"), end("e.b"))).alias("key"), length.alias("length"))


def boundary_lengths(units: DataFrame, scale: float = 1000.0, digits: int = 6) -> DataFrame:
    """(id1, id2, boundary) of units on a lattice that touch, id1 < id2: the length of their common edges over scale.

    Units that meet in a corner alone have 0. Edges and corners meet by rounded keys: a few rows a unit, no pair is tried
    that does not touch."""
    edges = edge_keys(units, digits)
    common = edges.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max("length").alias("length")).where(F.size("ids") > 1)
    corners = units.select("id", F.explode(F.col("geometry")[0]).alias("p")).select("id", F.struct(F.round("p.x", digits), F.round("p.y", digits)).alias("key")).distinct()
    met = corners.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1).withColumn("length", F.lit(0.0))
    pairs = common.select("ids", "length").unionByName(met.select("ids", "length")).select("length", F.posexplode("ids").alias("i", "id1"), "ids").select("length", "id1", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("id2"))
    return pairs.groupBy("id1", "id2").agg((F.sum("length") / scale).alias("boundary"))


def boundary_lengths_general(units: DataFrame, scale: float = 1000.0, size: float | None = None) -> DataFrame:
    """boundary_lengths of any polygons (id, geometry): pairs that only touch, and the length along which their edges run together."""
    other = units.select(F.col("id").alias("id2"), F.col("geometry").alias("other"))

    def of_two(p: Column, q: Column) -> Column:
        run = lambda low, high: F.greatest(F.least(p[high], q[high]) - F.greatest(p[low], q[low]), F.lit(0.0))
        return F.when(of_boxes("touches", p, q), run("x0", "x1") + run("y0", "y1"))

    along = lambda o: np.where(o.touches(), o.common_boundary(), np.nan)
    pairs = valued(units.select(F.col("id").alias("id1"), "geometry"), other, "geometry", "other", of_two, along, "double", size)
    return pairs.where("id1 < id2 AND NOT isnan(_value)").select("id1", "id2", (F.col("_value") / scale).alias("boundary"))


def pieces(units: DataFrame, digits: int = 6, together: int = 64) -> DataFrame:
    """(id, line, stretch, low, high): every edge of the shells of units (id, geometry) as an interval on its line, cut where stretches of the line end.

    A line is a direction and an offset, both rounded. A stretch is as long as `together` edges of mean length (one number, found
    first), so a line that a third of all edges lie on is many groups, and cutting adds few pieces."""
    ring = F.col("geometry")[0]
    n = F.size(ring) - 1
    rows = units.select("id", F.explode(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.x.alias("x"), a.y.alias("y"), (b.x - a.x).alias("u"), (b.y - a.y).alias("v")))).alias("e")).select("id", "e.*")
    rows = rows.withColumn("length", F.hypot("u", "v")).where("length > 0")
    mean = rows.agg(F.avg("length")).first()[0] or 1.0
    way = F.when((F.col("u") > 0) | ((F.col("u") == 0) & (F.col("v") > 0)), 1.0).otherwise(-1.0)
    rows = rows.withColumns({"u": way * F.col("u") / F.col("length") + 0.0, "v": way * F.col("v") / F.col("length") + 0.0, "way": way})
    at = F.col("x") * F.col("u") + F.col("y") * F.col("v")
    line = F.struct(F.round("u", 9).alias("u"), F.round("v", 9).alias("v"), (F.round(F.col("x") * F.col("v") - F.col("y") * F.col("u"), digits) + 0.0).alias("offset"))
    size = mean * together
    spans = rows.select("id", line.alias("line"), F.round(F.least(at, at + F.col("way") * F.col("length")), digits).alias("low"), F.round(F.greatest(at, at + F.col("way") * F.col("length")), digits).alias("high"))
    cut = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    return cut.select("id", "line", "stretch", F.greatest("low", F.col("stretch") * size).alias("low"), F.least("high", (F.col("stretch") + 1) * size).alias("high")).where("low < high")


def outer_boundary(units: DataFrame, scale: float = 1000.0, digits: int = 6) -> DataFrame:
    """(id, boundary): the length of a unit's edges along which no other unit lies. ids are whole numbers.

    Edges are intervals on their lines; sweeping a stretch, the sums of what has begun less what has ended give how many units lie
    on each part, and where it is one, which. So edges need not be equal to meet: units of any sizes, T-junctions."""
    p = pieces(units, digits)
    ends = p.select("line", "stretch", F.col("low").alias("at"), F.lit(1).alias("n"), F.col("id").cast("decimal(38,0)").alias("who")).unionByName(p.select("line", "stretch", F.col("high").alias("at"), F.lit(-1).alias("n"), (-F.col("id").cast("decimal(38,0)")).alias("who")))
    ends = ends.groupBy("line", "stretch", "at").agg(F.sum("n").alias("n"), F.sum("who").alias("who"))
    w = Window.partitionBy("line", "stretch").orderBy("at")
    parts = ends.select(F.sum("n").over(w).alias("n"), F.sum("who").over(w).cast("long").alias("id"), (F.lead("at").over(w) - F.col("at")).alias("length"))
    return parts.where("n = 1").groupBy("id").agg((F.sum("length") / scale).alias("boundary"))


def union_area(df: DataFrame, by: list[str], size: float | None = None, overlapping: bool = True) -> DataFrame:
    """(by, area): area of each group's dissolved polygons, overlaps counted once.

    Dissolved area adds up over disjoint cells of the tree: each polygon is cut by the cells of its box, and a cell of a group is
    swept alone, so a group on many cells is many tasks. Equal polygons of a group are one. Layers known not to overlap need no sweep."""
    if not overlapping:
        return df.groupBy(*by).agg(F.sum(crs.planar_area(F.col("geometry"))).alias("area"))
    rows = df.select(*by, "geometry")
    tree, _ = fitted(boxed(rows, "geometry", "_b").select("_b.*"), size=size)
    # A rectangle's ends, or another shape's key, tell equal polygons of a group.
    rows = boxed(rows, "geometry", "_b", tree, keep=True).withColumn("_key", F.coalesce("_b.key", F.concat_ws(" ", *(F.col(f"_b.{c}") for c in ENDS)))).dropDuplicates([*by, "_key"])
    placed = rows.select(*by, "geometry", F.explode("_b.cells").alias("_in"))
    schema = rows.select(*by).schema

    def sweep(key, t):
        c = t.column("_in").combine_chunks()
        x0, y0, x1, y1 = (c.field(e)[0].as_py() for e in ("x0", "y0", "x1", "y1"))
        shapes = Shapes(*flat(t.column("geometry").combine_chunks()))
        return t.select(by).slice(0, 1).append_column("area", pa.array([dissolved(shapes, (x0, y0, x1, y1))]))

    cell = F.col("_in.cell").alias("_cell")
    swept = placed.select(*by, "geometry", "_in", cell).groupBy(*by, "_cell").applyInArrow(sweep, schema.add("area", "double"))
    return swept.groupBy(*by).agg(F.sum("area").alias("area"))


def dissolved(shapes: Shapes, cell: tuple[float, float, float, float], most: int = 4096) -> float:
    """Area of the cell that any of the shapes covers; where they have more than `most` edges there it is swept in quarters."""
    x0, y0, x1, y1 = cell
    corners = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    window = Shapes(np.array([0, 1]), np.array([0, 5]), corners)
    near = np.flatnonzero((shapes.box[:, 0] <= x1) & (shapes.box[:, 2] >= x0) & (shapes.box[:, 1] <= y1) & (shapes.box[:, 3] >= y0))
    if not len(near):
        return 0.0
    cut = Overlay(shapes, window, near, np.zeros(len(near), np.int64))
    _, e = cut.shared()
    mx, my = x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2
    if len(e) > most and x0 < mx < x1 and y0 < my < y1:
        inner = ((np.minimum(e[:, 0], e[:, 2]) < mx - x0) & (np.maximum(e[:, 0], e[:, 2]) > mx - x0)) | ((np.minimum(e[:, 1], e[:, 3]) < my - y0) & (np.maximum(e[:, 1], e[:, 3]) > my - y0))
        if inner.mean() < 0.5:  # else quarters have as many
            return sum(dissolved(shapes, q, most) for q in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)))
    pair, e = cut.shared()
    return covered(e + np.tile(cut.corner[pair], 2) - np.array([x0, y0, x0, y0]))
