"""Kernels on concave shapes and shapes with holes, and what rests on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atollkit.functions import kernels as k
from atollkit.functions.crs import GEOMETRY
from atollkit.operators import features, grid, spatial
from atollkit.sources import geometry_io, io


def ring(*points):
    return np.array([*points, points[0]], float)


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


U = ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10))
HOLED = [box(0, 0, 10, 10), box(4, 4, 6, 6)[::-1]]


def test_contains():
    assert not k.contains([U], [box(1, 5, 9, 6)])  # across the notch
    assert k.contains([U], [box(1, 1, 9, 2)]) and k.contains([U], [box(0, 0, 10, 3)])
    assert not k.contains(HOLED, [box(3, 3, 7, 7)])  # round the hole
    assert not k.contains(HOLED, [box(4, 4, 6, 6)])  # the hole itself
    assert k.contains(HOLED, [box(3, 3, 7, 7), box(4, 4, 6, 6)[::-1]])
    assert k.contains(HOLED, HOLED) and not k.contains([box(0, 0, 1, 1)], [box(2, 2, 3, 3)])


def test_overlap_of_concave_shapes():
    assert k.overlap_area([box(1, 5, 9, 6)], [U]) == pytest.approx(4)
    assert k.overlap_area([U], box(1, 5, 9, 6)) == pytest.approx(4)
    assert k.overlap_area([U], HOLED) == pytest.approx(k.covered_area([[U], HOLED], 2))
    assert k.overlap_area(HOLED, [box(5, 5, 15, 15)]) == pytest.approx(24)
    assert not k.is_convex(U) and k.is_convex(box(0, 0, 1, 1)) and k.is_convex(ring((0, 0), (2, 1), (1, 3)))
    assert k.touches([U], [box(3, 3, 7, 10)]) and not k.touches([U], [box(3, 2, 7, 10)])
    star = ring((0, 0), (4, 4), (0, 4), (4, 0))
    assert k.validity_reason([star]) == "Self-intersection" and k.validity_reason([U]) is None and k.validity_reason(HOLED) is None


def test_many_edges_are_swept_in_quarters():
    r = np.random.default_rng(0)
    at = r.uniform(0, 50, (300, 2))
    boxes = [[box(x, y, x + 3, y + 2)] for x, y in at]
    assert k.union_area(boxes, 60) == pytest.approx(k.covered_area(boxes), rel=1e-9)
    around = np.linspace(0, 2 * np.pi, 3000)
    circle = np.stack([np.cos(around), np.sin(around)], 1)
    circle[-1] = circle[0]
    assert k.validity_reason([circle]) is None and k.union_area([[circle]]) == pytest.approx(np.pi, rel=1e-5)


def frame(spark, rows, name="geometry"):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in g] if g else None) for i, g in rows], f"id_{name} long, {name} {GEOMETRY}")


def test_joins_of_any_shapes(spark):
    shapes = [(1, [U]), (2, HOLED), (3, [box(0, 0, 10, 10)]), (4, None)]
    tests = [(1, [box(1, 5, 9, 6)]), (2, [box(3, 3, 7, 7)]), (3, [ring((1, 1), (2, 1), (1, 2))]), (4, None), (5, [box(3, 3, 7, 10)])]
    a, b = frame(spark, shapes), frame(spark, tests, "other")
    for name, test in spatial.PREDICATES.items():
        got = {tuple(r) for r in spatial.spatial_join(a, b, pred=name, size=3.0).select("id_geometry", "id_other").collect()}
        assert got == {(i, j) for i, g in shapes for j, h in tests if g and h and test(g, h)}, name
    units = a.withColumnRenamed("id_geometry", "id")
    amounts = features.polygon_amounts(b.select(F.col("id_other").alias("feature_id"), "other"), units, size=3.0)
    want = {(j, i): k.covered_area([g, h], 2) for i, g in shapes for j, h in tests if g and h}
    got = {(r.feature_id, r.id): r.amount for r in amounts.collect()}
    assert got == pytest.approx({p: v for p, v in want.items() if v > 1e-9})
    points = spark.createDataFrame([(0.5, 0.5), (5.0, 5.0), (5.0, 3.5), (0.0, 0.0), (10.0, 5.0)], "x double, y double")
    inside = {(r.x, r.y, r.id) for r in spatial.points_in_polygons(points, units, 4.0).collect()}
    assert inside == {(x, y, i) for x, y in points.collect() for i, g in shapes if g and k.points_in_polygon(np.array([x]), np.array([y]), g)[0]}


def test_lattices_are_many_tasks(spark):
    cells = grid.square_grid(spark, (0.0, 0.0, 40.0, 40.0), 1.0, 1.0)
    assert cells.rdd.getNumPartitions() > 1 and cells.count() == 1600
    assert grid.square_grid(spark, (0.0, 0.0, 0.0, 5.0), 1.0, 1.0).count() == 0


def test_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,x\n,3,y\n4,5\nx,6,z\n7,8,9,10\n\n,,\n")
    got = sorted(map(tuple, io.read_table(spark, str(tmp_path / "t.csv"), "a long, b long, c string").collect()), key=repr)
    assert got == sorted([(1, 2, "x"), (None, 3, "y"), (4, 5, None), (None, None, None)], key=repr)


def test_grid_of_several_files(spark, tmp_path):
    cells = spark.createDataFrame([("a", r, c, float(r * 7 + c)) for r in range(50) for c in range(7) if (r + c) % 3], "layer string, r int, c int, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        geometry_io.write_ascii_grids(cells, str(tmp_path / "g"), 50, 7)
        assert len(list((tmp_path / "g").rglob("part-*.txt"))) > 1
        got = io.read_ascii_grid(spark, str(tmp_path / "g"), "*.txt")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cells.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "b.asc").write_text("ncols 2\nnrows 2\nNODATA_value -1\n1 -1\nnan 4\n")
    assert sorted(map(tuple, io.read_ascii_grid(spark, str(tmp_path / "h")).collect())) == [("b", 0, 0, 1.0), ("b", 1, 1, 4.0)]
