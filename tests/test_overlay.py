"""Pairs of shapes over flat buffers, and the cells of spatial joins, against the kernels of one pair and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atollkit.functions import kernels as k
from atollkit.functions.geometry_udf import arrow_polygons, flat
from atollkit.functions.overlay import MOST, Overlay, Shapes, covered, inside
from atollkit.functions import overlay
from atollkit.operators import features, grid, spatial
from atollkit.operators.tiling import ROWS, Tiling, fitted
from tests.test_geometry import HOLED, U, box, frame, ring

COMB = ring(*[p for i in range(0, 20, 4) for p in ((i, 0), (i, 9), (i + 2, 9), (i + 2, 1))], (20, 1), (20, 0))


def star(r):
    """A simple polygon round its centre, with points in every third of a turn."""
    turns = np.sort(np.concatenate([np.arange(3) * 2.1, r.uniform(0, 2 * np.pi, r.integers(0, 8))]))
    far = r.uniform(0.5, 4, len(turns))
    p = np.stack([np.cos(turns) * far, np.sin(turns) * far], 1) + r.uniform(0, 8, 2)
    return [np.concatenate([p, p[:1]])]


@pytest.fixture(scope="module")
def shapes():
    r = np.random.default_rng(5)
    given = [[U], HOLED, [COMB], [box(0, 0, 10, 10)], [box(1, 5, 9, 6)], [box(3, 3, 7, 7)], [box(4, 4, 6, 6)], [box(3, 3, 7, 7), box(4, 4, 6, 6)[::-1]], [box(0, 0, 10, 3)], [box(3, 3, 7, 10)], [box(10, 10, 12, 12)], [box(20, 20, 21, 21)]]
    lattice = [[box(x, y, x + w, y + h)] for x, y, w, h in np.concatenate([r.integers(0, 8, (12, 2)), r.integers(1, 5, (12, 2))], 1).astype(float)]
    return given + lattice + [star(r) for _ in range(20)]


def every_pair(shapes, shift=0.0):
    s = Shapes(*flat(arrow_polygons([[r + shift for r in g] for g in shapes])))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(shapes)), np.arange(len(shapes)), indexing="ij"))
    return a, b, Overlay(s, s, a, b)


@pytest.mark.parametrize("most", [MOST, 50])
def test_relations_of_all_pairs(shapes, most, monkeypatch):
    monkeypatch.setattr(overlay, "MOST", most)
    a, b, o = every_pair(shapes)
    pairs = [(shapes[i], shapes[j]) for i, j in zip(a, b, strict=True)]
    for name in ("intersects", "contains", "touches"):
        assert getattr(o, name)().tolist() == [getattr(k, name)(g, h) for g, h in pairs], name
    area = [k.covered_area([g, h], 2) for g, h in pairs]
    assert o.area() == pytest.approx(area, abs=1e-8)
    assert o.common_boundary() == pytest.approx([sum(k.shared_boundary(p, q) for p in g for q in h) for g, h in pairs], abs=1e-8)
    assert [sum(k.area(p) for p in ps) for ps in o.polygons()] == pytest.approx(area, abs=1e-8)


def test_far_shapes_lose_nothing(shapes):
    """Coordinates of metres, far from the origin."""
    near, far = every_pair(shapes)[2], every_pair(shapes, 4_000_000.0)[2]
    assert far.area() == pytest.approx(near.area(), abs=1e-6)
    for name in ("intersects", "contains", "touches"):
        assert (getattr(near, name)() == getattr(far, name)()).mean() > 0.99  # slanted shapes that just meet may part there


def test_parts_and_holes_of_an_overlay(shapes):
    s = Shapes(*flat(arrow_polygons([[U], HOLED, [COMB], [box(1, 5, 9, 6)], [box(3, 3, 7, 7)], [box(0, 5, 20, 6)], [box(-5, -5, 30, 30)]])))
    arms, ring_, teeth, whole = Overlay(s, s, np.array([0, 1, 2, 1]), np.array([3, 4, 5, 6])).polygons()
    assert sorted((p[0].min(0).tolist(), p[0].max(0).tolist(), len(p)) for p in arms) == [([1, 5], [3, 6], 1), ([7, 5], [9, 6], 1)]
    assert len(ring_) == 1 and [k.signed_area(r) for r in ring_[0]] == [16, -4]
    assert len(teeth) == 5 and all(k.area(p) == pytest.approx(2) for p in teeth)
    assert len(whole) == 1 and k.area(whole[0]) == pytest.approx(96) and len(whole[0]) == 2


def test_shapes_that_meet_in_a_point_are_apart():
    two = [ring((0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1))]  # an hourglass touching itself
    s = Shapes(*flat(arrow_polygons([two, [box(-1, -1, 3, 3)]])))
    made = Overlay(s, s, np.array([0]), np.array([1])).polygons()[0]
    assert len(made) == 2 and all(k.area(p) == pytest.approx(1) for p in made)


def test_covered_and_inside(shapes):
    s = Shapes(*flat(arrow_polygons(shapes)))
    r = np.random.default_rng(0)
    for _ in range(20):
        some = r.choice(len(shapes), 6, replace=False)
        e = np.concatenate([s.edges[s.begin[i] : s.begin[i + 1]] for i in some])
        for least in (1, 2, 3):
            assert covered(e, least) == pytest.approx(k.covered_area([shapes[i] for i in some], least), abs=1e-9)
    at, x, y = r.integers(0, len(shapes), 500), r.integers(0, 11, 500).astype(float), r.integers(0, 11, 500).astype(float)
    assert inside(s, at, x, y).tolist() == [bool(k.points_in_polygon(x[i : i + 1], y[i : i + 1], shapes[at[i]])[0]) for i in range(500)]


def test_cells_part_the_plane():
    r = np.random.default_rng(1)
    at = np.concatenate([r.normal(size=(20000, 2)), r.normal(size=(20000, 2)) * 900])
    b = np.concatenate([np.concatenate([at, at + r.uniform(0, 0.02, at.shape)], 1), [[-4000, -4000, 4000, 4000]]])
    tree = Tiling(b[r.permutation(len(b))[:5000]], len(b) / 5000, (-5000.0, -5000.0, 5000.0, 5000.0))
    points = np.tile(r.normal(size=(5000, 2)) * 700, 2)
    row, cell, bounds = tree.cells(points)
    assert (np.bincount(row, minlength=5000) == 1).all() and ((bounds[:, :2] <= points[row, :2]) & (points[row, :2] < bounds[:, 2:])).all()
    row, cell, bounds = tree.cells(b)
    loads = np.bincount(np.unique(cell, return_inverse=True)[1])
    # Dense and sparse places alike: no cell far over what was aimed at, and the huge box in each cell once.
    assert loads.max() < 3 * ROWS and len(row) < 1.2 * len(b) and (row == len(b) - 1).sum() == len(np.unique(cell))


def huge_and_small(spark, n):
    small = [(i, [box(i % 50 * 3, i // 50 * 3, i % 50 * 3 + 1, i // 50 * 3 + 2)]) for i in range(n)]
    around = [(n, [ring((-5, -5), (400, -5), (400, 400), (200, 20), (-5, 400))])]
    return frame(spark, small + around)


def test_one_huge_shape_among_many(spark):
    """The same pairs for any cells, and no cell with more than a stated number of rows."""
    a = huge_and_small(spark, 1500)
    b = frame(spark, [(i, [box(i * 7 % 140, i * 5 % 80, i * 7 % 140 + 4, i * 5 % 80 + 1)]) for i in range(300)], "other")
    pairs = lambda size: sorted(map(tuple, spatial.spatial_join(a, b, size=size, geometries=False).collect()))
    got = pairs(None)
    assert got == pairs(3.0) == pairs(500.0) and sum(i == 1500 for i, _ in got) > 200
    tree, odd = fitted(*(spatial.boxed(df, g, "_b").select("_b.*") for df, g in ((a, "geometry"), (b, "other"))))
    assert odd == [1, 0]
    cells = spatial.in_cells(spatial.boxed(a, "geometry", "_b", tree), "_b", False)
    assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 2 * ROWS


def test_rectangles_do_not_go_to_python_as_pairs(spark):
    a = frame(spark, [(1, [box(0, 0, 1, 1)])])
    b = frame(spark, [(2, [box(0, 0, 1, 1)])], "other")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rectangles = plan(spatial.spatial_join(a, b, geometries=False))
    assert "FlatMapCoGroups" not in rectangles and "ArrowEvalPython" not in rectangles.split("Join")[0]
    assert "FlatMapCoGroups" in plan(spatial.spatial_join(frame(spark, [(1, [U])]), b, geometries=False))


def test_clip_to_concave_and_holed_areas(spark):
    cells = frame(spark, [(1, [box(1, 5, 9, 6)]), (2, [box(3, 3, 7, 7)]), (3, [box(0, 0, 1, 1)]), (4, [box(30, 30, 31, 31)])]).withColumnsRenamed({"id_geometry": "cell"})
    area = frame(spark, [(1, [U])])
    rows = grid.clip_grid(cells, area).collect()
    assert sorted(r.cell for r in rows) == [1, 1, 3]
    rows = grid.clip_grid(cells, frame(spark, [(1, HOLED), (2, None)])).collect()
    assert sorted((r.cell, len(r.geometry)) for r in rows) == [(1, 1), (2, 2), (3, 1)] or sorted((r.cell, len(r.geometry)) for r in rows) == [(1, 1), (1, 1), (2, 2), (3, 1)]


def test_geometries_come_back(spark):
    a, b = frame(spark, [(1, [U]), (2, [box(0, 0, 2, 2)])]), frame(spark, [(7, HOLED), (8, None)], "other")
    rows = {(r.id_geometry, r.id_other): r for r in spatial.spatial_join(a, b).collect()}
    assert set(rows) == {(1, 7), (2, 7)}
    assert len(rows[1, 7].other) == 2 and [tuple(p) for p in rows[1, 7].geometry[0]] == [tuple(p) for p in U.tolist()]
    assert spatial.spatial_join(a, b, how="left_semi").count() == 2
    assert features.polygon_amounts(b.select(F.col("id_other").alias("feature_id"), "other"), a.withColumnRenamed("id_geometry", "id")).count() == 2


def test_points_that_are_not_finite_drop_out(spark):
    """Without touching other rows' pairs."""
    odd = [ring((0, 0), (float("nan"), 0), (1, 1)), ring((0, 0), (float("inf"), 0), (1, 1))]
    a = frame(spark, [(1, [box(0, 0, 2, 2)]), (2, [odd[0]]), (3, [odd[1]]), (4, []), (5, None)])
    b = frame(spark, [(1, [box(1, 1, 3, 3)]), (2, [odd[1]]), (3, [U])], "other")
    assert sorted(map(tuple, spatial.spatial_join(a, b, geometries=False).collect())) == [(1, 1), (1, 3)]
    assert spatial.union_area(a.withColumn("k", F.lit(1)), ["k"]).collect()[0].area == 4
    points = spark.createDataFrame([(0.5, 0.5), (float("nan"), 0.5), (0.5, float("-inf")), (None, 1.0)], "x double, y double")
    assert spatial.points_in_polygons(points, a, geometries=False).count() == 1


def test_many_equal_boxes(spark):
    """A place that a third of all boxes share: splitting cannot tell them apart, and ends."""
    same = np.tile([[1.0, 1.0, 1.0, 1.0]], (3000, 1))
    tree = Tiling(np.concatenate([same, np.random.default_rng(0).uniform(0, 9, (6000, 2))[:, [0, 1, 0, 1]]]), 1.0, (0.0, 0.0, 9.0, 9.0))
    assert len(tree.first) < 1000 and len(np.unique(tree.cells(same)[1])) == 1


def test_dateline_splits_columns_of_any_shapes(spark):
    """Holes stay, concave shapes may give several parts, and rows that do not cross stay as they are."""
    wrap = lambda r: np.stack([np.where(r[:, 0] > 180, r[:, 0] - 360, r[:, 0]), r[:, 1]], 1)
    holed = [wrap(box(170, -95, 190, 95)), wrap(box(175, 0, 185, 10)[::-1])]
    arms = [wrap(ring((178, 0), (188, 0), (188, 2), (182, 2), (182, 4), (188, 4), (188, 6), (178, 6)))]
    rows = features.split_at_dateline(frame(spark, [(1, holed), (2, arms), (3, [box(10, 0, 20, 10)]), (4, None)])).collect()
    got = {}
    for r in rows:
        xs = [p.x for p in r.geometry[0]]
        assert min(xs) >= 0 or max(xs) <= 0
        got.setdefault(r.id_geometry, []).append(round(sum(abs(k.signed_area(np.array([(p.x, p.y) for p in q]))) * (1 if i == 0 else -1) for i, q in enumerate(r.geometry)), 6))
    assert {i: sorted(v) for i, v in got.items()} == {1: [1850, 1850], 2: [12, 36], 3: [100]}
