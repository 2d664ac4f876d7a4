"""What keeps queries whole on large tables: plans and work that do not grow beyond the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atollkit.functions.overlay import Shapes
from atollkit.operators import spatial
from atollkit.operators.grid import lattice
from atollkit.operators.projects import unit_detail
from atollkit.operators.spatial import dissolved
from atollkit.plans import domain, registry
from atollkit.sources import geometry_io, io

SF = "/root/testdata/sf0.001"

#: Sides of a spatial join grow with their boxes' cells, which the size of their file does not tell.
SHUFFLED = ["sj1_intersects", "pa3_protected_for_all", "sj2_points_in_polygons", "fe6_amounts_slanted"]


def nodes(df):
    """The nodes of a query's plan before it runs."""
    def walk(p):
        yield p
        for k in range(p.children().size()):
            yield from walk(p.children().apply(k))

    root = df._jdf.queryExecution().executedPlan()
    return list(walk(root.initialPlan() if root.nodeName() == "AdaptiveSparkPlan" else root))


@pytest.mark.parametrize("name", SHUFFLED)
def test_no_side_is_broadcast(spark, name):
    assert not any("Broadcast" in n.nodeName() for n in nodes(registry.queries()[name](spark, SF)))


def test_bounds_are_no_join_of_all_with_all(spark):
    tables = domain.Tables(spark, SF)
    assert not any("Cartesian" in n.nodeName() or "NestedLoop" in n.nodeName() for n in nodes(tables("bounds")))
    pairs = tables.sql("SELECT * FROM bounds")
    assert sorted(pairs.collect()) == sorted(tables.sql(domain.VIEWS["bounds"]).collect())


def test_wide_grid(spark, tmp_path):
    """A line's work goes with its length: 60,000 columns, of which few have values."""
    cells = spark.range(60000).where("id % 7 = 3").selectExpr("'a' AS layer", "CAST(id % 2 AS INT) AS r", "CAST(id AS INT) AS c", "CAST(id AS DOUBLE) AS v")
    geometry_io.write_ascii_grids(cells, f"{tmp_path}/g", 3, 60000)
    lines = spark.read.text(f"{tmp_path}/g").where("length(value) > 1000")
    assert {r[0] for r in lines.selectExpr("size(split(value, ' '))").collect()} == {60000} and lines.count() == 3
    assert sorted(io.read_ascii_grid(spark, f"{tmp_path}/g", "*.txt").collect()) == sorted(cells.collect())
    with pytest.raises(Exception, match="two values in one place"):
        geometry_io.write_ascii_grids(cells.unionByName(cells), f"{tmp_path}/h", 3, 60000)


def test_lattice_of_one_row_is_many_tasks(spark):
    cells = lattice(spark, 1, 100000)
    assert cells.select(F.spark_partition_id()).distinct().count() > 1
    assert cells.agg(F.min("col_number"), F.max("col_number"), F.max("row_number"), F.count("*")).first() == (0, 99999, 0, 100000)
    assert lattice(spark, 5, 0).count() == 0


def test_unit_detail_shuffles_no_pairs(spark):
    """Pairs of units and features, as many as the result's rows, are made last; amounts given twice stay two rows."""
    units = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "c", 1.0)], "project_id long, h3_index string, cost double")
    wanted = spark.createDataFrame([(1, 7), (1, 8), (3, 7)], "project_id long, feature_unique_id long")
    amounts = spark.createDataFrame([(1, "a", 7, 1.0), (1, "a", 7, 3.0), (1, "b", 9, 4.0), (1, "b", 8, None)], "project_id long, h3_index string, feature_unique_id long, amount double")
    meta = spark.createDataFrame([(7, "x"), (8, "y")], "unique_id long, alias string")
    got = unit_detail(units, wanted, amounts, meta)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "a", 2.0, "x", 1.0), (1, "a", 2.0, "x", 3.0), (1, "a", 2.0, "y", None), (1, "b", 0.0, "x", None), (1, "b", 0.0, "y", None)]))
    for n in nodes(got):
        if n.nodeName() == "Exchange":
            assert not {"cost", "alias"} <= {n.output().apply(k).name() for k in range(n.output().size())}


def test_dissolved_area_of_a_long_cell():
    """Cuts of a cell 753.75 high by boxes at whole heights are rounded; no area may get lost for that."""
    boxes = [(k * 3 % 43, k * 11 % 37 + k // 37 * 37, k * 3 % 43 + 2 + k % 6, k * 11 % 37 + k // 37 * 37 + 1 + k % 5) for k in range(0, 800, 7)]
    corners = np.array([[(a, b), (c, b), (c, d), (a, d), (a, b)] for a, b, c, d in boxes], float).reshape(-1, 2)
    shapes = Shapes(np.arange(len(boxes) + 1), 5 * np.arange(len(boxes) + 1), corners)
    spans = {}
    for a, b, c, d in boxes:
        for y in range(b, min(d, 753)):
            spans.setdefault(y, []).append((max(a, 6.125), min(c, 12.25)))
    steps = np.arange(6.125, 12.25, 0.125) + 0.0625
    want = sum(0.125 * np.any([(steps > a) & (steps < c) for a, c in rows], axis=0).sum() for rows in spans.values())
    assert dissolved(shapes, (6.125, 0.0, 12.25, 753.75)) == pytest.approx(want, abs=1e-6)


def test_units_of_one_area_are_many_groups(spark):
    joins = [n for n in nodes(registry.queries()["pu1_populate_units"](spark, SF)) if n.nodeName() == "SortMergeJoin"]
    assert any("part" in n.simpleString(1000).split("Inner")[0] for n in joins)


def test_parameters_stay_dealt_out(spark):
    """Numbered partitions are not put together at run time."""
    df = registry.queries()["pu19_set_parameters"](spark, SF)
    assert any(n.nodeName() == "Exchange" and "REPARTITION_BY_NUM" in n.simpleString(1000) for n in nodes(df))


def test_equal_boxes_meet_once(spark):
    """Copies of shapes and points, however many, are one pair for the kernels; each row still gets its partners."""
    from atollkit.functions import crs

    p = lambda x, y: F.struct((F.col("at") + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    notched = F.array(F.array(*(p(x, y) for x, y in ((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0)))))
    many = spark.range(900).selectExpr("id AS a", "id % 3 AS at").select("a", notched.alias("geometry"))
    x = F.col("b") % 2
    few = spark.range(2).withColumnRenamed("id", "b").select("b", crs.box_geometry(x, F.lit(0), x + 1, F.lit(1)).alias("other"))
    made = spatial.valued(many, few, "geometry", "other", spatial.shared_area, lambda o: np.full(o.n, float(o.n)), "double")
    assert made.count() == 1500 and made.agg(F.max("_value")).first()[0] <= 6
    areas = spatial.overlap_areas(many, few)
    assert sorted(map(tuple, areas.collect())) == sorted((a, b, 1.0) for a in range(900) for b in range(2) if b >= a % 3)
    points = spark.range(1200).selectExpr("id", "id % 4 + 0.5D AS x", "0.5D AS y")
    found = spatial.points_in_polygons(points, many, geometries=False)
    assert sorted(map(tuple, found.select("id", "a").collect())) == sorted((i, a) for i in range(1200) for a in range(900) if 0 <= i % 4 - a % 3 < 3)


def test_partitions_of_a_join_go_with_its_boxes(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DEALT", 1)
    monkeypatch.setattr(spatial, "TASK", 1000)
    joined = registry.queries()["sj1_touches"](spark, "/root/testdata/sf0.1")
    assert any(n.nodeName() == "Exchange" and "REPARTITION_BY_NUM" in n.simpleString(1000) for n in nodes(joined))


def test_sites_of_a_category_count_once(spark):
    """Equal sites of a category are one before they meet units."""
    df = registry.queries()["pa3_protected_for_all"](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert any("iucn_cat" in line and "other" in line for line in text.splitlines() if "Aggregate" in line)


def test_changed_units_are_worked_out_once(spark):
    """What a new release changes is read from where it was written, not joined again by each plan that uses it."""
    text = registry.queries()["io12_redo_intersections"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in text


def test_geometries_are_boxed_once(spark):
    """Cells are found once for each different box: no Python function runs on every row of a side below the aggregate that leaves equal boxes out, and
    geometries, which are boxed when the sides are written, are not in the plan."""
    square = "array(array(named_struct('x', {0}, 'y', {1}), named_struct('x', {0} + 2, 'y', {1}), named_struct('x', {0} + 2, 'y', {1} + 2), named_struct('x', {0}, 'y', {1} + 2), named_struct('x', {0}, 'y', {1})))"
    many = spark.range(2000).selectExpr("id AS a", square.format("CAST(id % 40 AS DOUBLE)", "CAST(id % 30 AS DOUBLE)") + " AS geometry")
    few = spark.range(50).selectExpr("id AS b", square.format("CAST(id AS DOUBLE)", "CAST(id AS DOUBLE)") + " AS other")
    pairs = spatial.spatial_join(many, few, pred="touches", geometries=False)
    plan = pairs._jdf.queryExecution().optimizedPlan()

    def walk(p, below):
        yield p, below
        for k in range(p.children().size()):
            yield from walk(p.children().apply(k), below or p.nodeName() == "Aggregate")

    python = [below for p, below in walk(plan, False) if "EvalPython" in p.nodeName()]
    assert len(python) == 2 and not any(python)
    met = {(i, j) for i in range(2000) for j in range(50) if max(abs(i % 40 - j), abs(i % 30 - j)) == 2}
    assert sorted(map(tuple, pairs.collect())) == sorted(met)


def test_equal_rows_of_a_side_count_once(spark):
    square = "array(array(named_struct('x', {0}, 'y', 0D), named_struct('x', {0} + 1, 'y', 0D), named_struct('x', {0} + {1}, 'y', 1D), named_struct('x', {0}, 'y', 1D), named_struct('x', {0}, 'y', 0D)))"
    few = spark.range(3).selectExpr("id AS a", square.format("CAST(id * 9 AS DOUBLE)", "1D") + " AS geometry")
    for wide in ("1D", "2D"):  # rectangles, other shapes
        many = spark.range(600).selectExpr("id % 2 AS b", "NULL AS c", square.format("CAST(id % 3 * 9 AS DOUBLE)", wide) + " AS other")
        got = spatial.spatial_join(few, many, geometries=False, distinct=True)
        assert sorted(map(tuple, got.collect())) == [(i, j, None) for i in range(3) for j in range(2)]
        assert spatial.spatial_join(few, many, geometries=False).count() == 600
