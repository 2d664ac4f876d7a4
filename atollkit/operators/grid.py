"""Planning grids: lattices, polyfill, clipping, metadata and upkeep."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atollkit.functions import crs
from atollkit.functions.geometry_udf import flat, lists_of_polygons
from atollkit.functions.overlay import Overlay, Shapes, ragged
from atollkit.functions.scalars import grid_name, scale_level
from atollkit.operators.spatial import overlay_polygons, spatial_join

R3 = math.sqrt(3)


def edge_of(resolution: int, edge0: float = 64.0) -> float:
    """Edge of a lattice cell: it shrinks by the square root of 7 a step, so that cells grow sevenfold in number."""
    return edge0 / math.sqrt(7) ** resolution


def hexagon(x, y, r: float, flat: bool = False):
    """Geometry column of the regular hexagon of radius r around (x, y)."""
    turn = 0 if flat else 30
    corners = [F.struct((x + r * math.cos(math.radians(60 * k + turn))).alias("x"), (y + r * math.sin(math.radians(60 * k + turn))).alias("y")) for k in range(6)]
    return F.array(F.array(*corners, corners[0]))


def runs_of_cells(geometry: pa.Array, high: float, wide: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the column, lattice row r, first q, last q) of the runs of cells whose centres ((q + r / 2) * wide, r * high) lie in the polygons.

    Every lattice row is crossed with all edges of the batch at once; a polygon's crossings of a row open and close its runs in turn. Lower and
    left edges count."""
    shapes = Shapes(*flat(geometry))
    e, owner = shapes.edges, np.repeat(np.arange(len(geometry)), np.diff(shapes.begin))
    low, high_ = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first = np.floor(low / high).astype(np.int64)
    first += first * high < low
    stop = np.floor(high_ / high).astype(np.int64)
    stop += stop * high < high_  # rows from first up to stop, without it, have low <= y < high
    k, r = ragged(first, np.maximum(stop - first, 0))
    y = r * high
    x = e[k, 0] + (y - e[k, 1]) / (e[k, 3] - e[k, 1]) * (e[k, 2] - e[k, 0])
    order = np.lexsort((x, r, owner[k]))
    opens, closes = order[::2], order[1::2]
    ends = []
    for at in (opens, closes):
        q = np.ceil(x[at] / wide - r[at] / 2).astype(np.int64)
        q -= (q - 1 + r[at] / 2) * wide >= x[at]
        q += (q + r[at] / 2) * wide < x[at]
        ends.append(q)
    some = ends[0] < ends[1]
    return owner[k[opens]][some], r[opens][some], ends[0][some], ends[1][some] - 1


def polyfill(areas: DataFrame, resolution: int, edge0: float = 64.0, variant: str = "standard", block: int = 64) -> DataFrame:
    """Cells whose centre lies in a polygon of areas (project_area, geometry): h3_index, resolution, scale_level,
    project_area, geometry, cost 1.0 and status 0. Overlapping parts give a cell each; polyfill_unique does not.

    A polygon becomes runs of cells along the rows of the lattice, which are dealt out in bands of `block` rows before built-in functions make
    cells of them: one vast area is many tasks, and no geometry travels. Geometries with fewer than four points are skipped."""
    edge = edge_of(resolution, edge0)
    high, wide = 1.5 * edge, R3 * edge

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at, *made = runs_of_cells(t.column("geometry"), high, wide)
            yield pa.RecordBatch.from_arrays([t.column("project_area").take(pa.array(at)), *map(pa.array, made)], ["project_area", "r", "q0", "q1"])

    parts = areas.where(F.size(F.col("geometry")[0]) >= 4).select(F.col("project_area").cast("string").alias("project_area"), "geometry")
    runs = parts.mapInArrow(fill, "project_area string, r long, q0 long, q1 long").repartition("project_area", F.floor(F.col("r") / block))
    cells = runs.select("project_area", "r", F.explode(F.sequence("q0", "q1")).alias("q"))
    name = F.concat(F.lit(f"{resolution}:"), F.col("q").cast("string"), F.lit(":"), F.col("r").cast("string"))
    x, y = (F.col("q") + F.col("r") / 2) * wide, F.col("r") * high
    return cells.select(name.alias("h3_index"), F.lit(resolution).alias("resolution"), scale_level(F.lit(resolution), variant).alias("scale_level"), "project_area", hexagon(x, y, edge).alias("geometry"), F.lit(1.0).alias("cost"), F.lit(0).alias("status"))


def polyfill_unique(areas: DataFrame, resolution: int, **options) -> DataFrame:
    """polyfill with each cell once an area."""
    return polyfill(areas, resolution, **options).dropDuplicates(["h3_index", "project_area", "resolution"])


def polyfill_multi(areas: DataFrame, resolutions: list[int], **options) -> DataFrame:
    """polyfill at several resolutions, with the coarse scale levels."""
    out = None
    for r in resolutions:
        cells = polyfill(areas, r, variant="coarse", **options)
        out = cells if out is None else out.unionByName(cells)
    return out


def lattice(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Rows and columns of a lattice, its cells dealt out over tasks; the plan is of the same size for any lattice."""
    cell = spark.range(rows * cols)
    return cell.select(F.expr(f"CAST(id DIV {max(cols, 1)} AS INT)").alias("row_number"), F.expr(f"CAST(id % {max(cols, 1)} AS INT)").alias("col_number"))


def hex_grid_pointy(spark: SparkSession, box: tuple, r: float, clip: bool = False) -> DataFrame:
    """Pointy-top hexagons, odd rows half a column to the right: rows while y < y1 + 1.5 r, columns while x < x1 + sqrt(3) r."""
    x0, y0, x1, y1 = box
    if r <= 0:
        raise ValueError("the radius must be positive")
    count = lambda low, high, step: max(0, math.ceil((high + step - low) / step - 1e-12))
    cells = lattice(spark, count(y0, y1, 1.5 * r), count(x0, x1, R3 * r))
    x = x0 + F.col("col_number") * (R3 * r) + (F.col("row_number") % 2) * (R3 * r / 2)
    out = cells.withColumn("x", x).withColumn("y", y0 + F.col("row_number") * (1.5 * r)).withColumn("geometry", hexagon(F.col("x"), F.col("y"), r))
    if not clip:
        return out
    return clip_to_box(out, box)


def hex_grid_flat(spark: SparkSession, box: tuple, side: float) -> DataFrame:
    """Flat-top hexagons: columns 1.5 sides apart, rows sqrt(3) sides, every second column half a row up. The corners of the
    box may come in any order."""
    xs, ys = sorted((box[0], box[2])), sorted((box[1], box[3]))
    h, v = 1.5 * side, R3 * side
    first = lambda low, step: math.ceil(low / step) - 1
    i0, i1, j0, j1 = first(xs[0], h), math.ceil(xs[1] / h) + 1, first(ys[0], v), math.ceil(ys[1] / v) + 1
    cells = lattice(spark, i1 - i0, j1 - j0).withColumnsRenamed({"row_number": "a", "col_number": "b"})
    i, j = F.col("a") + i0, F.col("b") + j0
    out = cells.select(i.alias("i"), j.alias("j"), (i * h).alias("x"), ((j + F.pmod(i, F.lit(2)) / 2) * v).alias("y"))
    return out.withColumn("geometry", hexagon(F.col("x"), F.col("y"), side, flat=True))


def square_grid(spark: SparkSession, box: tuple, w: float, h: float, clamp: bool = False) -> DataFrame:
    """Rectangles from the top left down; with clamp the last ones are cut to the box and ids run 1..n row by row."""
    x0, y0, x1, y1 = box
    if w <= 0 or h <= 0:
        raise ValueError("cells need a positive size")
    rows, cols = math.ceil((y1 - y0) / h), math.ceil((x1 - x0) / w)
    c = lattice(spark, rows, cols).withColumnsRenamed({"row_number": "r", "col_number": "c"})
    left, top = x0 + F.col("c") * w, y1 - F.col("r") * h
    right, bottom = left + w, top - h
    if clamp:
        right, bottom = F.least(right, F.lit(float(x1))), F.greatest(bottom, F.lit(float(y0)))
    out = c.select("r", "c", crs.box_geometry(left, bottom, right, top).alias("geometry"))
    return out.select((F.col("r") * cols + F.col("c") + 1).cast("long").alias("id"), "geometry") if clamp else out


def make_grid(area: DataFrame, box: tuple, kind: str, cell_width: float | None = None, cell_area: float | None = None, clip: bool = False) -> DataFrame:
    """Square or hexagonal cells over the box grown by a cell; with clip cut to the area, else those that meet it.

    ids 1..n follow the cells' place, row by row."""
    if kind not in ("square", "hexagonal"):
        raise ValueError(f"unknown kind {kind!r}")
    if cell_width is None and cell_area is None:
        raise ValueError("a cell width or area is needed")
    if cell_width is None:
        cell_width = math.sqrt(cell_area) if kind == "square" else math.sqrt(2 * cell_area / R3)
    grown = (box[0] - cell_width, box[1] - cell_width, box[2] + cell_width, box[3] + cell_width)
    spark = area.sparkSession
    cells = square_grid(spark, grown, cell_width, cell_width).select("r", "c", "geometry") if kind == "square" else hex_grid_pointy(spark, grown, cell_width / R3).select(F.col("row_number").alias("r"), F.col("col_number").alias("c"), "geometry")
    cells = cells.withColumn("cell", F.concat_ws(":", "r", "c"))
    kept = clip_grid(cells, area) if clip else cells_intersecting(cells, area)
    at = kept.groupBy("r").agg(F.count("*").alias("n"))
    before = at.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))  # one row a lattice row
    place = F.row_number().over(Window.partitionBy("r").orderBy("c", "geometry"))
    return kept.withColumn("place", place).join(before, "r").select((F.col("before") + F.col("place")).alias("id"), "geometry")


def clip_to_box(cells: DataFrame, box: tuple) -> DataFrame:
    """Cells cut to a rectangle, a row for each part; those outside go."""
    x0, y0, x1, y1 = box
    corners = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)

    def run(column: pa.Array) -> pa.Array:
        window = Shapes(np.array([0, 1]), np.array([0, 5]), corners)
        n = np.arange(len(column))
        return lists_of_polygons(Overlay(Shapes(*flat(column)), window, n, n * 0).polygons())

    cut = F.arrow_udf(run, f"array<{crs.GEOMETRY}>")
    others = [c for c in cells.columns if c != "geometry"]
    return cells.where(F.col("geometry").isNotNull()).select(*others, F.explode(cut("geometry")).alias("geometry")).select(cells.columns)


def clip_grid(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells (any polygons, with a key cell) cut to the polygons of area, attributes kept: a row for each polygon of what a cell and an
    area share, so a cell that the area's arms cross gives several. What only touches gives none."""
    return overlay_polygons(cells, area.select(F.col("geometry").alias("other"))).select(*cells.columns)


def cells_intersecting(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells that meet any polygon of area; none gives an empty table."""
    found = spatial_join(cells.select("cell", "geometry"), area.select(F.col("geometry").alias("other")), "geometry", "other", geometries=False)
    return cells.join(found.select("cell").distinct(), "cell", "left_semi").select(*cells.columns)


def number_units(df: DataFrame, by: str, order: str) -> DataFrame:
    """puid 1..n within each region, in the order of the given column."""
    return df.withColumn("puid", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def grid_metadata(cells: DataFrame) -> DataFrame:
    """A row for each (project_area, resolution): name, alias, area in km2, envelope and count of the cells' geometries."""
    rows = cells.select("project_area", "resolution", crs.planar_area(crs.to_ease2(F.col("geometry"))).alias("a"), crs.bbox(F.col("geometry")).alias("b"))
    out = rows.groupBy("project_area", "resolution").agg((F.sum("a") / 1e6).alias("area_km2"), F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"), F.count("*").alias("planning_unit_count"))
    alias = F.concat(F.col("project_area"), F.lit(" (Res "), F.col("resolution").cast("string"), F.lit(")"))
    return out.withColumn("feature_class_name", grid_name(F.col("project_area"), F.col("resolution"))).withColumn("alias", alias)


def list_grids(cells: DataFrame) -> DataFrame:
    return cells.select("project_area", "resolution").distinct().orderBy("project_area", "resolution")


def grid_slice(cells: DataFrame, area: str, resolution: int) -> DataFrame:
    return cells.where((F.col("project_area") == area) & (F.col("resolution") == resolution))


def write_grids(cells: DataFrame, path: str) -> None:
    """One folder for each area and resolution, so that a slice reads its own files alone."""
    cells.write.mode("overwrite").partitionBy("project_area", "resolution").parquet(path)


def read_grids(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_grids wrote; the schema is given, as no grids leave no files to infer it from."""
    return spark.read.schema(schema).parquet(path)


def replace_grid(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing without the rows of new's areas and resolutions, and new."""
    keys = new.select("project_area", "resolution").distinct()
    return existing.join(keys, ["project_area", "resolution"], "left_anti").select(existing.columns).unionByName(new)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those rows of new whose key it lacks; of equal new keys one row."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(existing.columns))


def linked_projects(grids: DataFrame, projects: DataFrame) -> DataFrame:
    """Each grid with the number of projects that use it; a grid in use may not be changed."""
    used = projects.groupBy(F.col("planning_unit_id").alias("unique_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grids.join(used, "unique_id", "left").select("unique_id", n.alias("projects"), (n == 0).alias("free"))


def import_grid_checks(df: DataFrame) -> DataFrame:
    """One row with the count of puid (nulls not counted) of an uploaded grid, its puid cast to integers, and, where it has
    geometries, their envelope (x0, y0, x1, y1); puid must be lower case."""
    if "puid" not in df.columns:
        wrong = "upper-case" if any(c.lower() == "puid" for c in df.columns) else "no"
        raise ValueError(f"the grid has {wrong} puid column")
    counted = [F.count("puid").alias("planning_unit_count")]
    if "geometry" not in df.columns:
        return df.select(F.col("puid").try_cast("int").alias("puid")).agg(*counted)
    ends = [(F.min if c.endswith("0") else F.max)(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return df.select(F.col("puid").try_cast("int").alias("puid"), crs.bbox(F.col("geometry")).alias("b")).agg(*counted, *ends)
