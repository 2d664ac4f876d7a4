"""Queries of planning grids."""

from pyspark.sql import functions as F

from atollkit.functions import crs
from atollkit.operators import grid as g
from atollkit.plans.domain import query
from atollkit.plans.q_features import boxes, unit_squares

EDGE0 = 2.0
CELL = "1.5 * 2.0 / power(sqrt(7.0), 1)", "sqrt(3.0) * 2.0 / power(sqrt(7.0), 1)"
FILLED = f"SELECT b.feature_id % 7 AS k, q, r FROM boxes b, LATERAL (SELECT unnest(range(CAST(floor(b.y0 / ({CELL[0]})) AS BIGINT) - 1, CAST(ceil(b.y1 / ({CELL[0]})) AS BIGINT) + 1)) AS r) y, LATERAL (SELECT unnest(range(CAST(floor(b.x0 / ({CELL[1]}) - y.r / 2.0) AS BIGINT) - 1, CAST(ceil(b.x1 / ({CELL[1]}) - y.r / 2.0) AS BIGINT) + 2)) AS q) x WHERE (q + r / 2.0) * ({CELL[1]}) >= b.x0 AND (q + r / 2.0) * ({CELL[1]}) < b.x1 AND r * ({CELL[0]}) >= b.y0 AND r * ({CELL[0]}) < b.y1"


def areas(t):
    return boxes(t).select((F.col("feature_id") % 7).cast("string").alias("project_area"), "geometry")


@query("gr1_polyfill", f"SELECT CAST(k AS VARCHAR) AS project_area, concat('1:', q, ':', r) AS h3_index, 'basin' AS scale_level, 1.0::DOUBLE AS cost FROM ({FILLED}) f")
def gr1(t):
    return g.polyfill(areas(t), 1, edge0=EDGE0).select("project_area", "h3_index", "scale_level", "cost")


#: Centres within a triangle over each box, below its falling side.
SLOPED = FILLED.replace("b.feature_id % 7 AS k", "b.feature_id AS k").replace(f"r * ({CELL[0]}) < b.y1", f"r * ({CELL[0]}) < b.y1 AND (q + r / 2.0) * ({CELL[1]}) < (b.x0 - b.x1) * (r * ({CELL[0]}) - b.y0) / (b.y1 - b.y0) + b.x1")


@query("gr1_polyfill_slopes", f"SELECT CAST(k AS VARCHAR) AS project_area, concat('1:', q, ':', r) AS h3_index FROM ({SLOPED}) f")
def gr1b(t):
    b = t("boxes")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    slope = F.array(F.array(p(b.x0, b.y0), p(b.x1, b.y0), p(b.x0, b.y1), p(b.x0, b.y0)))
    return g.polyfill(b.select(F.col("feature_id").cast("string").alias("project_area"), slope.alias("geometry")), 1, edge0=EDGE0).select("project_area", "h3_index")


@query("gr2_polyfill_unique", f"SELECT DISTINCT CAST(k AS VARCHAR) AS project_area, concat('1:', q, ':', r) AS h3_index FROM ({FILLED}) f")
def gr2(t):
    return g.polyfill_unique(areas(t), 1, edge0=EDGE0).select("project_area", "h3_index")


@query("gr3_polyfill_multi", f"SELECT CAST(k AS VARCHAR) AS project_area, concat('1:', q, ':', r) AS h3_index, CAST(1 AS INT) AS resolution, 'basin' AS scale_level FROM ({FILLED}) f UNION ALL SELECT CAST(k AS VARCHAR), concat('0:', q, ':', r), 0, 'basin' FROM ({FILLED.replace('power(sqrt(7.0), 1)', '1.0')}) f")
def gr3(t):
    return g.polyfill_multi(areas(t), [0, 1], edge0=EDGE0).select("project_area", "h3_index", "resolution", "scale_level")


def extent(t):
    """The box around all boxes, for lattices that follow the data."""
    b = t("boxes").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    return tuple(float(x) for x in b)


BOX = "(SELECT MIN(x0) AS x0, MIN(y0) AS y0, MAX(x1) AS x1, MAX(y1) AS y1 FROM boxes)"


@query("gr4_hex_grid_pointy", f"SELECT CAST(a AS INT) AS row_number, CAST(b AS INT) AS col_number, round(x0 + b * sqrt(3.0) + (a % 2) * sqrt(3.0) / 2, 6) AS x, round(y0 + a * 1.5, 6) AS y FROM {BOX} e, LATERAL (SELECT unnest(range(0, CAST(ceil((e.y1 + 1.5 - e.y0) / 1.5) AS BIGINT))) AS a) p, LATERAL (SELECT unnest(range(0, CAST(ceil((e.x1 + sqrt(3.0) - e.x0) / sqrt(3.0)) AS BIGINT))) AS b) q")
def gr4(t):
    return g.hex_grid_pointy(t.spark, extent(t), 1.0).select("row_number", "col_number", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("gr5_hex_grid_flat", f"SELECT i, j, round(i * 3.0, 6) AS x, round((j + (i % 2) / 2.0) * sqrt(3.0) * 2, 6) AS y FROM (SELECT CAST(unnest(range(CAST(ceil(x0 / 3.0) AS BIGINT) - 1, CAST(ceil(x1 / 3.0) AS BIGINT) + 1)) AS INT) AS i, y0, y1 FROM {BOX} e) a, LATERAL (SELECT CAST(unnest(range(CAST(ceil(a.y0 / (sqrt(3.0) * 2)) AS BIGINT) - 1, CAST(ceil(a.y1 / (sqrt(3.0) * 2)) AS BIGINT) + 1)) AS INT) AS j) b WHERE i >= 0 UNION ALL SELECT i, j, round(i * 3.0, 6), round((j + 0.5) * sqrt(3.0) * 2, 6) FROM (SELECT CAST(-1 AS INT) AS i, y0, y1, x0 FROM {BOX} e) a, LATERAL (SELECT CAST(unnest(range(CAST(ceil(a.y0 / (sqrt(3.0) * 2)) AS BIGINT) - 1, CAST(ceil(a.y1 / (sqrt(3.0) * 2)) AS BIGINT) + 1)) AS INT) AS j) b WHERE ceil(a.x0 / 3.0) - 1 = -1")
def gr5(t):
    return g.hex_grid_flat(t.spark, extent(t), 2.0).select("i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("gr6_square_grid", f"SELECT CAST(r * nc + c + 1 AS BIGINT) AS id, CAST((least(x0 + (c + 1) * 4, x1) - (x0 + c * 4)) * ((y1 - r * 3) - greatest(y1 - (r + 1) * 3, y0)) AS DOUBLE) AS area FROM (SELECT *, CAST(ceil((x1 - x0) / 4.0) AS BIGINT) AS nc, CAST(ceil((y1 - y0) / 3.0) AS BIGINT) AS nr FROM {BOX} e) z, LATERAL (SELECT unnest(range(0, z.nr)) AS r) p, LATERAL (SELECT unnest(range(0, z.nc)) AS c) q")
def gr6(t):
    return g.square_grid(t.spark, extent(t), 4.0, 3.0, clamp=True).select("id", crs.planar_area(F.col("geometry")).alias("area"))


@query("gr7_make_grid", f"SELECT CAST(SUM(1) AS BIGINT) AS n, CAST(COUNT(DISTINCT id) AS BIGINT) AS ids, CAST(MAX(id) AS BIGINT) AS last FROM (SELECT ROW_NUMBER() OVER () AS id FROM (SELECT DISTINCT r, c FROM (SELECT *, CAST(ceil((x1 - x0 + 8) / 4.0) AS BIGINT) AS nc, CAST(ceil((y1 - y0 + 8) / 4.0) AS BIGINT) AS nr FROM {BOX} e) z, LATERAL (SELECT unnest(range(0, z.nr)) AS r) p, LATERAL (SELECT unnest(range(0, z.nc)) AS c) q, boxes b WHERE z.x0 - 4 + c * 4 <= b.x1 AND z.x0 - 4 + c * 4 + 4 >= b.x0 AND z.y1 + 4 - r * 4 >= b.y0 AND z.y1 + 4 - r * 4 - 4 <= b.y1) d) k")
def gr7(t):
    cells = g.make_grid(boxes(t), extent(t), "square", cell_width=4.0)
    return cells.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").cast("long").alias("last"))


@query("gr7_make_grid_cells", f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY r, c) AS BIGINT) AS id, CAST(x0 - 4 + c * 4 AS DOUBLE) AS x0, CAST(y1 - r * 4 AS DOUBLE) AS y0, CAST(x0 + c * 4 AS DOUBLE) AS x1, CAST(y1 + 4 - r * 4 AS DOUBLE) AS y1 FROM (SELECT DISTINCT r, c, z.x0, z.y1 FROM (SELECT *, CAST(ceil((x1 - x0 + 8) / 4.0) AS BIGINT) AS nc, CAST(ceil((y1 - y0 + 8) / 4.0) AS BIGINT) AS nr FROM {BOX} e) z, LATERAL (SELECT unnest(range(0, z.nr)) AS r) p, LATERAL (SELECT unnest(range(0, z.nc)) AS c) q, boxes b WHERE z.x0 - 4 + c * 4 <= b.x1 AND z.x0 + c * 4 >= b.x0 AND z.y1 + 4 - r * 4 >= b.y0 AND z.y1 - r * 4 <= b.y1) d")
def gr7_cells(t):
    box = (0.0, 0.0, 0.0, 0.0) if t("boxes").isEmpty() else extent(t)
    cells = g.make_grid(boxes(t), box, "square", cell_width=4.0).withColumn("b", crs.bbox(F.col("geometry")))
    return cells.select(F.col("id").cast("long").alias("id"), "b.x0", "b.y0", "b.x1", "b.y1")


OVERLAP = "greatest(0, least(b.x1, u.ix + 1) - greatest(b.x0, u.ix)) * greatest(0, least(b.y1, u.iy + 1) - greatest(b.y0, u.iy))"


@query("gr8_clip_grid", f"SELECT u.id, CAST({OVERLAP} AS DOUBLE) AS area FROM units u JOIN boxes b ON {OVERLAP} > 0")
def gr8(t):
    cells = unit_squares(t).select("id", F.col("id").alias("cell"), "geometry")
    return g.clip_grid(cells, boxes(t)).select("id", F.round(crs.planar_area(F.col("geometry")), 9).alias("area"))


def shared(x0, y0, x1, y1):
    return f"(greatest(0, least(b.x1, s.x0 + {x1}) - greatest(b.x0, s.x0 + {x0})) * greatest(0, least(b.y1, s.y0 + {y1}) - greatest(b.y0, s.y0 + {y0})))"


ARMS = f"CASE WHEN b.y0 < s.y0 + 1 THEN 1 ELSE CAST({shared(0, 0, 1, 3)} > 0 AS INT) + CAST({shared(2, 0, 3, 3)} > 0 AS INT) END"


@query("gr8_clip_to_arms", f"SELECT feature_id, CAST(SUM(n) AS BIGINT) AS parts, CAST(SUM(area) AS DOUBLE) AS area FROM (SELECT b.feature_id, {ARMS} AS n, {shared(0, 0, 3, 3)} - {shared(1, 1, 2, 3)} AS area FROM boxes b JOIN sites s ON {shared(0, 0, 3, 3)} > {shared(1, 1, 2, 3)}) x GROUP BY feature_id")
def gr8b(t):
    """Cells cut by areas with two arms: a cell across both gives two polygons."""
    s = t("sites")
    p = lambda x, y: F.struct((s.x0 + x).cast("double").alias("x"), (s.y0 + y).cast("double").alias("y"))
    arms = F.array(F.array(*(p(x, y) for x, y in ((0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)))))
    cut = g.clip_grid(boxes(t).withColumn("cell", F.col("feature_id")), s.select(arms.alias("geometry")))
    return cut.groupBy("feature_id").agg(F.count("*").alias("parts"), F.round(F.sum(crs.planar_area(F.col("geometry"))), 6).alias("area"))


@query("gr8_clip_to_holed", f"SELECT b.feature_id, CAST(SUM({shared(0, 0, 3, 3)} - {shared(1, 1, 2, 2)}) AS DOUBLE) AS area FROM boxes b JOIN sites s ON {shared(0, 0, 3, 3)} > {shared(1, 1, 2, 2)} GROUP BY b.feature_id")
def gr8c(t):
    s = t("sites")
    holed = F.concat(crs.box_geometry(s.x0, s.y0, s.x0 + 3, s.y0 + 3), crs.box_geometry(s.x0 + 1, s.y0 + 1, s.x0 + 2, s.y0 + 2))
    cut = g.clip_grid(boxes(t).withColumn("cell", F.col("feature_id")), s.select(holed.alias("geometry")))
    return cut.groupBy("feature_id").agg(F.round(F.sum(crs.planar_area(F.col("geometry"))), 6).alias("area"))


@query("gr9_cells_intersecting", "SELECT DISTINCT u.id FROM units u JOIN boxes b ON b.x0 <= u.ix + 1 AND b.x1 >= u.ix AND b.y0 <= u.iy + 1 AND b.y1 >= u.iy")
def gr9(t):
    cells = unit_squares(t).select("id", F.col("id").alias("cell"), "geometry")
    return g.cells_intersecting(cells, boxes(t)).select("id")


@query("gr10_number_units", "SELECT h3_index, CAST(ROW_NUMBER() OVER (PARTITION BY project_area ORDER BY h3_index) AS INT) AS puid FROM cells")
def gr10(t):
    return g.number_units(t("cells"), "project_area", "h3_index").select("h3_index", "puid")


def unit_cells(t):
    b = t("part")
    x, y = F.col("p_partkey") % 50, F.floor(F.col("p_partkey") / 50)
    return b.select("p_partkey", F.col("p_type").alias("project_area"), (F.lit(5) + F.col("p_size") % 4).cast("int").alias("resolution"), crs.box_geometry(x, y, x + 1, y + 1).alias("geometry"))


@query("gr11_grid_metadata", "SELECT project_area, resolution, COUNT(*) AS planning_unit_count, CAST(MIN(x) AS DOUBLE) AS x0, CAST(MAX(x) + 1 AS DOUBLE) AS x1, concat('v_h3_', lower(project_area), '_res', resolution) AS feature_class_name FROM (SELECT p_type AS project_area, CAST(5 + p_size % 4 AS INT) AS resolution, p_partkey % 50 AS x FROM part) u GROUP BY project_area, resolution")
def gr11(t):
    return g.grid_metadata(unit_cells(t)).select("project_area", "resolution", "planning_unit_count", "x0", "x1", "feature_class_name")


@query("gr12_grid_slices", "SELECT lower(trim(project_area)) AS project_area, resolution, h3_index FROM cells WHERE resolution = 7")
def gr12(t):
    from atollkit.plans.q_sources import scratch

    path = scratch(t, "grids")
    cells = t("cells").withColumn("project_area", F.lower(F.trim("project_area")))
    g.write_grids(cells, path)
    written = g.read_grids(t.spark, path, cells.schema)
    names = g.list_grids(written).where("resolution = 7")
    return written.where("resolution = 7").join(names, ["project_area", "resolution"], "left_semi").select("project_area", "resolution", "h3_index")


@query("gr13_replace_grid", "SELECT h3_index, project_area, resolution, cost FROM cells WHERE resolution != 6 OR lower(trim(project_area)) != 'economy' OR project_area NOT IN (SELECT project_area FROM cells WHERE resolution = 6 AND lower(trim(project_area)) = 'economy') UNION ALL SELECT concat(h3_index, 'n'), project_area, resolution, 2.0 FROM cells WHERE resolution = 6 AND lower(trim(project_area)) = 'economy'")
def gr13(t):
    cells = t("cells").select("h3_index", "project_area", "resolution", "cost")
    new = cells.where("resolution = 6 AND lower(trim(project_area)) = 'economy'").withColumns({"h3_index": F.concat("h3_index", F.lit("n")), "cost": F.lit(2.0)})
    return g.replace_grid(cells, new)


@query("gr14_insert_if_absent", "SELECT feature_class_name, alias FROM grids UNION ALL SELECT concat('new_', n_nationkey), n_name FROM nation")
def gr14(t):
    new = t("nation").select(F.concat(F.lit("new_"), "n_nationkey").alias("feature_class_name"), F.col("n_name").alias("alias"))
    there = t("grids").select("feature_class_name", "alias")
    return g.insert_if_absent(there, new.unionByName(there.withColumn("alias", F.lit("other"))), "feature_class_name")


@query("gr15_linked_projects", "SELECT g.unique_id, COUNT(p.id) AS projects, COUNT(p.id) = 0 AS free FROM grids g LEFT JOIN projects p ON p.planning_unit_id = g.unique_id GROUP BY g.unique_id")
def gr15(t):
    return g.linked_projects(t("grids"), t("projects"))


@query("gr16_import_grid_envelope", "SELECT COUNT(*) AS planning_unit_count, CAST(MIN(ix) AS DOUBLE) AS x0, CAST(MIN(iy) AS DOUBLE) AS y0, CAST(MAX(ix) + 1 AS DOUBLE) AS x1, CAST(MAX(iy) + 1 AS DOUBLE) AS y1 FROM units")
def gr16b(t):
    return g.import_grid_checks(unit_squares(t).withColumnRenamed("id", "puid"))


@query("gr16_import_grid_checks", "SELECT COUNT(*) AS planning_unit_count FROM part WHERE p_size % 3 != 0")
def gr16(t):
    return g.import_grid_checks(t("part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_partkey").cast("string")).alias("puid")))
