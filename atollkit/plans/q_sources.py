"""Queries of sources and sinks: what is written is read back."""

import uuid

from pyspark.sql import functions as F

from atollkit.functions import crs
from atollkit.plans.domain import query
from atollkit.session import shared_folder
from atollkit.sources import geometry_io, io


def scratch(t, kind):
    """A new folder that all executors share."""
    return f"{shared_folder(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("io1_read_table", "SELECT species, pu, amount FROM puvspr")
def io1(t):
    path = scratch(t, "puvspr")
    io.write_table(t("puvspr"), path)
    return io.read_table(t.spark, path, "species long, pu long, amount double")


@query("io2_read_runs", "SELECT planning_unit, selected, run FROM solutions")
def io2(t):
    path = scratch(t, "runs")
    lines = t("solutions").select(F.concat_ws(",", "planning_unit", "selected").alias("value"), F.format_string("output_r%05d.csv", "run").alias("file"))
    lines.repartition("file").write.partitionBy("file").text(path)
    return io.read_runs(t.spark, f"{path}/file=*", "r")


PARAMS = """SELECT project_id, 'BLM' AS key, CAST(o_custkey AS VARCHAR) AS value, CAST(NULL AS BOOLEAN) AS flag FROM params JOIN orders ON o_orderkey = project_id
UNION ALL SELECT project_id, 'NUMREPS', CAST(project_id % 100 AS VARCHAR), NULL FROM params
UNION ALL SELECT project_id, 'PRIVATE', CASE WHEN project_id % 2 = 0 THEN 'True' ELSE 'False' END, project_id % 2 = 0 FROM params
UNION ALL SELECT project_id, 'PLANNING_UNIT_NAME', concat('pu_', lower(o_orderstatus)), NULL FROM params JOIN orders ON o_orderkey = project_id"""


@query("io3_parse_params", f"SELECT project_id, key, value, flag FROM ({PARAMS}) p")
def io3(t):
    return io.parse_params(t("params"))


@query("io4_categorise_params", f"SELECT category, COUNT(*) AS n FROM (SELECT CASE WHEN key IN ('BLM', 'NUMREPS') THEN 'run' ELSE 'metadata' END AS category FROM ({PARAMS}) p) q GROUP BY category")
def io4(t):
    return io.categorise_params(io.parse_params(t("params"))).groupBy("category").agg(F.count("*").alias("n"))


GRIDS = "SELECT 'pu_f' AS feature_class_name, CAST(1 AS BIGINT) AS unique_id UNION ALL SELECT 'pu_o', CAST(2 AS BIGINT)"


@query("io5_project_updates", "SELECT o_orderkey AS project_id, o_orderkey % 2 = 0 AS is_private, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END::BIGINT AS planning_unit_id FROM orders")
def io5(t):
    return io.project_updates_from_params(io.parse_params(t("params")), t.spark.sql(GRIDS)).select("project_id", "is_private", "planning_unit_id")


@query("io6_write_and_append", "SELECT id, cost FROM units UNION ALL SELECT id + 1000000, cost FROM units WHERE status = 1")
def io6(t):
    path = scratch(t, "units")
    units = t("units").select("id", "cost")
    io.write_table(units, path)
    io.append_table(t("units").where("status = 1").select((F.col("id") + 1000000).alias("id"), "cost"), path)
    return io.read_table(t.spark, path, "id long, cost double")


@query("io7_delete_records", "SELECT id, cost FROM units WHERE id NOT IN (SELECT pu FROM puvspr WHERE species = 1)")
def io7(t):
    return io.delete_records(t("units").select("id", "cost"), "id", t("puvspr").where("species = 1").select(F.col("pu").alias("id")))


@query("io8_ascii_grid", "SELECT layer, r, c, v FROM raster")
def io8(t):
    path = scratch(t, "grids")
    geometry_io.write_ascii_grids(t("raster"), path, 40, t.columns("raster"))
    return io.read_ascii_grid(t.spark, path, "*.txt")


@query("io9_wkt_round_trip", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM boxes")
def io9(t):
    boxes = t.sql("SELECT feature_id, concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') AS wkt FROM boxes")
    there = geometry_io.from_wkt(boxes, "wkt", "geometry")
    back = geometry_io.from_wkt(geometry_io.to_wkt(there, "geometry", "text").drop("geometry"), "text", "geometry")
    return back.select("feature_id", crs.planar_area(F.col("geometry")).alias("area"))


@query("io9_geojson", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM boxes")
def io9b(t):
    path = scratch(t, "geojson")
    b = t("boxes")
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(point(b.x0, b.y0), point(b.x1, b.y0), point(b.x1, b.y1), point(b.x0, b.y1), point(b.x0, b.y0))
    shape = F.struct(F.struct(b.feature_id.cast("string").alias("id")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    layers = b.select((b.feature_id % 50).alias("part"), F.floor(b.feature_id / 5000).alias("chunk"), shape.alias("f")).groupBy("part", "chunk").agg(F.collect_list("f").alias("features"))
    layers.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return geometry_io.read_geojson(t.spark, path).select(F.col("properties.id").cast("long").alias("feature_id"), crs.planar_area(F.col("geometry")).alias("area"))


@query("io9_wkb_round_trip", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) - 0.25 AS DOUBLE) AS area, 2 AS rings FROM boxes")
def io9c(t):
    """Boxes with a hole as WKB and back."""
    b = t("boxes")
    holed = F.concat(crs.box_geometry(b.x0, b.y0, b.x1, b.y1), crs.box_geometry(b.x0 + 0.25, b.y0 + 0.25, b.x0 + 0.75, b.y0 + 0.75))
    raw = geometry_io.to_wkb(b.select("feature_id", holed.alias("geometry")), "geometry", "wkb").drop("geometry")
    return geometry_io.from_wkb(raw, "wkb", "geometry").select("feature_id", crs.planar_area(F.col("geometry")).alias("area"), F.size("geometry").alias("rings"))


@query("io9_geojson_lines", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM boxes")
def io9d(t):
    """A feature a line, every second one after a record separator."""
    path = scratch(t, "geojsonl")
    b = t("boxes")
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ring = F.array(point(b.x0, b.y0), point(b.x1, b.y0), point(b.x1, b.y1), point(b.x0, b.y1), point(b.x0, b.y0))
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(b.feature_id.cast("string").alias("id")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    b.select(F.concat(F.when(b.feature_id % 2 == 0, "\x1e").otherwise(""), F.to_json(shape)).alias("value")).write.text(path)
    return geometry_io.read_geojson_lines(t.spark, path).select(F.col("properties.id").cast("long").alias("feature_id"), crs.planar_area(F.col("geometry")).alias("area"))


@query("io11_load_pad", "SELECT pos, activity, pressure, CASE WHEN rpptitle = 'low' THEN 0.3 ELSE 1.0 END::DOUBLE AS rppscore FROM pad")
def io11(t):
    return io.load_pad(t("pad").toDF("POS", "Activity", "Category", "Pressure", "RPPTitle")).select("pos", "activity", "pressure", "rppscore")


@query("io12_prune_and_replace", "SELECT site_id, iucn_cat FROM sites")
def io12(t):
    path = scratch(t, "wdpa")
    io.replace_table(io.prune_columns(t("sites").select("site_id", "iucn_cat", F.lit("x").alias("desig"), F.lit(1).alias("gis_area"))), path)
    return t.spark.read.parquet(path)
