"""Queries of coordinates and spatial joins."""

from pyspark.sql import functions as F

from atollkit.functions import crs
from atollkit.operators import features as f
from atollkit.operators import spatial as s
from atollkit.plans.domain import query
from atollkit.plans.q_features import DISSOLVED, MEET, boxes, notched_sites, sites, unit_squares

R, K = 6371228.0, "cos(radians(30.0))"


@query("cr1_ease_area", f"SELECT feature_id, round(radians(x1 - x0) * {R} * {R} * (sin(radians(y1 * 1.0)) - sin(radians(y0 * 1.0))) / 1e6, 1) AS km2 FROM places")
def cr1(t):
    return boxes(t, view="places").select("feature_id", F.round(crs.planar_area(crs.to_ease_grid(F.col("geometry"))) / 1e6, 1).alias("km2"))


E = "0.0818191908426215"
Q = f"((1 - {E} * {E}) * (sin(radians(y)) / (1 - {E} * {E} * sin(radians(y)) * sin(radians(y))) - ln((1 - {E} * sin(radians(y))) / (1 + {E} * sin(radians(y)))) / (2 * {E})))"


@query("cr2_ease2_area", f"SELECT feature_id, round(radians(x1 - x0) * 6378137.0 * 6378137.0 / 2 * (({Q.replace('(y)', '(y1 * 1.0)')}) - ({Q.replace('(y)', '(y0 * 1.0)')})) / 1e6, 0) AS km2 FROM places")
def cr2(t):
    return boxes(t, view="places").select("feature_id", F.round(crs.planar_area(crs.to_ease2(F.col("geometry"))) / 1e6, 0).alias("km2"))


@query("cr3_albers_round_trip", "SELECT feature_id, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y FROM places")
def cr3(t):
    flat = boxes(t, view="places").select("feature_id", crs.to_albers(F.col("geometry"))[0][0].alias("p"))
    there = flat.select("feature_id", crs.albers_inverse("p.x", "p.y").alias("q"))
    return there.select("feature_id", (F.round("q.x", 6) + 0.0).alias("x"), (F.round("q.y", 6) + 0.0).alias("y"))


@query("cr4_split_at_dateline", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM places")
def cr4(t):
    b = t("places")
    turn = lambda x: F.when(x + 160 > 180, x - 200).otherwise(x + 160)
    wrapped = b.select("feature_id", crs.box_geometry(turn(b.x0), b.y0, turn(b.x1), b.y1).alias("geometry"))
    parts = f.split_at_dateline(wrapped)
    return parts.groupBy("feature_id").agg(F.round(F.sum(crs.planar_area(F.col("geometry"))), 6).alias("area"))


@query("cr5_polygon_from_points", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM boxes WHERE feature_id % 3 != 0")
def cr5(t):
    points = boxes(t).select("feature_id", F.posexplode(F.col("geometry")[0]).alias("seq", "p")).select("feature_id", "seq", "p.x", "p.y")
    drawn = points.where("feature_id % 3 != 0 OR seq < 4")
    return crs.polygon_from_points(drawn, "feature_id").select("feature_id", crs.planar_area(F.col("geometry")).alias("area"))


@query("cr6_envelopes", "SELECT feature_id % 7 AS k, CAST(MIN(x0) AS DOUBLE) AS x0, CAST(MIN(y0) AS DOUBLE) AS y0, CAST(MAX(x1) AS DOUBLE) AS x1, CAST(MAX(y1) AS DOUBLE) AS y1 FROM boxes GROUP BY 1")
def cr6(t):
    return crs.envelope_agg(boxes(t).withColumn("k", F.col("feature_id") % 7), "geometry", ["k"])


@query("cr7_area_and_perimeter", "SELECT feature_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS perimeter FROM boxes")
def cr7(t):
    return boxes(t).select("feature_id", crs.planar_area(F.col("geometry")).alias("area"), crs.perimeter(F.col("geometry")).alias("perimeter"))


@query("cr8_geom_kind", "SELECT CASE WHEN (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1) LIKE '%Point%' THEN 'Point' ELSE 'Polygon' END AS kind")
def cr8(t):
    return crs.geom_kind(t("part"), "p_name", "p_partkey")


@query("cr9_repair_and_check", "SELECT feature_id, CASE WHEN feature_id % 5 = 0 THEN 'Self-intersection' WHEN feature_id % 5 = 1 THEN 'Too few points in geometry component' END AS reason FROM boxes WHERE feature_id % 5 < 2 UNION ALL SELECT feature_id, 'sound' FROM boxes WHERE feature_id % 5 >= 2")
def cr9(t):
    b = t("boxes")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    bow = F.array(F.array(p(b.x0, b.y0), p(b.x1, b.y1), p(b.x1, b.y0), p(b.x0, b.y1), p(b.x0, b.y0)))
    thin = F.array(F.array(p(b.x0, b.y0), p(b.x1, b.y1)))
    k = b.feature_id % 5
    rows = b.select("feature_id", F.when(k == 0, bow).when(k == 1, thin).otherwise(crs.box_geometry(b.x0, b.y0, b.x1, b.y1)).alias("geometry"))
    good, bad = f.repair_and_check(rows, "feature_id")
    return bad.unionByName(good.select("feature_id", F.lit("sound").alias("reason")))


RINGS = {0: ((2, 2, 4, 4), (5, 5, 6, 6)), 1: ((12, 0, 14, 2),), 2: ((8, 8, 12, 12),), 3: ((2, 2, 8, 8), (3, 3, 5, 5)), 4: ((-1, -1, 11, 11),), 5: ((2, 2, 5, 5), (4, 4, 7, 7)), 6: ((0, 2, 3, 4),), 7: ((2, 2, 4, 4), (4, 4, 6, 6))}
REASONS = {1: "Hole lies outside shell", 2: "Self-intersection", 3: "Holes are nested", 4: "Hole lies outside shell", 5: "Self-intersection", 6: "Self-intersection"}


@query("cr9_nested_rings", "SELECT feature_id, CASE feature_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in REASONS.items()) + " ELSE 'sound' END AS reason, CASE feature_id % 8 WHEN 0 THEN 95.0 WHEN 7 THEN 92.0 END::DOUBLE AS area FROM boxes")
def cr9b(t):
    b = t("boxes")
    at = lambda x0, y0, x1, y1: crs.box_geometry(b.x0 + x0, b.y0 + y0, b.x0 + x1, b.y0 + y1)
    made = F.lit(None)
    for k, holes in RINGS.items():
        made = F.when(b.feature_id % 8 == k, F.concat(at(0, 0, 10, 10), *(at(*h) for h in holes))).otherwise(made)
    good, bad = f.repair_and_check(b.select("feature_id", made.alias("geometry")), "feature_id")
    good = good.select("feature_id", F.lit("sound").alias("reason"), crs.planar_area(F.col("geometry")).alias("area"))
    return bad.withColumn("area", F.lit(None).cast("double")).unionByName(good)


@query("sj1_intersects", f"SELECT s.site_id, u.id FROM sites s JOIN units u ON {MEET}")
def sj1(t):
    return s.spatial_join(unit_squares(t), sites(t), geometries=False).select("site_id", "id")


@query("sj1_contains", "SELECT s.site_id, u.id FROM sites s JOIN units u ON s.x0 <= u.ix AND s.x1 >= u.ix + 1 AND s.y0 <= u.iy AND s.y1 >= u.iy + 1")
def sj1b(t):
    return s.spatial_join(sites(t), unit_squares(t).select("id", "geometry"), "other", "geometry", pred="contains", geometries=False).select("site_id", "id")


WITHIN = "s.x0 <= u.ix AND s.x1 >= u.ix + 1 AND s.y0 <= u.iy AND s.y1 >= u.iy + 1 AND (u.ix + 1 <= s.x0 + 1 OR u.iy + 1 <= s.y0 + 1)"


@query("sj1_contains_notched", f"SELECT s.site_id, u.id FROM sites s JOIN units u ON {WITHIN}")
def sj1d(t):
    return s.spatial_join(notched_sites(t, "other"), unit_squares(t).select("id", "geometry"), "other", "geometry", pred="contains", geometries=False).select("site_id", "id")


@query("sj2_points_in_notched", "SELECT s.site_id, u.id FROM sites s JOIN units u ON u.ix >= s.x0 AND u.ix < s.x1 AND u.iy >= s.y0 AND u.iy < s.y1 AND (u.ix < s.x0 + 1 OR u.iy < s.y0 + 1)")
def sj2b(t):
    points = t("units").select("id", (F.col("ix") + 0.5).alias("x"), (F.col("iy") + 0.5).alias("y"))
    return s.points_in_polygons(points, notched_sites(t), geometries=False).select("site_id", "id")


@query("sj1_touches", f"SELECT s.site_id, u.id FROM sites s JOIN units u ON {MEET} AND NOT (s.x0 < u.ix + 1 AND s.x1 > u.ix AND s.y0 < u.iy + 1 AND s.y1 > u.iy)")
def sj1c(t):
    return s.spatial_join(sites(t), unit_squares(t).select("id", "geometry"), "other", "geometry", pred="touches", geometries=False).select("site_id", "id")


@query("sj2_points_in_polygons", "SELECT s.site_id, u.id FROM sites s JOIN units u ON u.ix >= s.x0 AND u.ix < s.x1 AND u.iy >= s.y0 AND u.iy < s.y1")
def sj2(t):
    points = t("units").select("id", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    return s.points_in_polygons(points, sites(t, "geometry"), geometries=False).select("site_id", "id")


NEIGHBOURS = "SELECT a.id AS id1, b.id AS id2, CASE WHEN a.ix = b.ix OR a.iy = b.iy THEN 1.0 ELSE 0.0 END::DOUBLE AS boundary FROM units a JOIN units b ON a.id < b.id AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1"


@query("sj3_boundary_lengths", NEIGHBOURS)
def sj3(t):
    return s.boundary_lengths(unit_squares(t), scale=1.0)


@query("sj3_boundary_lengths_general", NEIGHBOURS)
def sj3b(t):
    return s.boundary_lengths_general(unit_squares(t), scale=1.0)


@query("sj4_outer_boundary", "SELECT id, CAST(4 - n AS DOUBLE) AS boundary FROM (SELECT a.id, COUNT(b.id) AS n FROM units a LEFT JOIN units b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 GROUP BY a.id) x WHERE n < 4")
def sj4(t):
    return s.outer_boundary(unit_squares(t), scale=1.0)


#: Units of two columns in even rows and of one in odd rows, by the lattice squares that they cover.
OWNERS = "(SELECT ix, iy, id FROM units WHERE iy % 2 = 1 OR ix % 2 = 0 UNION ALL SELECT ix + 1, iy, id FROM units WHERE iy % 2 = 0 AND ix % 2 = 0)"


def uneven_units(t):
    u = t("units").where("iy % 2 = 1 OR ix % 2 = 0")
    return u.select("id", crs.box_geometry(u.ix, u.iy, u.ix + F.when(u.iy % 2 == 0, 2).otherwise(1), u.iy + 1).alias("geometry"))


@query("sj3_boundary_lengths_uneven", f"SELECT a.id AS id1, b.id AS id2, CAST(SUM(CASE WHEN abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS boundary FROM {OWNERS} a JOIN {OWNERS} b ON a.id < b.id AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY a.id, b.id")
def sj3c(t):
    return s.boundary_lengths_general(uneven_units(t), scale=1.0)


@query("sj4_outer_boundary_uneven", f"SELECT id, CAST(SUM(4 - n) AS DOUBLE) AS boundary FROM (SELECT a.ix, a.iy, a.id, COUNT(b.id) AS n FROM {OWNERS} a LEFT JOIN {OWNERS} b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 GROUP BY a.ix, a.iy, a.id) x GROUP BY id HAVING SUM(4 - n) > 0")
def sj4b(t):
    return s.outer_boundary(uneven_units(t), scale=1.0).withColumn("boundary", F.round("boundary", 6))


@query("sj5_union_area", f"SELECT k, area FROM ({DISSOLVED}) d")
def sj5(t):
    return s.union_area(boxes(t).withColumn("k", F.col("feature_id") % 7), ["k"]).withColumn("area", F.round("area", 6))
