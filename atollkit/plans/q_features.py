"""Queries of features and protected areas."""

from pyspark.sql import functions as F

from atollkit.functions import crs
from atollkit.operators import features as f
from atollkit.operators import protected as pa
from atollkit.plans.domain import query
from atollkit.plans.q_results import STATS, TARGETS

UNIT = "p_partkey % 50", "CAST(floor(p_partkey / 50) AS BIGINT)"


def boxes(t, name="geometry", view="boxes"):
    """Boxes as rectangles; the view "places" has them between 75 south and 80 north, whatever the scale."""
    b = t(view)
    return b.select("feature_id", crs.box_geometry(b.x0, b.y0, b.x1, b.y1).alias(name))


def unit_squares(t):
    u = t("units")
    return u.select("id", "status", "cost", crs.box_geometry(u.ix, u.iy, u.ix + 1, u.iy + 1).alias("geometry"))


def sites(t, name="other"):
    s = t("sites")
    return s.select("site_id", "iucn_cat", crs.box_geometry(s.x0, s.y0, s.x1, s.y1).alias(name))


@query("fe1_split_layer", "SELECT concat('f_', substr(md5(p_type), 1, 30)) AS feature_class_name, p_type AS alias, COUNT(*) AS n FROM part WHERE p_size % 10 != 0 GROUP BY p_type")
def fe1(t):
    layer = t("part").withColumn("kind", F.when(F.col("p_size") % 10 != 0, F.col("p_type")))
    return f.split_layer(layer, "kind").groupBy("feature_class_name", "alias").agg(F.count("*").alias("n"))


GRID = "SELECT unnest(range(0, 60)) AS gx"
DISSOLVED = "SELECT k, CAST(COUNT(DISTINCT cx * 1000000 + cy) AS DOUBLE) AS area FROM (SELECT feature_id % 7 AS k, unnest(range(x0, x1)) AS cx, y0, y1 FROM boxes) a, LATERAL (SELECT unnest(range(a.y0, a.y1)) AS cy) b GROUP BY k"


@query("fe2_register_polygons", f"SELECT concat('f', d.k) AS alias, d.area AS _area, CAST(MIN(b.x0) AS DOUBLE) AS x0, CAST(MAX(b.y1) AS DOUBLE) AS y1 FROM ({DISSOLVED}) d JOIN boxes b ON b.feature_id % 7 = d.k WHERE d.k != 3 GROUP BY d.k, d.area")
def fe2(t):
    layer = boxes(t).select(F.concat(F.lit("f"), F.col("feature_id") % 7).alias("alias"), "geometry").withColumn("feature_class_name", F.col("alias"))
    there = t.spark.createDataFrame([("old", "f3", 0.0, 0.0, 0.0, 0.0, 0.0, "x")], "feature_class_name string, alias string, _area double, x0 double, y0 double, x1 double, y1 double, source string")
    return f.register_polygon_features(layer, there).where("feature_class_name != 'old'").select("alias", F.round("_area", 6).alias("_area"), "x0", "y1")


@query("fe3_register_points", "SELECT concat('f_', l_suppkey) AS feature_class_name, SUM(l_quantity) AS _area, MIN(l_partkey % 50) AS x0, MAX(floor(l_partkey / 50)) AS y1 FROM lineitem GROUP BY l_suppkey")
def fe3(t):
    points = t("lineitem").select(F.concat(F.lit("f_"), "l_suppkey").alias("feature_class_name"), (F.col("l_partkey") % 50).alias("x"), F.floor(F.col("l_partkey") / 50).cast("double").alias("y"), F.col("l_quantity").alias("value"))
    return f.register_point_features(points).select("feature_class_name", "_area", "x0", "y1")


@query("fe4_import_by_code", f"SELECT concat('MB', k) AS code, area, CASE WHEN k = 2 THEN 'failed' ELSE 'success' END AS status FROM ({DISSOLVED}) d")
def fe4(t):
    layer = boxes(t).select(F.concat(F.lit("MB"), F.col("feature_id") % 7).alias("code"), "geometry", F.lit("x").alias("a"))
    rejects = layer.where("code = 'MB2'").select("code", F.lit("Self-intersection").alias("reason"))
    return f.import_by_code(layer, rejects, "code", ["a"]).select("code", "area", "status")


@query("fe5_eunis_code_index", "SELECT split_part(split_part(raw, ' ', 1), ':', 1) AS code, MAX(id) AS id FROM (SELECT raw, ROW_NUMBER() OVER (ORDER BY pos) - 1 AS id FROM (SELECT concat('MB', p_size, ': ', p_type) AS raw, MIN(p_partkey) AS pos FROM part GROUP BY 1) x) y GROUP BY 1")
def fe5(t):
    layer = t("part").select(F.concat(F.lit("MB"), "p_size", F.lit(": "), "p_type").alias("raw"), "p_partkey")
    return f.eunis_code_index(layer, "raw", "p_partkey")


OVERLAP = "greatest(0, least(b.x1, u.ix + 1) - greatest(b.x0, u.ix)) * greatest(0, least(b.y1, u.iy + 1) - greatest(b.y0, u.iy))"


@query("fe6_polygon_amounts", f"SELECT b.feature_id, u.id, CAST({OVERLAP} AS DOUBLE) AS amount FROM boxes b JOIN units u ON {OVERLAP} > 0")
def fe6(t):
    return f.polygon_amounts(boxes(t, "other"), unit_squares(t))


#: Rows of the lattice that make a degree: 100, or more where the tables would else reach beyond 80 degrees north.
ROWS = "(SELECT greatest(100, CAST(ceil(MAX(y) / 80.0) AS BIGINT)) AS d FROM (SELECT MAX(iy) + 1 AS y FROM units UNION ALL SELECT MAX(y1) AS y FROM boxes) m)"


@query("fe6_amounts_metric", f"SELECT u.status AS project_id, b.feature_id, u.id, round(radians(least(b.x1, u.ix + 1) - greatest(b.x0, u.ix)) * 6371228.0 * 6371228.0 * (sin(radians(least(b.y1, u.iy + 1) * 1.0 / d)) - sin(radians(greatest(b.y0, u.iy) * 1.0 / d))) / 1e6, 2) AS km2 FROM boxes b JOIN units u ON {OVERLAP} > 0 CROSS JOIN {ROWS} z")
def fe6c(t):
    d, u, b = t.sql(f"SELECT d FROM {ROWS} z").first()[0], t("units"), t("boxes")
    units = u.select("id", F.col("status").alias("project_id"), crs.box_geometry(u.ix, u.iy / d, u.ix + 1, (u.iy + 1) / d).alias("geometry"))
    features = b.select("feature_id", crs.box_geometry(b.x0, b.y0 / d, b.x1, b.y1 / d).alias("other"))
    out = f.polygon_amounts(features, units, project="project_id", metric=True)
    return out.select("project_id", "feature_id", "id", F.round(F.col("amount") / 1e6, 2).alias("km2"))


def notched_sites(t, name="geometry"):
    """Sites without their upper right part beyond one unit: concave."""
    s = t("sites")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(p(s.x0, s.y0), p(s.x1, s.y0), p(s.x1, s.y0 + 1), p(s.x0 + 1, s.y0 + 1), p(s.x0 + 1, s.y1), p(s.x0, s.y1), p(s.x0, s.y0))
    return s.select("site_id", "iucn_cat", F.array(ring).alias(name))


def shared(x0, y0, x1, y1):
    return f"greatest(0, least(b.x1, {x1}) - greatest(b.x0, {x0})) * greatest(0, least(b.y1, {y1}) - greatest(b.y0, {y0}))"


NOTCHED = f"({shared('s.x0', 's.y0', 's.x1', 's.y1')} - {shared('s.x0 + 1', 's.y0 + 1', 's.x1', 's.y1')})"


@query("fe6_amounts_notched", f"SELECT b.feature_id, s.site_id AS id, CAST({NOTCHED} AS DOUBLE) AS amount FROM boxes b JOIN sites s ON {NOTCHED} > 0")
def fe6d(t):
    out = f.polygon_amounts(boxes(t, "other"), notched_sites(t).withColumnRenamed("site_id", "id"))
    return out.withColumn("amount", F.round("amount", 6))


#: Area of a slope from (x0, y1) down to (x1, y0) above a height, between the sides of a unit where it is fa and fb.
ABOVE = lambda u: f"(power(greatest(fa - {u}, 0.0), 2) - power(greatest(fb - {u}, 0.0), 2)) * w / (2.0 * h)"
SLOPES = "SELECT s.site_id AS feature_id, u.id, s.x1 - s.x0 AS w, s.y1 - s.y0 AS h, s.y0 + (s.y1 - s.y0) * (s.x1 - greatest(u.ix, s.x0)) * 1.0 / (s.x1 - s.x0) AS fa, s.y0 + (s.y1 - s.y0) * (s.x1 - least(u.ix + 1, s.x1)) * 1.0 / (s.x1 - s.x0) AS fb, greatest(u.iy, s.y0) AS lo, u.iy + 1 AS hi FROM sites s JOIN units u ON u.ix < s.x1 AND u.ix + 1 > s.x0 AND u.iy < s.y1 AND u.iy + 1 > s.y0"


@query("fe6_amounts_slanted", f"SELECT feature_id, id, round(amount, 6) AS amount FROM (SELECT feature_id, id, {ABOVE('lo')} - {ABOVE('hi')} AS amount FROM ({SLOPES}) x) y WHERE amount > 1e-9")
def fe6e(t):
    """Right triangles over the sites' lower left corners."""
    s = t("sites")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    slopes = F.array(F.array(p(s.x0, s.y0), p(s.x1, s.y0), p(s.x0, s.y1), p(s.x0, s.y0)))
    out = f.polygon_amounts(s.select(F.col("site_id").alias("feature_id"), slopes.alias("other")), unit_squares(t))
    return out.where("amount > 1e-9").withColumn("amount", F.round("amount", 6))


@query("fe6_point_amounts", "SELECT l_suppkey AS feature_id, l_partkey AS id, SUM(l_quantity) AS amount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey")
def fe6b(t):
    points = t("lineitem").select(F.col("l_suppkey").alias("feature_id"), (F.col("l_partkey") % 50 + 0.5).alias("x"), (F.floor(F.col("l_partkey") / 50) + 0.5).alias("y"), F.col("l_quantity").alias("value"))
    return f.point_amounts(points, unit_squares(t))


@query("fe7_feature_stats", STATS)
def fe7(t):
    return f.feature_stats(t("puvspr"))


@query("fe8_feature_targets", f"SELECT id, round(target, 4) AS target FROM ({TARGETS}) x")
def fe8(t):
    return f.feature_targets(t("spec"), f.feature_stats(t("puvspr"))).withColumn("target", F.round("target", 4))


@query("fe9_units_of_feature", "SELECT DISTINCT l_partkey AS pu FROM lineitem WHERE l_suppkey = 5")
def fe9(t):
    return f.units_of_feature(t("puvspr"), 5)


@query("fe10_projects_of_feature", "SELECT DISTINCT project_id FROM spec WHERE id = 5")
def fe10(t):
    return f.projects_of_feature(t("spec"), 5)


@query("fe11_feature_catalogue", "SELECT unique_id AS id, feature_class_name AS name, alias, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * unique_id, '%d/%m/%y %H:%M:%S') AS creation_date, created_by FROM features")
def fe11(t):
    return f.feature_catalogue(t("features").withColumn("creation_date", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(unique_id AS INT))")))


@query("fe12_features_in_project", "SELECT p.project_id, p.feature_unique_id, p.target_value, m.alias FROM project_features p LEFT JOIN features m ON m.unique_id = p.feature_unique_id AND m.unique_id % 4 != 0")
def fe12(t):
    return f.features_in_project(t("project_features"), t("features").where("unique_id % 4 != 0")).select("project_id", "feature_unique_id", "target_value", "alias")


@query("fe13_upsert_features", "SELECT project_id, feature_unique_id, target_value, spf FROM project_features WHERE feature_unique_id > 2 OR feature_unique_id = 0 UNION ALL SELECT CAST(n_nationkey AS BIGINT), k, k / 4.0::DOUBLE, 7.0::DOUBLE FROM nation CROSS JOIN (SELECT CAST(1 AS BIGINT) AS k UNION ALL SELECT 2) x UNION ALL SELECT project_id, feature_unique_id, target_value, spf FROM project_features WHERE feature_unique_id IN (1, 2) AND project_id NOT IN (SELECT n_nationkey FROM nation)")
def fe13(t):
    requests = t("nation").select(F.col("n_nationkey").cast("long").alias("project_id"), F.lit("1, ,2").alias("ids"), F.lit("0.25,,0.5").alias("targets"), F.lit("7,,7").alias("spfs"))
    return f.upsert_project_features(t("project_features"), requests)


@query("fe14_first_habitat", "SELECT p_brand AS code, MIN(p_name) AS habitat FROM part WHERE p_brand != 'Brand#1' GROUP BY p_brand")
def fe14(t):
    return f.distinct_on_sensitivities(t("part").select(F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("code"), F.col("p_name").alias("habitat")))


@query("fe15_countries", "SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE concat('I', n_nationkey) END AS iso3, n_nationkey % 2 = 0 AS has_marine FROM nation WHERE n_nationkey % 5 != 0 AND n_nationkey % 6 != 0")
def fe15(t):
    gaul = t("nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "A|B").otherwise(F.when(F.col("n_nationkey") % 6 != 0, F.concat(F.lit("I"), "n_nationkey"))).alias("iso3"))
    eez = t("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("I"), "n_nationkey").alias("iso3"))
    return f.countries(gaul, eez)


@query("fe16_prune_unused", "SELECT unique_id, alias FROM features WHERE created_by = 'global admin' OR unique_id IN (SELECT species FROM puvspr GROUP BY species HAVING COUNT(*) % 2 = 0)")
def fe16(t):
    used = t("puvspr").groupBy("species").agg(F.count("*").alias("units")).where("units % 2 = 0")  # an even number of units: a use
    return f.prune_unused(t("features"), used.select("species")).select("unique_id", "alias")


@query("fe16_prune_unused_all", "SELECT unique_id, alias FROM features WHERE created_by = 'global admin' OR unique_id IN (SELECT species FROM puvspr)")
def fe16_all(t):
    return f.prune_unused(t("features"), t("puvspr").select("species")).select("unique_id", "alias")


MEET = "s.x0 <= u.ix + 1 AND s.x1 >= u.ix AND s.y0 <= u.iy + 1 AND s.y1 >= u.iy"


@query("pa1_protected_intersections", f"SELECT DISTINCT s.iucn_cat, u.id AS puid FROM sites s JOIN units u ON {MEET}")
def pa1(t):
    return pa.protected_intersections(sites(t), unit_squares(t))


@query("pa2_protected_by_category", f"SELECT iucn_cat, COUNT(*) AS n, MIN(puid) AS first FROM (SELECT DISTINCT s.iucn_cat, u.id AS puid FROM sites s JOIN units u ON {MEET}) x GROUP BY iucn_cat")
def pa2(t):
    rows = pa.protected_by_category(pa.protected_intersections(sites(t), unit_squares(t)), nested=False)
    return rows.groupBy("iucn_cat").agg(F.count("*").alias("n"), F.min("puid").alias("first"))


#: The next release: some sites moved, some gone, some of another category, some new.
RELEASE = "SELECT site_id, CASE WHEN site_id % 13 = 2 THEN 'NEW' ELSE iucn_cat END AS iucn_cat, x0 + CASE WHEN site_id % 10 = 3 THEN 1 ELSE 0 END AS x0, y0, x1 + CASE WHEN site_id % 10 = 3 THEN 1 ELSE 0 END AS x1, y1 FROM sites WHERE site_id % 10 != 1 UNION ALL SELECT site_id + 1000000000, iucn_cat, x0 + 2, y0, x1 + 2, y1 FROM sites WHERE site_id % 17 = 0"


@query("io12_redo_intersections", f"SELECT DISTINCT u.status AS grid_id, s.iucn_cat, u.id AS puid FROM ({RELEASE}) s JOIN units u ON {MEET}")
def io12b(t):
    """The intersections of a new release, from those of the old one."""
    s = t.sql(RELEASE)
    new = s.select("site_id", "iucn_cat", crs.box_geometry(s.x0, s.y0, s.x1, s.y1).alias("other"))
    units = unit_squares(t).select(F.col("status").alias("grid_id"), "id", "geometry")
    return pa.redone_intersections(pa.protected_for_all(sites(t), units), sites(t), new, units)


@query("pa3_protected_for_all", f"SELECT DISTINCT u.status AS grid_id, s.iucn_cat, u.id AS puid FROM sites s JOIN units u ON {MEET}")
def pa3(t):
    return pa.protected_for_all(sites(t), unit_squares(t).withColumn("grid_id", F.col("status")))
