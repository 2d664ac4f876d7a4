"""Queries of rasters and cumulative impact."""

from pyspark.sql import functions as F

from atollkit.operators import raster as ra
from atollkit.plans.domain import query
from atollkit.plans.q_features import boxes, unit_squares
from atollkit.sources.io import load_pad

ROWS = 40


def grid(t):
    """Cells of size 1, as many columns as the data has."""
    return (0.0, float(ROWS), 1.0, 1.0, ROWS, t.columns("raster"))


def coarse(t):
    return (0.0, float(ROWS), 2.0, 2.0, ROWS // 2, -(-t.columns("raster") // 2))


def pad(t):
    return load_pad(t("pad"))


@query("ra1_clamp_negative", "SELECT layer, r, c, greatest(v - 5, 0.0) AS v FROM raster")
def ra1(t):
    return ra.clamp_negative(t("raster").withColumn("v", F.col("v") - 5))


@query("ra2_log_minmax", "SELECT layer, r, c, round(COALESCE((ln(v + 1) - least_) / NULLIF(most - least_, 0), 0.0), 8) AS v FROM (SELECT *, MIN(ln(v + 1)) OVER (PARTITION BY layer) AS least_, MAX(ln(v + 1)) OVER (PARTITION BY layer) AS most FROM raster) x")
def ra2(t):
    return ra.log_minmax(t("raster"), ["layer"]).withColumn("v", F.round("v", 8))


RESAMPLED = """SELECT layer, tr AS r, tc AS c, round(SUM(w * v) / SUM(w), 6) AS v FROM (
SELECT x.layer, t.tr, t.tc, x.v, (1 - abs(x.c - (t.tc * 2 + 0.5))) * (1 - abs(x.r - (t.tr * 2 + 0.5))) AS w FROM raster x
JOIN (SELECT CAST(a AS INT) AS tr, CAST(b AS INT) AS tc FROM (SELECT unnest(range(0, 20)) AS a) p CROSS JOIN (SELECT unnest(range(0, CAST(ceil((SELECT MAX(c) + 1 FROM raster) / 2.0) AS BIGINT))) AS b) q) t
ON abs(x.c - (t.tc * 2 + 0.5)) < 1 AND abs(x.r - (t.tr * 2 + 0.5)) < 1) z GROUP BY layer, tr, tc"""


@query("ra3_resample", RESAMPLED)
def ra3(t):
    return ra.resample(t("raster"), grid(t), coarse(t)).withColumn("v", F.round("v", 6))


#: A raster in degrees on a metric grid of EPSG:3410; M is the width of a cell.
M = 120000.0
LON, LAT = f"degrees((t.tc + 0.5) * {M} / (6371228.0 * cos(radians(30.0))))", f"degrees(asin((20 - t.tr - 0.5) * {M} * cos(radians(30.0)) / 6371228.0))"
PROJECTED = f"""SELECT layer, tr AS r, tc AS c, round(SUM(w * v) / SUM(w), 6) AS v FROM (
SELECT x.layer, t.tr, t.tc, x.v, (1 - abs(x.c - ({LON} - 0.5))) * (1 - abs(x.r - (20 - {LAT} - 0.5))) AS w FROM raster x
JOIN (SELECT CAST(a AS INT) AS tr, CAST(b AS INT) AS tc FROM (SELECT unnest(range(0, 40)) AS a) p CROSS JOIN (SELECT unnest(range(0, 30)) AS b) q) t
ON abs(x.c - ({LON} - 0.5)) < 1 AND abs(x.r - (20 - {LAT} - 0.5)) < 1) z GROUP BY layer, tr, tc"""


@query("ra3_resample_projected", PROJECTED)
def ra3b(t):
    degrees = (0.0, 20.0, 1.0, 1.0, ROWS, t.columns("raster"))
    return ra.resample(t("raster"), degrees, (0.0, 20 * M, M, M, 40, 30), "EPSG:4326", "EPSG:3410").withColumn("v", F.round("v", 6))


#: The same raster on the grid that suits it best: its width, height and the size of a cell in closed form.
FIT = "(SELECT w, h, sqrt(w * w + h * h) / sqrt(n * n + 1600.0) AS size FROM (SELECT n, radians(n * 1.0) * 6371228.0 * cos(radians(30.0)) AS w, 2 * sin(radians(20.0)) * 6371228.0 / cos(radians(30.0)) AS h FROM (SELECT MAX(c) + 1 AS n FROM raster) a) b)"
FIT_LON, FIT_LAT = "degrees((t.tc + 0.5) * t.size / (6371228.0 * cos(radians(30.0))))", "degrees(asin((t.h / 2 - (t.tr + 0.5) * t.size) * cos(radians(30.0)) / 6371228.0))"
FITTED = f"""SELECT layer, tr AS r, tc AS c, round(SUM(w * v) / SUM(w), 6) AS v FROM (
SELECT x.layer, t.tr, t.tc, x.v, (1 - abs(x.c - ({FIT_LON} - 0.5))) * (1 - abs(x.r - (20 - {FIT_LAT} - 0.5))) AS w FROM raster x
JOIN (SELECT z.h, z.size, CAST(a AS INT) AS tr, CAST(b AS INT) AS tc FROM {FIT} z, LATERAL (SELECT unnest(range(0, CAST(ceil(z.h / z.size - 1e-9) AS BIGINT))) AS a) p, LATERAL (SELECT unnest(range(0, CAST(ceil(z.w / z.size - 1e-9) AS BIGINT))) AS b) q) t
ON abs(x.c - ({FIT_LON} - 0.5)) < 1 AND abs(x.r - (20 - {FIT_LAT} - 0.5)) < 1) y GROUP BY layer, tr, tc HAVING SUM(w) > 1e-9"""


@query("ra3_reproject_best_fit", FITTED)
def ra3c(t):
    degrees = (0.0, 20.0, 1.0, 1.0, ROWS, max(1, t.columns("raster")))
    return ra.reproject(t("raster"), degrees, "EPSG:4326", "EPSG:3410")[0].withColumn("v", F.round("v", 6))


@query("ra4_prepare_upload", RESAMPLED.replace("FROM raster x", "FROM (SELECT layer, r, c, COALESCE((ln(v + 1) - least_) / NULLIF(most - least_, 0), 0.0) AS v FROM (SELECT *, MIN(ln(v + 1)) OVER (PARTITION BY layer) AS least_, MAX(ln(v + 1)) OVER (PARTITION BY layer) AS most FROM raster) y) x"))
def ra4(t):
    return ra.prepare_upload(t("raster"), grid(t), coarse(t)).withColumn("v", F.round("v", 6))


@query("ra5_pressures", "SELECT s.name AS layer, x.r, x.c, round(x.v * s.w, 6) AS v FROM raster x CROSS JOIN (SELECT DISTINCT replace(pressure, '_', '') AS name, CASE WHEN rpptitle = 'low' THEN 0.3 ELSE 1.0 END AS w FROM pad WHERE activity = 'ECONOMY') s WHERE x.layer = 'eco_1' AND x.v != 0")
def ra5(t):
    return ra.pressures(t("raster").where("layer = 'eco_1'"), pad(t), "ECONOMY").withColumn("v", F.round("v", 6))


@query("ra5_pressures_by_layer", "SELECT x.layer AS source, s.name AS layer, x.r, x.c, round(x.v * s.w, 6) AS v FROM raster x CROSS JOIN (SELECT DISTINCT replace(pressure, '_', '') AS name, CASE WHEN rpptitle = 'low' THEN 0.3 ELSE 1.0 END AS w FROM pad WHERE activity = 'ECONOMY') s WHERE x.v != 0")
def ra5b(t):
    return ra.pressures_by_layer(t("raster"), pad(t), "ECONOMY").withColumn("v", F.round("v", 6))


LEVEL = "CASE p_size % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END"
SCORE = "CAST(p_size % 4 AS INT)"
MARESA = f"SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('A', p_partkey) END AS code, p_brand AS pressure, {LEVEL} AS level FROM part"
JNCC = f"SELECT concat('B', p_partkey % 50) AS code, CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'local x' ELSE p_type END AS pressure, {LEVEL} AS level, p_partkey AS pos FROM part"
SENS = f"""SELECT code, replace(lower(pressure), '#', '') AS pressure, score FROM (
SELECT code, pressure, CASE level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 0 END AS score FROM (
SELECT code, pressure, level FROM ({MARESA}) m WHERE code IS NOT NULL
UNION ALL SELECT code, pressure, level FROM (SELECT code, pressure, level, ROW_NUMBER() OVER (PARTITION BY code, pressure ORDER BY pos) AS n FROM ({JNCC}) j WHERE pressure IS NOT NULL AND pressure NOT LIKE '%local%') q WHERE n = 1) z) s"""


def sens(t):
    return ra.checked(ra.sensitivity_long(t.sql(MARESA), t.sql(JNCC)))


@query("ra6_sensitivity_long", SENS)
def ra6(t):
    return sens(t)


@query("ra6_sensitivity_matrix", f"SELECT code, MAX(CASE WHEN pressure = 'brand1' THEN score ELSE 0 END) AS brand1, MAX(CASE WHEN pressure = 'economy' THEN score ELSE 0 END) AS economy FROM ({SENS}) x GROUP BY code")
def ra6b(t):
    return ra.sensitivity_matrix(sens(t), ["brand1", "economy"])


@query("ra7_extend_with_default", f"SELECT code, pressure, score FROM ({SENS}) x WHERE code NOT IN ('coral_1', 'B2') UNION ALL SELECT l, pressure, score FROM ({SENS}) x CROSS JOIN (SELECT 'coral_1' AS l UNION ALL SELECT 'B2') y WHERE code = 'B1'")
def ra7(t):
    labels = t.spark.sql("SELECT 'coral_1' AS label UNION ALL SELECT 'B2'")
    return ra.extend_with_default(sens(t), labels, like="B1")


IMPACT = "SELECT e.r, e.c, SUM(round_even(e.v / 7, 4) * round_even(s.v / 3, 4) * m.score) AS v FROM raster e JOIN sens m ON m.eco = e.layer JOIN stressors s ON s.layer = m.pressure AND s.r = e.r AND s.c = e.c WHERE m.score != 0 AND round_even(e.v / 7, 4) != 0 AND round_even(s.v / 3, 4) != 0 GROUP BY e.r, e.c"


def layers(t):
    return t("raster").withColumn("v", F.col("v") / 7), t("stressors").withColumn("v", F.col("v") / 3), t("sens")


@query("ra8_impact_sums", f"SELECT r, c, round(v, 5) AS v FROM ({IMPACT}) x")
def ra8(t):
    return ra.impact_sums(*layers(t)).withColumn("v", F.round("v", 5))


@query("ra8_cumulative_impact", f"SELECT r, c, round((ln(v + 1) - MIN(ln(v + 1)) OVER ()) / (MAX(ln(v + 1)) OVER () - MIN(ln(v + 1)) OVER ()), 6) AS v FROM ({IMPACT}) x")
def ra8b(t):
    return ra.cumulative_impact(*layers(t)).withColumn("v", F.round("v", 6))


@query("ra9_mask_by_polygon", "SELECT DISTINCT x.layer, x.r, x.c, x.v FROM raster x JOIN boxes b ON x.c + 0.5 >= b.x0 AND x.c + 0.5 < b.x1 AND 39.5 - x.r >= b.y0 AND 39.5 - x.r < b.y1")
def ra9(t):
    return ra.mask_by_polygon(t("raster"), boxes(t), grid(t))


@query("ra10_cost_from_impact", "SELECT u.id, CASE WHEN u.ix < (SELECT MAX(c) + 1 FROM raster) AND u.iy < 40 THEN 100 + 100 * COALESCE(greatest(x.v, 0), 0.0) ELSE 0.0 END AS cost FROM units u LEFT JOIN (SELECT * FROM raster WHERE layer = 'eco_2') x ON x.c = u.ix AND x.r = 39 - u.iy")
def ra10(t):
    return ra.cost_from_impact(t("raster").where("layer = 'eco_2'"), unit_squares(t), grid(t))


@query("ra10_costs_by_layer", "SELECT l.layer, u.id, CASE WHEN u.ix < (SELECT MAX(c) + 1 FROM raster) AND u.iy < 40 THEN 100 + 100 * COALESCE(greatest(x.v, 0), 0.0) ELSE 0.0 END AS cost FROM units u CROSS JOIN (SELECT DISTINCT layer FROM raster) l LEFT JOIN raster x ON x.layer = l.layer AND x.c = u.ix AND x.r = 39 - u.iy")
def ra10b(t):
    return ra.costs_from_impacts(t("raster"), unit_squares(t), grid(t))


@query("ra11_raster_extent", "SELECT layer, CAST(MIN(c) AS DOUBLE) AS xmin, CAST(39 - MAX(r) AS DOUBLE) AS ymin, CAST(MAX(c) + 1 AS DOUBLE) AS xmax, CAST(40 - MIN(r) AS DOUBLE) AS ymax FROM raster GROUP BY layer")
def ra11(t):
    return ra.raster_extent(t("raster"), grid(t))


@query("ra12_activities", "SELECT activity, category, CAST(concat('0x', substr(sha1(activity), 1, 6)) AS BIGINT) AS id FROM (SELECT activity, category, ROW_NUMBER() OVER (PARTITION BY activity ORDER BY pos) AS n FROM pad) x WHERE n = 1")
def ra12(t):
    return ra.activities(pad(t))


@query("ra13_catalogue", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y %H:%M:%S') AS creation_date FROM orders")
def ra13(t):
    return ra.catalogue(t("orders").select("o_orderkey", F.col("o_orderdate").alias("creation_date"), "o_orderpriority"), "o_orderpriority").select("o_orderkey", "creation_date")
