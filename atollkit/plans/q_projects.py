"""Queries of projects and planning units."""

from pyspark.sql import functions as F

from atollkit.operators import projects as p
from atollkit.plans.domain import query
from atollkit.sources.io import parse_params

PARAMS = "SELECT project_id, key, value FROM (SELECT o_orderkey AS project_id, 'BLM' AS key, CAST(o_custkey AS STRING) AS value FROM orders UNION ALL SELECT o_orderkey, 'NUMREPS', CAST(o_orderkey % 100 AS STRING) FROM orders UNION ALL SELECT o_orderkey, 'PRIVATE', CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END FROM orders UNION ALL SELECT o_orderkey, 'PLANNING_UNIT_NAME', concat('pu_', lower(o_orderstatus)) FROM orders) x"
EXISTING = "SELECT project_id, h3_index FROM project_units WHERE project_id % 2 = 0"
AREA = "lower(trim(split_part(g.alias, ' (', 1)))"


@query("pu1_populate_units", f"SELECT DISTINCT p.id AS project_id, c.h3_index, c.cost, c.status FROM projects p JOIN grids g ON p.planning_unit_id = g.unique_id JOIN cells c ON lower(trim(c.project_area)) = {AREA} WHERE NOT EXISTS (SELECT 1 FROM ({EXISTING}) e WHERE e.project_id = p.id AND e.h3_index = c.h3_index)")
def pu1(t):
    return p.populate_units(t("projects"), t("grids"), t("cells"), t.sql(EXISTING))


@query("pu2_group_ids", "SELECT status, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM units WHERE status != 0 GROUP BY status")
def pu2(t):
    return p.group_ids(t("units"), "status", "id").select("status", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("pu3_group_by_status", "SELECT COALESCE(status, 0) AS status, COUNT(*) AS n, MIN(h3_index) AS first FROM project_units GROUP BY COALESCE(status, 0)")
def pu3(t):
    return p.group_by_status(t("project_units"), nested=False).groupBy("status").agg(F.count("*").alias("n"), F.min("h3_index").alias("first"))


@query("pu4_equal_interval_bins", "SELECT CAST(b AS INT) AS bin, round(low + size * (b + 1), 6) AS label, COALESCE(n, 0) AS n_rows FROM (SELECT MIN(cost) AS low, (MAX(cost) + 1 - MIN(cost)) / 7 AS size FROM units) e CROSS JOIN (SELECT unnest(range(0, 7)) AS b) s LEFT JOIN (SELECT CAST(floor((cost - low) / size) AS INT) AS bin, COUNT(*) AS n FROM units CROSS JOIN (SELECT MIN(cost) AS low, (MAX(cost) + 1 - MIN(cost)) / 7 AS size FROM units) x GROUP BY 1) c ON c.bin = b")
def pu4(t):
    return p.equal_interval_bins(t("units"), "cost", 7).select("bin", F.round("label", 6).alias("label"), "n_rows")


@query("pu5_cost_layer", "SELECT project_id, bin, COUNT(*) AS n, MIN(h3_index) AS first FROM (SELECT u.project_id, h3_index, CAST(greatest(0, list_count(list_filter(e, lambda x: x < u.cost)) - 1) AS INT) AS bin FROM project_units u JOIN (SELECT project_id, list_transform(range(0, 10), lambda k: CASE WHEN k = 0 THEN a - (b - a) * 0.001 WHEN k = 9 THEN b ELSE a + k * ((b - a) / 9) END) AS e FROM (SELECT project_id, MIN(cost) AS a, MAX(cost) AS b FROM project_units GROUP BY project_id) m) z USING (project_id)) q GROUP BY project_id, bin")
def pu5(t):
    return p.cost_layer(t("project_units"), nested=False).groupBy("project_id", "bin").agg(F.count("*").alias("n"), F.min("h3_index").alias("first"))


@query("pu6_project_units", f"SELECT u.project_id, u.h3_index, c.resolution, u.cost, u.status FROM project_units u JOIN cells c USING (h3_index) JOIN projects p ON p.id = u.project_id JOIN grids g ON g.unique_id = p.planning_unit_id WHERE c.resolution = 6 AND lower(trim(c.project_area)) = {AREA}")
def pu6(t):
    return p.project_units(t("project_units"), t("cells"), t("projects"), t("grids"), 6).drop("area")


@query("pu7_status_counts", "SELECT status, COUNT(*) AS n FROM project_units GROUP BY status")
def pu7(t):
    return p.status_counts(t("project_units"))


AMOUNTS = "SELECT CAST(n_nationkey AS BIGINT) AS project_id, species AS feature_unique_id, concat('c', pu) AS h3_index, amount FROM puvspr JOIN nation ON n_nationkey = pu % 25"


@query("pu8_unit_detail", f"SELECT u.project_id, u.h3_index, COALESCE(u.cost, 0) AS cost, m.alias, a.amount FROM project_units u JOIN project_features f USING (project_id) JOIN features m ON m.unique_id = f.feature_unique_id LEFT JOIN ({AMOUNTS}) a ON a.project_id = u.project_id AND a.feature_unique_id = f.feature_unique_id AND a.h3_index = u.h3_index")
def pu8(t):
    return p.unit_detail(t("project_units"), t("project_features"), t.sql(AMOUNTS), t("features"))


EDITS = "SELECT project_id, h3_index, CAST(1 + length(h3_index) % 3 AS INT) AS status FROM project_units WHERE project_id % 3 = 0 AND cost > 1000"


@query("pu9_update_status", f"SELECT u.project_id, u.h3_index, u.cost, CASE WHEN u.project_id IN (SELECT project_id FROM ({EDITS}) e) THEN COALESCE((SELECT MAX(status) FROM ({EDITS}) e WHERE e.project_id = u.project_id AND e.h3_index = u.h3_index), 0) ELSE u.status END AS status FROM project_units u")
def pu9(t):
    return p.update_status(t("project_units"), t.sql(EDITS))


@query("pu10_apply_cost_profile", "SELECT u.id, u.status, CAST(s.total AS DOUBLE) AS cost, 1.0::DOUBLE AS equal FROM units u LEFT JOIN (SELECT pu, SUM(amount) AS total FROM puvspr GROUP BY pu) s ON s.pu = u.id")
def pu10(t):
    costs = t.sql("SELECT pu AS id, SUM(amount) AS cost FROM puvspr GROUP BY pu")
    units = t("units").select("id", "status", "cost")
    return p.apply_cost_profile(units, "fishing", costs).join(p.apply_cost_profile(units, "Equal area").select("id", F.col("cost").alias("equal")), "id")


@query("pu11_cost_profiles", "SELECT id AS project_id, 'Equal area' AS profile FROM projects UNION ALL SELECT id, 'Custom' FROM projects WHERE id IN (SELECT project_id FROM project_units WHERE cost > 1050)")
def pu11(t):
    return p.cost_profiles(t("projects"), t("project_units").where("cost > 1050"))


@query("pu12_projects_of_user", "SELECT p.id, p.name, m.role, p.id = MIN(p.id) OVER () AS selected FROM members m JOIN projects p ON p.id = m.project_id WHERE m.user_id = 7")
def pu12(t):
    return p.projects_of_user(t("projects"), t("members"), 7)


@query("pu13_first_project", "SELECT user_id, id FROM (SELECT m.user_id % 97 AS user_id, p.id, ROW_NUMBER() OVER (PARTITION BY m.user_id % 97 ORDER BY p.created, p.id) AS n FROM members m JOIN projects p ON p.id = m.project_id) x WHERE n = 1")
def pu13(t):
    return p.first_project(t("projects"), t("members").withColumn("user_id", F.col("user_id") % 97))


@query("pu14_projects_of_grid", "SELECT o_orderkey AS project_id FROM orders WHERE o_orderstatus = 'F'")
def pu14(t):
    return p.projects_of_grid(parse_params(t("params")), "pu_f")


KNOWN = "SELECT 'pu_f' AS feature_class_name, CAST(1 AS BIGINT) AS unique_id UNION ALL SELECT 'pu_o', CAST(2 AS BIGINT)"


@query("pu15_projects_with_grids", "SELECT o_orderkey AS project_id, concat('pu_', lower(o_orderstatus)) AS grid, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS unique_id FROM orders")
def pu15(t):
    return p.projects_with_grids(parse_params(t("params")), t.spark.sql(KNOWN))


@query("pu16_project_bundle", "SELECT p.id, p.name, g.alias AS grid_alias, COALESCE(f.n, 0) AS n_features, CAST(COALESCE(x.blm, '-1') AS VARCHAR) AS blm FROM projects p LEFT JOIN grids g ON g.unique_id = p.planning_unit_id LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM project_features GROUP BY project_id) f ON f.project_id = p.id LEFT JOIN (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS blm FROM orders) x ON x.id = p.id")
def pu16(t):
    out = p.project_bundle(t("projects"), parse_params(t("params")), t("project_features"), t("grids"))
    return out.select("id", "name", "grid_alias", F.when(F.col("features").isNull(), 0).otherwise(F.size("features")).cast("long").alias("n_features"), F.coalesce(F.try_element_at("parameters", F.lit("BLM")), F.lit("-1")).alias("blm"))


FILES = "SELECT CAST(c_nationkey AS BIGINT) AS project_id, concat('TYPE', c_custkey % 3) AS file_type, MIN(concat(lower(c_mktsegment), '.dat')) AS file_name FROM customer GROUP BY c_nationkey, c_custkey % 3"
RENDERER = "SELECT CAST(s_nationkey AS BIGINT) AS project_id, concat('KEY', s_suppkey % 2) AS key, CAST(MAX(s_suppkey) AS VARCHAR) AS value FROM supplier GROUP BY s_nationkey, s_suppkey % 2"


@query("pu16_whole_bundle", f"SELECT p.id, COALESCE(n, 0) AS n_parameters, f.file_name, r.value AS renderer, g.alias AS grid_alias, g.planning_unit_count AS units, c.n_name AS country FROM projects p LEFT JOIN (SELECT o_orderkey AS id, CAST(4 AS BIGINT) AS n FROM orders) x ON x.id = p.id LEFT JOIN (SELECT * FROM ({FILES}) a WHERE file_type = 'TYPE1') f ON f.project_id = p.id LEFT JOIN (SELECT * FROM ({RENDERER}) b WHERE key = 'KEY0') r ON r.project_id = p.id LEFT JOIN grids g ON g.unique_id = p.planning_unit_id LEFT JOIN nation c ON c.n_nationkey = g.resolution")
def pu16b(t):
    text = lambda sql: t.sql(sql.replace("AS VARCHAR", "AS STRING"))
    countries = t("nation").select(F.col("n_nationkey").cast("int").alias("resolution"), F.col("n_name").alias("country"))
    grids = t("grids").join(countries, "resolution", "left")
    out = p.whole_bundle(t("projects"), parse_params(t("params")), text(FILES), text(RENDERER), t("project_features"), grids)
    return out.select("id", F.coalesce(F.size("run_parameters"), F.lit(0)).cast("long").alias("n_parameters"), F.try_element_at("files", F.lit("TYPE1")).alias("file_name"), F.try_element_at("renderer", F.lit("KEY0")).alias("renderer"), "grid.alias", "grid.planning_unit_count", "grid.country").withColumnsRenamed({"alias": "grid_alias", "planning_unit_count": "units"})


@query("pu17_scenario_group", f"SELECT project_id + (i + 1) * 1000000 AS project_id, key, CASE key WHEN 'BLM' THEN b WHEN 'NUMREPS' THEN '1' ELSE value END AS value FROM ({PARAMS}) p CROSS JOIN (SELECT 0 AS i, '0.1' AS b UNION ALL SELECT 1, '0.5') s")
def pu17(t):
    return p.scenario_group(parse_params(t("params")), [0.1, 0.5], 1000000)


@query("pu18_clone_projects", "SELECT project_id, h3_index, cost, status FROM project_units UNION ALL SELECT project_id + 100, h3_index, cost, status FROM project_units WHERE project_id < 5")
def pu18(t):
    ids = t("projects").where("id < 5").select("id", (F.col("id") + 100).alias("new_id"))
    return p.clone_projects(t("project_units"), ids)


@query("pu18_cloned_with_parameters", "SELECT id, name, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS created FROM projects UNION ALL SELECT id + 100, concat(name, '_copy'), concat('Clone of project ', chr(39), name, chr(39)), '05/01/24 10:00:00' FROM projects WHERE id < 15")
def pu18b(t):
    ids = t("projects").where("id < 15").select("id", (F.col("id") + 100).alias("new_id"))
    projects, params = p.cloned(t("projects"), parse_params(t("params")), ids, F.lit("2024-01-05 10:00:00").cast("timestamp"))
    wide = params.where("key IN ('DESCRIPTION', 'CREATEDATE')").groupBy(F.col("project_id").alias("id")).pivot("key", ["DESCRIPTION", "CREATEDATE"]).agg(F.min("value"))
    return projects.join(wide, "id", "left").select("id", "name", F.col("DESCRIPTION").alias("description"), F.col("CREATEDATE").alias("created"))


UPDATES = "SELECT o_orderkey AS project_id, 'BLM' AS key, '9' AS value FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'NOKEY', '1' FROM orders"


@query("pu19_set_parameters", f"SELECT project_id, key, CASE WHEN key = 'BLM' AND project_id % 4 = 0 THEN '9' ELSE value END AS value FROM ({PARAMS}) p WHERE key != 'NUMREPS' UNION ALL SELECT o_orderkey, 'NUMREPS', '5' FROM orders")
def pu19(t):
    return p.add_parameter(p.set_parameters(parse_params(t("params")).drop("flag"), t.sql(UPDATES)), "NUMREPS", "5")


@query("pu20_project_list", "SELECT p.id, p.name, 'No description' AS description, CASE WHEN o.o_orderkey IS NULL THEN false ELSE o.o_orderkey % 2 = 0 END AS is_private, COALESCE(CAST(o.o_custkey AS VARCHAR), '0') AS blm FROM projects p LEFT JOIN orders o ON o.o_orderkey = p.id")
def pu20(t):
    return p.project_list(t("projects"), parse_params(t("params")))
