"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from atollkit.functions import scalars as s
from atollkit.plans.domain import query


@query("sc1_normalize_name", "SELECT p_partkey, lower(replace(replace(replace(concat(p_type, '/', p_name, '-', p_brand), ' ', '_'), '-', '_'), '/', '_')) AS name FROM part")
def sc1(t):
    return t("part").select("p_partkey", s.normalize_name(F.concat("p_type", F.lit("/"), "p_name", F.lit("-"), "p_brand")).alias("name"))


@query("sc2_replace_chars", r"SELECT p_partkey, lower(regexp_replace(regexp_replace(concat(p_brand, '  ', p_name, ' (', p_type, ')'), '[[:punct:]]', '', 'g'), '\s+', '_', 'g')) AS name FROM part")
def sc2(t):
    return t("part").select("p_partkey", s.replace_chars(F.concat("p_brand", F.lit("  "), "p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("name"))


@query("sc3_safe_project_name", "SELECT n_nationkey, replace(trim(concat(' ', n_name, ' plan ')), ' ', '_') AS name FROM nation")
def sc3(t):
    return t("nation").select("n_nationkey", s.safe_project_name(F.concat(F.lit(" "), "n_name", F.lit(" plan "))).alias("name"))


@query("sc4_format_eunis", "SELECT p_partkey, split_part(split_part(trim(concat('MB', p_size, CASE WHEN p_size % 2 = 0 THEN ': ' ELSE ' ' END, p_name)), ' ', 1), ':', 1) AS code FROM part")
def sc4(t):
    return t("part").select("p_partkey", s.format_eunis(F.concat(F.lit("MB"), "p_size", F.when(F.col("p_size") % 2 == 0, ": ").otherwise(" "), "p_name")).alias("code"))


@query("sc5_stable_id", "SELECT p_type, CAST(concat('0x', substr(sha1(p_type), 1, 6)) AS BIGINT) AS id FROM (SELECT DISTINCT p_type FROM part)")
def sc5(t):
    return t("part").select("p_type").distinct().select("p_type", s.stable_id(F.col("p_type")).alias("id"))


LEVEL = "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'Low' WHEN p_size % 5 = 2 THEN 'Medium' WHEN p_size % 5 = 3 THEN 'High' ELSE 'Not relevant' END"


@query("sc6_sensitivity_score", f"SELECT p_partkey, CAST(CASE {LEVEL} WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 0 END AS INT) AS score FROM part")
def sc6(t):
    return t.sql(f"SELECT p_partkey, {LEVEL} AS level FROM part").select("p_partkey", s.sensitivity_score(F.col("level")).alias("score"))


@query("sc7_scale_level", "SELECT p_partkey, CASE WHEN p_size <= 6 THEN 'basin' WHEN p_size = 7 THEN 'regional' ELSE 'local' END AS standard, CASE WHEN p_size <= 2 THEN 'basin' WHEN p_size <= 5 THEN 'regional' ELSE 'local' END AS coarse FROM part")
def sc7(t):
    return t("part").select("p_partkey", s.scale_level(F.col("p_size")).alias("standard"), s.scale_level(F.col("p_size"), "coarse").alias("coarse"))


@query("sc8_grid_name", "SELECT h3_index, concat('v_h3_', replace(lower(project_area), ' ', '_'), '_res', resolution) AS name FROM cells")
def sc8(t):
    return t("cells").select("h3_index", s.grid_name(F.col("project_area"), F.col("resolution")).alias("name"))


@query("sc9_fmt_date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y %H:%M:%S') AS shown FROM orders")
def sc9(t):
    return t("orders").select("o_orderkey", s.fmt_date(F.col("o_orderdate")).alias("shown"))


@query("sc10_area_from_alias", "SELECT unique_id, lower(trim(split_part(alias, ' (', 1))) AS area FROM grids")
def sc10(t):
    return t("grids").select("unique_id", s.area_from_alias(F.col("alias")).alias("area"))


@query("sc11_unique_feature_name", "SELECT s_suppkey, concat('f_', substr(md5(s_name), 1, 30)) AS name FROM supplier")
def sc11(t):
    return t("supplier").select("s_suppkey", s.unique_feature_name("f_", F.col("s_name")).alias("name"))


@query("sc12_bool_text", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders")
def sc12(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, "True").when(F.col("o_orderkey") % 3 == 1, "False").otherwise("maybe")
    return t("orders").select("o_orderkey", s.bool_text(text).alias("flag"))


@query("sc13_cell_sizes", "SELECT p_partkey, round(sqrt((p_size * p_size) / (1.5 * sqrt(3.0))), 8) AS edge, round(sqrt(2 * p_retailprice / sqrt(3.0)), 8) AS width, round(sqrt(p_retailprice), 8) AS side, round((p_retailprice - 1.0) / p_size / sqrt(3.0), 6) AS radius FROM part")
def sc13(t):
    a, p = (F.col("p_size") * F.col("p_size")).cast("double"), F.col("p_retailprice")
    return t("part").select("p_partkey", F.round(s.hex_edge_from_area(a), 8).alias("edge"), F.round(s.hex_width_from_area(p), 8).alias("width"), F.round(s.square_width_from_area(p), 8).alias("side"), F.round(s.hex_radius_from_count(F.col("p_size"), F.lit(1.0), p), 6).alias("radius"))


@query("sc14_missing_values", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS cost, CASE WHEN p_size % 4 = 0 THEN 'No description' ELSE p_name END AS description, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_type END AS alias FROM part")
def sc14(t):
    rows = t.sql("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS cost, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS description, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS alias, p_brand AS feature_class_name FROM part")
    return s.metadata_defaults(s.null_if_nan(rows)).drop("feature_class_name")
