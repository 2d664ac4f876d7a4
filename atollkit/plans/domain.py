"""Planning tables over the given star schema, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Integer arithmetic alone, so that both engines make the same rows.
VIEWS = {
    "units": "SELECT p_partkey AS id, p_partkey % 50 AS ix, CAST(floor(p_partkey / 50) AS BIGINT) AS iy, p_retailprice AS cost, CAST(p_size % 4 AS INT) AS status FROM part",
    "cells": "SELECT concat('c', p_partkey) AS h3_index, CAST(5 + p_size % 4 AS INT) AS resolution, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN lower(p_type) ELSE concat(' ', p_type, ' ') END AS project_area, p_retailprice AS cost, CAST(p_size % 4 AS INT) AS status, p_partkey FROM part",
    "puvspr": "SELECT l_suppkey AS species, l_partkey AS pu, SUM(l_quantity) AS amount FROM lineitem GROUP BY l_suppkey, l_partkey",
    "spec": "SELECT s_suppkey AS id, CAST(1 + s_suppkey % 9 AS DOUBLE) / 10 AS prop, CAST(1 + s_suppkey % 40 AS DOUBLE) AS spf, s_name AS name, s_nationkey AS project_id FROM supplier",
    "solutions": "SELECT CAST(l_orderkey % 10 + 1 AS INT) AS run, l_partkey AS planning_unit, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS selected FROM lineitem GROUP BY l_orderkey % 10 + 1, l_partkey",
    "bounds": "SELECT a.id AS id1, b.id AS id2, CAST(1 + (a.id + b.id) % 3 AS DOUBLE) AS boundary FROM units a JOIN units b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1)",
    "grids": "SELECT CAST(ROW_NUMBER() OVER (ORDER BY k) AS BIGINT) AS unique_id, k AS feature_class_name, alias, resolution, CAST(n AS BIGINT) AS planning_unit_count FROM (SELECT concat('pu_', lower(p_type), '_', 5 + p_size % 4) AS k, concat(p_type, ' (Res ', 5 + p_size % 4, ')') AS alias, CAST(5 + p_size % 4 AS INT) AS resolution, COUNT(*) AS n FROM part GROUP BY p_type, 5 + p_size % 4) x",
    "projects": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey % 20 + 1 AS BIGINT) AS planning_unit_id, CAST(n_regionkey AS BIGINT) AS user_id, CAST(n_nationkey * 37 % 11 AS BIGINT) AS created FROM nation",
    "members": "SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS project_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'owner' WHEN c_mktsegment = 'MACHINERY' THEN 'editor' ELSE 'viewer' END AS role FROM customer",
    "project_units": "SELECT CAST(n_nationkey AS BIGINT) AS project_id, concat('c', p_partkey) AS h3_index, p_retailprice AS cost, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 4 AS INT) END AS status FROM nation JOIN part ON p_partkey % 25 = n_nationkey",
    "project_features": "SELECT CAST(s_nationkey AS BIGINT) AS project_id, s_suppkey AS feature_unique_id, CAST(1 + s_suppkey % 9 AS DOUBLE) / 10 AS target_value, CAST(1 + s_suppkey % 40 AS DOUBLE) AS spf FROM supplier",
    "features": "SELECT s_suppkey AS unique_id, concat('f_', s_suppkey) AS feature_class_name, s_name AS alias, CASE WHEN s_suppkey % 10 = 0 THEN 'global admin' ELSE 'user' END AS created_by FROM supplier",
    "params": "SELECT o_orderkey AS project_id, concat('Input file\\nBLM ', o_custkey, '\\nNUMREPS ', o_orderkey % 100, '\\nPRIVATE ', CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END, '\\nPLANNING_UNIT_NAME pu_', lower(o_orderstatus), '\\n') AS text FROM orders",
    "sites": "SELECT c_custkey AS site_id, c_mktsegment AS iucn_cat, c_custkey % 47 AS x0, c_custkey * 7 % 41 AS y0, c_custkey % 47 + 1 + c_custkey % 5 AS x1, c_custkey * 7 % 41 + 1 + c_custkey % 4 AS y1 FROM customer",
    "boxes": "SELECT s_suppkey AS feature_id, s_suppkey * 3 % 43 AS x0, CAST(s_suppkey * 11 % 37 + floor(s_suppkey / 37) * 37 AS BIGINT) AS y0, s_suppkey * 3 % 43 + 2 + s_suppkey % 6 AS x1, CAST(s_suppkey * 11 % 37 + floor(s_suppkey / 37) * 37 + 1 + s_suppkey % 5 AS BIGINT) AS y1 FROM supplier",
    "places": "SELECT s_suppkey AS feature_id, s_suppkey * 3 % 43 AS x0, CAST((s_suppkey * 11 % 37 + floor(s_suppkey / 37) * 37) % 150 - 75 AS BIGINT) AS y0, s_suppkey * 3 % 43 + 2 + s_suppkey % 6 AS x1, CAST((s_suppkey * 11 % 37 + floor(s_suppkey / 37) * 37) % 150 - 74 + s_suppkey % 5 AS BIGINT) AS y1 FROM supplier",
    "raster": "SELECT concat('eco_', l_suppkey % 5) AS layer, CAST(l_partkey % 40 AS INT) AS r, CAST(floor(l_partkey / 40) AS INT) AS c, MAX(CAST(round(l_discount * 100) AS DOUBLE)) AS v FROM lineitem GROUP BY l_suppkey % 5, l_partkey % 40, floor(l_partkey / 40)",
    "stressors": "SELECT concat('p_', l_linenumber) AS layer, CAST(l_partkey % 40 AS INT) AS r, CAST(floor(l_partkey / 40) AS INT) AS c, MAX(CAST(round(l_tax * 100) AS DOUBLE)) AS v FROM lineitem GROUP BY l_linenumber, l_partkey % 40, floor(l_partkey / 40)",
    "sens": "SELECT concat('eco_', e) AS eco, concat('p_', p) AS pressure, CAST((e * 3 + p) % 4 AS INT) AS score FROM (SELECT DISTINCT s_suppkey % 5 AS e FROM supplier) a CROSS JOIN (SELECT DISTINCT l_linenumber AS p FROM lineitem) b",
    "pad": "SELECT p_partkey AS pos, p_type AS activity, p_brand AS category, concat('p_', 1 + p_size % 7) AS pressure, CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'high' END AS rpptitle FROM part",
    "run_log": "SELECT user_id AS pid, user_id % 10 AS user_id, user_id % 7 AS project_id, MIN(ts) AS starttime, COUNT(*) AS done, CASE WHEN user_id % 3 = 0 THEN 'Running' WHEN user_id % 3 = 1 THEN 'Completed' ELSE 'Stopped' END AS status FROM events GROUP BY user_id",
}

#: Views that Spark reads in another form with the same rows: a join on an OR would try all pairs of units.
SPARK_VIEWS = {
    "bounds": "SELECT /*+ MERGE(b) */ a.id AS id1, b.id AS id2, CAST(1 + (a.id + b.id) % 3 AS DOUBLE) AS boundary FROM units a JOIN units b ON b.ix = a.ix + 1 AND b.iy = a.iy UNION ALL SELECT /*+ MERGE(b) */ a.id, b.id, CAST(1 + (a.id + b.id) % 3 AS DOUBLE) FROM units a JOIN units b ON b.ix = a.ix AND b.iy = a.iy + 1",
}

NEEDS = {"bounds": ["units"]}


class Tables:
    """Tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(SPARK_VIEWS.get(name, VIEWS[name]))

    def columns(self, raster: str) -> int:
        """Columns of a raster, as far as it has values: one number."""
        last = self(raster).agg({"c": "max"}).first()[0]
        return 0 if last is None else last + 1

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """A statement over tables and views by their own names."""
        import re

        names = [n for n in (*TABLES, *VIEWS) if n not in more and re.search(rf"(?:FROM|JOIN)\s+{n}\b", text)]
        for n in (*names, *more):
            text = re.sub(rf"(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: self(n) for n in names}, **more)


def oracle(text: str) -> str:
    """The statement with the views that it names in front, for DuckDB."""
    import re

    used: list[str] = []

    def add(sql: str) -> None:
        for n in VIEWS:
            if n not in used and re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql):
                add(VIEWS[n])
                used.append(n)

    add(text)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used).replace("\\n", "' || chr(10) || '")
    text = text.strip()
    if not views:
        return text
    recursive = "RECURSIVE " if text.startswith("WITH RECURSIVE ") else ""
    rest = f", {text.removeprefix('WITH ').removeprefix('RECURSIVE ')}" if text.startswith("WITH ") else f" {text}"
    return f"WITH {recursive}{views}{rest}"


Query = Callable[[Tables], DataFrame]
REGISTERED: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over Tables, with its SQL twin where there is one."""
    def add(fn: Query) -> Query:
        REGISTERED[name] = fn
        if sql:
            SQL[name] = oracle(sql)
        return fn

    return add
