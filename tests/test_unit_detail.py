"""Units with the features of their project: all pairs, and what is shuffled for them."""

import math

from pyspark.sql import functions as F

from atollkit.operators import projects as p


def detail(spark, units, features, amounts, meta):
    return p.unit_detail(
        spark.createDataFrame(units, "project_id long, h3_index string, cost double"), spark.createDataFrame(features, "project_id long, feature_unique_id long"),
        spark.createDataFrame(amounts, "project_id long, h3_index string, feature_unique_id long, amount double"), spark.createDataFrame(meta, "unique_id long, alias string"),
    )


def test_repeated_null_and_foreign_rows(spark):
    units = [(1, "a", 2.0), (1, "b", None), (1, "a", 2.0), (1, None, 1.0), (2, "a", 5.0), (3, "z", 1.0), (None, "a", 1.0)]
    features = [(1, 10), (1, 11), (1, 11), (1, 12), (1, 99), (2, 10), (2, None), (None, 10)]
    amounts = [(1, "a", 10, 3.0), (1, "a", 10, 4.0), (1, "a", 10, 4.0), (1, "b", 11, None), (1, "a", 77, 9.0), (2, "b", 10, 1.0), (1, None, 10, 6.0), (2, "a", 11, 8.0), (1, "b", None, 2.0)]
    meta = [(10, "ten"), (11, "eleven"), (11, "onze"), (12, None), (13, "none")]
    want = []
    for pu, h, c in units:
        for pf, f in features:
            for m, alias in meta:
                if pu is not None and f is not None and pu == pf and f == m:
                    met = [a for pa, ha, fa, a in amounts if pa == pu and h is not None and ha == h and fa == f]
                    want += [(pu, h, c or 0.0, alias, a) for a in met or [None]]
    key = lambda t: [(x is not None, x) for x in t]
    assert sorted((tuple(r) for r in detail(spark, units, features, amounts, meta).collect()), key=key) == sorted(want, key=key)


def test_more_features_than_an_array_holds(spark):
    units, n = [(k % 2, f"c{k}", float(k)) for k in range(30)], 1500
    amounts = [(k % 2, f"c{k}", f, float(k + f)) for k in range(30) for f in range(k % 3, n, 97)]
    got = detail(spark, units, [(f % 2, f) for f in range(n)], amounts, [(f, f"s{f}") for f in range(n)])
    rows = got.agg(F.count("*"), F.sum("amount"), F.count("amount"), F.countDistinct("h3_index", "alias")).first()
    mine = [(k, f, a) for (pu, h, f, a), k in ((t, int(t[1][1:])) for t in amounts) if pu == f % 2]
    assert tuple(rows) == (30 * n // 2, math.fsum(a for *_, a in mine), len(mine), 30 * n // 2)


def test_amounts_of_other_projects_stay_behind(spark):
    """Only amounts of a project's own features are gathered by unit, and pairs are made in as many tasks as are stated."""
    units = spark.range(400).selectExpr("id % 4 AS project_id", "concat('c', id) AS h3_index", "CAST(id AS DOUBLE) AS cost")
    features = spark.range(100).selectExpr("id % 4 AS project_id", "id AS feature_unique_id")
    amounts = units.crossJoin(spark.range(100).withColumnRenamed("id", "feature_unique_id")).selectExpr("project_id", "h3_index", "feature_unique_id", "cost AS amount")
    out = p.unit_detail(units, features, amounts, spark.range(100).selectExpr("id AS unique_id", "concat('s', id) AS alias"))
    assert out.count() == 400 * 25 and out.where("amount IS NULL").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan[plan.index("collect_list") :]
    assert "Join Inner" in gathered[: gathered.index("LeftOuter")] if "LeftOuter" in gathered else "Join Inner" in gathered
    assert "try_element_at" not in plan and out.rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
