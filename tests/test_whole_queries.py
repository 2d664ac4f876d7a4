"""Queries that take all boxes and all uses, against brute force."""

import math

from atollkit.plans import registry

SF = "/root/testdata/sf0.001"


def test_grid_of_all_boxes(spark):
    boxes = [(s * 3 % 43, s * 11 % 37 + s // 37 * 37, s * 3 % 43 + 2 + s % 6, s * 11 % 37 + s // 37 * 37 + 1 + s % 5) for (s,) in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()]
    x0, y0, x1, y1 = (f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))
    want = []
    for r in range(math.ceil((y1 - y0 + 8) / 4)):
        for c in range(math.ceil((x1 - x0 + 8) / 4)):
            a = (x0 - 4 + 4 * c, y1 - 4 * r, x0 + 4 * c, y1 + 4 - 4 * r)
            if any(a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1] for b in boxes):
                want.append((len(want) + 1, *map(float, a)))
    assert sorted(map(tuple, registry.queries()["gr7_make_grid_cells"](spark, SF).collect())) == want


def test_features_of_any_unit_are_used(spark, tmp_path):
    suppliers = [(k, f"s{k}", 0) for k in (1, 2, 3, 10)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 5, 1.0), (2, 500, 1.0), (2, 20, 1.0)], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["fe16_prune_unused_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "s1"), (2, "s2"), (10, "s10")]
