"""Planning operators on small tables: edge cases, nulls and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atollkit.functions import crs, kernels
from atollkit.functions import scalars as s
from atollkit.operators import features as fe
from atollkit.operators import grid as gr
from atollkit.operators import projects as pu
from atollkit.operators import protected
from atollkit.operators import raster as ra
from atollkit.operators import results as rs
from atollkit.operators import spatial as sj
from atollkit.sources import geometry_io, io
from atollkit.streaming import runs


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("r")).first()["r"]


def test_scalars(spark):
    assert one(spark, "North Sea-East/2", s.normalize_name) == "north_sea_east_2"
    assert one(spark, "Physical  loss, (of) x!", s.replace_chars) == "physical_loss_of_x"
    assert one(spark, " My Plan ", s.safe_project_name) == "My_Plan"
    assert one(spark, "MB12: Atlantic rock", s.format_eunis) == "MB12" and one(spark, None, s.format_eunis) is None and one(spark, "", s.format_eunis) == ""
    assert one(spark, None, s.sensitivity_score) == 0 and one(spark, "Medium", s.sensitivity_score) == 2
    assert [one(spark, r, s.scale_level, "int") for r in (6, 7, 8)] == ["basin", "regional", "local"]
    assert [one(spark, r, lambda c: s.scale_level(c, "coarse"), "int") for r in (2, 5, 6)] == ["basin", "regional", "local"]
    assert one(spark, "North Sea (Res 7)", s.area_from_alias) == "north sea"
    assert len(one(spark, "k", lambda c: s.unique_feature_name("f_", c))) == 32
    assert one(spark, "True", s.bool_text) is True and one(spark, "x", s.bool_text) is None
    with pytest.raises(ValueError):
        s.scale_level(F.lit(1), "other")
    nan = s.null_if_nan(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()
    assert nan.a is None and nan.b == 1


def test_params(spark):
    text = "FIRST 1\nBLM 0.10\nRUNMODE 1\nPRIVATE True\nThe end\nEMPTY\n"
    got = {r.key: (r.value, r.flag) for r in io.parse_params(spark.createDataFrame([(1, text), (2, None)], "project_id int, text string")).collect()}
    assert got == {"BLM": ("0.10", None), "RUNMODE": ("1", None), "PRIVATE": ("True", True), "T": ("e end", None), "EMPTY": ("", None)}
    kinds = {r.key: r.category for r in io.categorise_params(io.parse_params(spark.createDataFrame([(1, text)], "project_id int, text string"))).collect()}
    assert kinds == {"BLM": "run", "RUNMODE": "run", "PRIVATE": "metadata"}


def test_read_table(spark, tmp_path):
    (tmp_path / "a.dat").write_text("<<<<<<< HEAD\nid\tprop\tspf\n1\t0.5\t2\n=======\n2\t0.25\t3\n>>>>>>> x\n")
    (tmp_path / "b.dat").write_text("id,cost\n7,1.5\n")
    (tmp_path / "empty.dat").write_text("")
    spec = "id long, prop double, spf double"
    assert sorted(tuple(r) for r in io.read_table(spark, str(tmp_path / "a.dat"), spec).collect()) == [(1, 0.5, 2.0), (2, 0.25, 3.0)]
    assert [tuple(r) for r in io.read_table(spark, str(tmp_path / "b.dat"), "id long, cost double").collect()] == [(7, 1.5)]
    for name in ("missing.dat", "empty.dat"):
        got = io.read_table(spark, str(tmp_path / name), spec)
        assert got.count() == 0 and got.columns == ["id", "prop", "spf"]
    with pytest.raises(ValueError):
        io.append_table(spark.createDataFrame([], spec), str(tmp_path / "c"))


def test_read_runs(spark, tmp_path):
    (tmp_path / "output_r00001.csv").write_text('"planning_unit","solution"\n1,1\n2,0\n')
    (tmp_path / "output_r00012.txt").write_text("planning_unit\tsolution\n1\t0\n")
    got = sorted(tuple(r) for r in io.read_runs(spark, str(tmp_path / "output_r*"), "r").collect())
    assert got == [(1, 0, 12), (1, 1, 1), (2, 0, 1)]
    assert io.read_runs(spark, str(tmp_path / "output_mv*"), "mv").count() == 0


def test_jdbc(spark):
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").coalesce(1)
    io.write_jdbc(df, "jdbc:derby:memory:t1;create=true", "units", "overwrite", **driver)
    got = io.read_jdbc(spark, "jdbc:derby:memory:t1", "units", "id", 0, 4, 2, **driver)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, None)]


def test_wkt_and_geojson(spark, tmp_path):
    rows = [(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), (2, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 7 5, 7 7, 5 5)))"), (3, None), (4, "POLYGON EMPTY"), (5, "POINT (3 4)")]
    got = geometry_io.from_wkt(spark.createDataFrame(rows, "id int, wkt string"), "wkt", "geometry")
    areas = sorted((r.id, r.a) for r in got.select("id", crs.planar_area(F.col("geometry")).alias("a")).collect())
    assert areas == [(1, 15.0), (2, 0.5), (2, 2.0), (5, 0.0)]
    (tmp_path / "x.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}}]}')
    got = geometry_io.read_geojson(spark, str(tmp_path / "x.json")).select("feature", F.col("properties")["code"].alias("c"), crs.planar_area(F.col("geometry")).alias("a"))
    assert sorted((r.feature, r.c, r.a) for r in got.collect()) == [(0, "A", 2.0), (1, None, 0.5)]


def square(x, y, n=1.0):
    return np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)], float)


def test_kernels():
    hole = [square(0, 0, 4), square(1, 1)]
    assert kernels.area(hole) == 15 and kernels.overlap_area(hole, square(0, 0, 2)) == 3
    l_shape = np.array([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0)], float)
    assert kernels.overlap_area([l_shape], square(0, 0, 2)) == pytest.approx(3)
    assert kernels.union_area([[square(0, 0, 2)], [square(1, 1, 2)], [square(1, 1, 2)]]) == pytest.approx(7)
    assert kernels.union_area([[square(0, 0, 2)], [np.array([(0, 0), (2, 0), (0, 2), (0, 0)], float)]]) == pytest.approx(4)
    assert kernels.intersects([square(0, 0)], [square(1, 1)]) and not kernels.intersects([square(0, 0)], [square(1.1, 0)])
    assert kernels.intersects([square(0, 0, 9)], [square(3, 3)]) and kernels.contains([square(0, 0, 9)], [square(3, 3)]) and not kernels.contains([square(0, 0)], [square(0.5, 0.5)])
    assert kernels.touches([square(0, 0)], [square(1, 0)]) and not kernels.touches([square(0, 0)], [square(0.5, 0)])
    assert kernels.shared_boundary(square(0, 0), square(1, 0.25)) == pytest.approx(0.75)
    assert kernels.points_in_polygon(np.array([0.0, 1.0, 0.5]), np.array([0.0, 1.0, 0.5]), [square(0, 0)]).tolist() == [True, False, True]
    bow = [np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], float)]
    assert kernels.validity_reason(bow) == "Self-intersection" and kernels.validity_reason([square(0, 0)]) is None and kernels.validity_reason([])
    two = kernels.split_at_dateline([np.array([(170, 0), (-170, 0), (-170, 10), (170, 10), (170, 0)], float)])
    assert sum(kernels.area(p) for p in two) == pytest.approx(200) and {p[0][:, 0].min() for p in two} == {170, -180}


def geometry(spark, rows):
    return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in r] for r in g]) for i, g in rows], f"id long, geometry {crs.GEOMETRY}")


def test_projections(spark):
    g = geometry(spark, [(1, [square(-20, 50, 1)])])
    ease = g.select(crs.planar_area(crs.to_ease_grid(F.col("geometry"))).alias("a"), crs.planar_area(crs.to_ease2(F.col("geometry"))).alias("b"), crs.planar_area(crs.to_albers(F.col("geometry"))).alias("c")).first()
    assert ease.a == pytest.approx(7.86e9, rel=0.01) and ease.b == pytest.approx(ease.a, rel=0.01) and ease.c == pytest.approx(ease.b, rel=0.001)
    back = g.select(crs.from_ease_grid(crs.to_ease_grid(F.col("geometry")))[0][2].alias("p")).first().p
    assert (back.x, back.y) == pytest.approx((-19, 51))
    m = g.select(crs.centroid(F.col("geometry")).alias("m")).first().m
    assert (m.x, m.y) == pytest.approx((-19.5, 50.5))


def test_hex_grids(spark):
    cells = gr.hex_grid_pointy(spark, (0, 0, 10, 8), 1.0)
    r = cells.agg(F.max("row_number"), F.count("*"), F.avg(crs.planar_area(F.col("geometry")))).first()
    assert r[0] == 6 and r[2] == pytest.approx(1.5 * math.sqrt(3))
    clipped = gr.hex_grid_pointy(spark, (0, 0, 10, 8), 1.0, clip=True).agg(F.sum(crs.planar_area(F.col("geometry")))).first()[0]
    assert clipped == pytest.approx(80)
    edges = sj.edge_keys(cells.select(F.expr("row_number * 100 + col_number").alias("id"), "geometry"), 6).groupBy("key").count()
    assert edges.agg(F.max("count")).first()[0] == 2
    flat = gr.hex_grid_flat(spark, (10, 8, 0, 0), 1.0)
    assert flat.count() > 20 and flat.agg(F.avg(crs.planar_area(F.col("geometry")))).first()[0] == pytest.approx(1.5 * math.sqrt(3))
    sq = gr.square_grid(spark, (0, 0, 10, 8), 3, 3, clamp=True)
    assert sq.count() == 12 and sq.agg(F.sum(crs.planar_area(F.col("geometry")))).first()[0] == pytest.approx(80)
    with pytest.raises(ValueError):
        gr.square_grid(spark, (0, 0, 1, 1), 0, 1)


def test_make_grid_and_checks(spark):
    area = geometry(spark, [(1, [square(0, 0, 4)])])
    assert gr.make_grid(area, (0, 0, 4, 4), "square", cell_width=2, clip=True).agg(F.sum(crs.planar_area(F.col("geometry")))).first()[0] == pytest.approx(16)
    ids = [r.id for r in gr.make_grid(area, (0, 0, 4, 4), "hexagonal", cell_area=4.0).orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    for bad in ({"kind": "round", "cell_width": 1}, {"kind": "square"}):
        with pytest.raises(ValueError):
            gr.make_grid(area, (0, 0, 4, 4), **bad)
    with pytest.raises(ValueError):
        gr.import_grid_checks(spark.createDataFrame([(1,)], "PUID int"))
    assert gr.import_grid_checks(spark.createDataFrame([("1",), (None,), ("x",)], "puid string")).first()[0] == 1


def test_amounts_add_up_and_tiles_do_not_matter(spark):
    units = geometry(spark, [(i * 10 + j, [square(i, j)]) for i in range(6) for j in range(6)])
    l_shape = [(0.5, 0.5), (5, 0.5), (5, 2), (2, 2), (2, 5.5), (0.5, 5.5), (0.5, 0.5)]
    feature = geometry(spark, [(1, [l_shape, [(0.75, 0.75), (0.75, 1), (1, 1), (1, 0.75), (0.75, 0.75)]])]).select(F.col("id").alias("feature_id"), F.col("geometry").alias("other"))
    sums = [fe.polygon_amounts(feature, units, size).agg(F.sum("amount"), F.count("*")).first() for size in (0.7, 3.0, 100.0)]
    assert all(x[0] == pytest.approx(4.5 * 1.5 + 1.5 * 3.5 - 0.0625) and x[1] == sums[0][1] for x in sums)
    a, b = sj.boundary_lengths(units, 1.0), sj.boundary_lengths_general(units, 1.0, 2.0)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())
    assert a.where("boundary = 1").count() == 60 and a.where("boundary = 0").count() == 50
    assert sj.outer_boundary(units, 1.0).agg(F.sum("boundary")).first()[0] == 24
    with pytest.raises(ValueError):
        sj.spatial_join(units, feature, how="cross")


def test_cost_layer_edges(spark):
    units = spark.createDataFrame([(1, f"c{i}", float(i), 0) for i in range(101)] + [(2, "a", 5.0, 0), (2, "b", 5.0, 0), (3, "n", None, 0)], "project_id int, h3_index string, cost double, status int")
    rows = {(r.project_id, r.bin): r for r in pu.cost_layer(units).collect()}
    assert (rows[1, 0].low, rows[1, 0].high) == pytest.approx((-0.101, 11.111)) and (rows[1, 8].low, rows[1, 8].high) == pytest.approx((88.889, 100.0))
    assert [len(rows[1, b].ids) for b in range(9)] == [12, 11, 11, 11, 11, 11, 11, 11, 12]
    assert rows[2, 4].ids == ["a", "b"] and (3, 0) not in rows


def test_bins(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 9.0), (3, None)], "id int, v double")
    got = pu.equal_interval_bins(df, "v", 5).orderBy("bin").collect()
    assert [r.n_rows for r in got] == [1, 0, 0, 0, 1] and got[0].label == 2.0
    assert pu.equal_interval_bins(df.where("id = 1"), "v", 5).count() == 1
    assert pu.equal_interval_bins(df.limit(0), "v", 5).count() == 0


def test_upserts(spark):
    have = spark.createDataFrame([(1, 7, 0.1, 1.0)], "project_id long, feature_unique_id long, target_value double, spf double")
    ask = spark.createDataFrame([(1, "7, ,8,8", "0.5,,0.2,0.3", "2,,3,4")], "project_id long, ids string, targets string, spfs string")
    assert sorted(tuple(r) for r in fe.upsert_project_features(have, ask).collect()) == [(1, 7, 0.5, 2.0), (1, 8, 0.3, 4.0)]
    with pytest.raises(Exception, match="differ in length"):
        fe.upsert_project_features(have, spark.createDataFrame([(1, "7,8", "1", "1")], "project_id long, ids string, targets string, spfs string")).collect()
    free = pu.clone_names(spark.createDataFrame([(1, "a"), (2, "a_copy"), (3, "b")], "id int, name string"), spark.createDataFrame([(1,), (3,)], "id int"))
    assert sorted(tuple(r) for r in free.collect()) == [(1, "a_copy_copy"), (3, "b_copy")]


def test_sensitivities_given_twice(spark):
    m = spark.createDataFrame([("A", "P", "Low"), (None, "P", "High")], "code string, pressure string, level string")
    j = spark.createDataFrame([("A", "P", "High", 1)], "code string, pressure string, level string, pos int")
    with pytest.raises(Exception, match="twice"):
        ra.checked(ra.sensitivity_long(m, j)).collect()
    assert [tuple(r) for r in ra.checked(ra.sensitivity_long(m, j.limit(0))).collect()] == [("A", "p", 1)]


def test_rasters(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, float("nan")), ("a", 1, 0, 3.0), ("b", 0, 0, 2.0), ("b", 1, 1, None)], "layer string, r int, c int, v double")
    got = {(r.layer, r.r, r.c): r.v for r in ra.log_minmax(cells, ["layer"]).collect()}
    assert got == {("a", 0, 0): 0.0, ("a", 0, 1): 0.0, ("a", 1, 0): 1.0, ("b", 0, 0): 0.0, ("b", 1, 1): 0.0}
    same = (0.0, 2.0, 1.0, 1.0, 2, 2)
    assert {(r.r, r.c): r.v for r in ra.resample(cells.where("layer = 'a'"), same, same).collect()} == {(0, 0): 1.0, (1, 0): 3.0}
    assert ra.cumulative_impact(cells.limit(0), cells.limit(0), spark.createDataFrame([], "eco string, pressure string, score int")).count() == 0


def test_run_identities(spark):
    sol = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 0), (2, 3, 0)], "run int, planning_unit long, selected int")
    units = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "id long, cost double")
    bounds = spark.createDataFrame([(1, 2, 4.0), (2, 3, 2.0), (3, 3, 1.0)], "id1 long, id2 long, boundary double")
    amounts = spark.createDataFrame([(7, 1, 3.0), (7, 3, 5.0)], "species long, pu long, amount double")
    targets = spark.createDataFrame([(7, 4.0), (8, 0.0)], "id long, target double")
    f = rs.evaluate_features(sol, amounts, targets)
    assert sorted((r.run, r.id, r.held, r.met, r.mpm) for r in f.collect()) == [(1, 7, 3.0, False, 0.75), (1, 8, 0.0, True, 1.0), (2, 7, 0.0, False, 0.0), (2, 8, 0.0, True, 1.0)]
    got = {r.run: r for r in rs.evaluate_runs(sol, units, bounds, f, 0.5).collect()}
    assert (got[1].cost, got[1].connectivity_in, got[1].connectivity_edge, got[1].connectivity_out, got[1].score, got[1].shortfall) == (15, 4, 2, 1, 16, 1)
    assert got[2].cost == 0 and got[2].planning_units == 0 and got[2].connectivity_out == 7


def test_fe5_first_appearance(spark):
    layer = spark.createDataFrame([("MB12: x", 1), ("Na", 2), (None, 3), ("MC1", 4), ("MB12 y", 5), ("MC1", 6)], "code string, pos int")
    assert {r.code: r.id for r in fe.eunis_code_index(layer, "code", "pos").collect()} == {"MB12": 2, "MC1": 1}


def test_streams(spark, tmp_path):
    rows = [(1, 1, 5, "2024-01-01 00:00:00", "Running", 0), (2, 1, 5, "2024-01-01 00:01:00", "Stopped", 3), (3, 1, 5, "2024-01-01 00:02:00", "Killed", 4), (4, 2, 5, "2024-01-01 00:20:00", "Running", 1)]
    events = spark.createDataFrame(rows, "event_id long, pid long, user_id long, t string, status string, done int").withColumn("ts", F.to_timestamp("t")).drop("t")
    assert sorted((r.pid, r.status, r.done) for r in runs.latest_run_state(events).collect()) == [(1, "Stopped", 3), (2, "Running", 1)]
    events.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = runs.start_upsert(spark, live, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted((r.pid, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "Stopped"), (2, "Running")]
    windows = runs.runs_per_window(live).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    windows.awaitTermination(60)
    assert sorted((r.started, r.finished) for r in runs.runs_per_window(events).collect()) == [(1, 0), (1, 2)]


def test_run_states_over_batches_and_a_restart(spark, tmp_path):
    """Keyed state: repeated and late terminal events, a batch after a restart, and the same result as one pass over all events."""
    schema = "event_id long, pid long, status string, done int, ts timestamp"
    parts = [
        [(1, 1, "Running", 0, "00:00"), (2, 2, "Running", 1, "00:01"), (3, 3, "Running", 0, "00:02"), (9, None, "Running", 0, "00:02")],
        [(4, 1, "Stopped", 3, "00:10"), (5, 1, "Killed", 4, "00:12"), (6, 2, "Running", 5, "00:11"), (7, 3, "Completed", 9, "00:09")],
        [(4, 1, "Stopped", 3, "00:10"), (8, 1, "Killed", 2, "00:08"), (10, 3, "Running", 1, "00:20"), (11, 4, "Running", None, "00:21"), (12, 2, "Running", 4, "00:05")],
    ]
    every = []
    for rows in parts:
        made = spark.createDataFrame([(e, p, s_, d, f"2024-01-01 {t}:00") for e, p, s_, d, t in rows], "event_id long, pid long, status string, done int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        every.append(made)
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        runs.start_upsert(spark, live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        union = every[0]
        for more in every[1:]:
            union = union.unionByName(more)
        want = sorted((r.pid, r.status, r.done) for r in runs.latest_run_state(union.where("pid IS NOT NULL")).collect())
        assert sorted((r.pid, r.status, r.done) for r in runs.read_run_states(spark, str(tmp_path / "out")).collect()) == want
    changes = spark.read.parquet(str(tmp_path / "out")).groupBy("pid").count().collect()
    assert {r.pid: r["count"] for r in changes} == {1: 3, 2: 2, 3: 2, 4: 1}
    runs.compact_run_states(spark, str(tmp_path / "out"), str(tmp_path / "compact"))
    assert runs.read_run_states(spark, str(tmp_path / "compact")).count() == 4


def test_wkb_of_all_kinds(spark):
    import struct

    def polygon(order, *rings, z=False, srid=False):
        kind = 3 | (0x80000000 if z else 0) | (0x20000000 if srid else 0)
        body = struct.pack(order + "I", kind) + (struct.pack(order + "I", 4326) if srid else b"") + struct.pack(order + "I", len(rings))
        for r in rings:
            body += struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "d" * (3 if z else 2), *p, *([9.0] if z else [])) for p in r)
        return (b"\x01" if order == "<" else b"\x00") + body

    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    many = b"\x00" + struct.pack(">II", 6, 2) + polygon("<", sq(0, 4), sq(1, 2)) + polygon(">", sq(5, 6))
    rows = [(1, polygon("<", sq(0, 2))), (2, polygon(">", sq(0, 2), z=True)), (3, polygon("<", sq(0, 3), srid=True)), (4, many), (5, b"\x01" + struct.pack("<II", 6, 0)), (6, b"\x01" + struct.pack("<II", 3, 0)), (7, None), (8, b"")]
    rows += [(9, b"\x01" + struct.pack("<Idd", 1, 3.0, 4.0)), (10, b"\x01" + struct.pack("<Idd", 1, float("nan"), float("nan"))), (11, b"\x01" + struct.pack("<II", 7, 1) + many)]
    df = spark.createDataFrame(rows, "id long, raw binary")
    got = sorted((r.id, [len(x) for x in r.geometry], r.area) for r in geometry_io.from_wkb(df, "raw", "geometry").withColumn("area", crs.planar_area(F.col("geometry"))).collect())
    assert got == [(1, [5], 4.0), (2, [5], 4.0), (3, [5], 9.0), (4, [5], 1.0), (4, [5, 5], 15.0), (9, [1], 0.0), (11, [5], 1.0), (11, [5, 5], 15.0)]


def test_redo_reads_changed_places_alone(spark):
    """Equal to a full redo, and units that no changed site meets are not worked out again."""
    units = spark.range(400).select((F.col("id") % 2).alias("grid_id"), "id", crs.box_geometry(F.col("id") % 20, F.floor(F.col("id") / 20), F.col("id") % 20 + 1, F.floor(F.col("id") / 20) + 1).alias("geometry"))
    made = lambda rows: spark.createDataFrame(rows, "site_id long, iucn_cat string, x double").select("site_id", "iucn_cat", crs.box_geometry(F.col("x"), F.col("x"), F.col("x") + 1.5, F.col("x") + 1.5).alias("other"))
    old, new = made([(k, "a", float(k)) for k in range(15)]), made([(k, "b" if k == 3 else "a", float(k)) for k in range(14)] + [(99, "c", 17.0)])
    before = protected.protected_for_all(old, units)
    got = protected.redone_intersections(before, old, new, units)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, protected.protected_for_all(new, units).collect()))
    assert sorted(r.other[0][0].x for r in protected.changed_sites(old, new).collect()) == [3.0, 3.0, 14.0, 17.0]
    # An existing row far from any change is taken over as it is.
    odd = before.unionByName(spark.createDataFrame([(0, "kept", 9 * 21)], "grid_id long, iucn_cat string, puid long"))
    assert protected.redone_intersections(odd, old, new, units).where("iucn_cat = 'kept'").count() == 1
