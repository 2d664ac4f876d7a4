"""Rasters as sparse cell tables (layer, r, c, v), and cumulative impact."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atollkit.functions import crs
from atollkit.functions.scalars import fmt_date, replace_chars, sensitivity_score, stable_id
from atollkit.operators.grid import lattice
from atollkit.operators.spatial import points_in_polygons


def clamp_negative(cells: DataFrame) -> DataFrame:
    """Values below 0 become 0; NaN and null stay."""
    return cells.withColumn("v", F.when(F.col("v") < 0, 0.0).otherwise(F.col("v")))


def log_minmax(cells: DataFrame, by: list[str]) -> DataFrame:
    """ln(v + 1) scaled to 0..1 in each group; NaN, infinite and null values become 0, as does a group of equal values.

    Extremes come from an aggregate that is joined back, never from a window over all cells."""
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")) & (F.col("v") > -1)
    rows = cells.withColumn("l", F.when(ok, F.log1p("v")))
    ends = rows.groupBy(*by).agg(F.min("l").alias("least"), F.max("l").alias("most"))
    out = rows.join(ends, by) if by else rows.crossJoin(F.broadcast(ends))  # without groups one row
    scaled = F.try_divide(F.col("l") - F.col("least"), F.nullif(F.col("most") - F.col("least"), F.lit(0.0)))
    return out.withColumn("v", F.coalesce(scaled, F.lit(0.0))).select(cells.columns)


def resample(cells: DataFrame, src: tuple, dst: tuple, src_crs: str | None = None, dst_crs: str | None = None) -> DataFrame:
    """Bilinear values on another grid. A grid is (x0, y0, dx, dy, rows, cols) from the top left down.

    If the grids have different coordinates (names as in crs.forward), a target cell's centre is projected back to
    longitude and latitude and on to those of the source.

    Each target cell asks for the four source cells around its centre by their keys; weights of missing ones are left out
    and the rest add up to 1 again. Targets without any neighbour are left out (no data)."""
    sx, sy, sdx, sdy, _, _ = src
    tx, ty, tdx, tdy, rows, cols = dst
    target = lattice(cells.sparkSession, rows, cols).withColumnsRenamed({"row_number": "r", "col_number": "c"})
    target = target.select("r", "c", (tx + (F.col("c") + 0.5) * tdx).alias("x"), (ty - (F.col("r") + 0.5) * tdy).alias("y"))
    if src_crs != dst_crs:
        target = target.select("r", "c", crs.inverse(dst_crs, F.col("x"), F.col("y")).alias("p")).select("r", "c", crs.forward(src_crs, F.col("p.x"), F.col("p.y")).alias("p")).select("r", "c", "p.x", "p.y")
    asked = target.select("r", "c", ((F.col("x") - sx) / sdx - 0.5).alias("fx"), ((sy - F.col("y")) / sdy - 0.5).alias("fy"))
    wx, wy = F.col("fx") - F.floor("fx"), F.col("fy") - F.floor("fy")
    four = F.array(*(F.struct((F.floor("fy") + j).cast("int").alias("sr"), (F.floor("fx") + i).cast("int").alias("sc"), ((wx if i else 1 - wx) * (wy if j else 1 - wy)).alias("w")) for j in (0, 1) for i in (0, 1)))
    need = asked.select("r", "c", F.explode(four).alias("n")).select("r", "c", "n.sr", "n.sc", "n.w").where("w > 0")
    source = cells.where(F.col("v").isNotNull() & ~F.isnan("v")).select("layer", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    met = need.join(source, ["sr", "sc"])
    return met.groupBy("layer", "r", "c").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def best_fit_grid(spark: SparkSession, src: tuple, src_crs: str, dst_crs: str, points: int = 21) -> tuple:
    """The grid of square cells in other coordinates that suits a source grid: the box around its outline, of which `points` points a side are projected,
    at the resolution that keeps the number of cells along the diagonal."""
    x0, y0, dx, dy, rows, cols = src
    t = F.col("id") % points / (points - 1)
    side = F.floor(F.col("id") / points)
    x = F.when(side == 0, x0 + t * cols * dx).when(side == 1, x0 + cols * dx).when(side == 2, x0 + t * cols * dx).otherwise(F.lit(float(x0)))
    y = F.when(side == 0, F.lit(float(y0))).when(side == 2, y0 - rows * dy).otherwise(y0 - t * rows * dy)
    outline = spark.range(4 * points).select(crs.inverse(src_crs, x.cast("double"), y.cast("double")).alias("p")).select(crs.forward(dst_crs, F.col("p.x"), F.col("p.y")).alias("p"))
    left, low, right, high = outline.agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first()
    size = math.hypot(right - left, high - low) / math.hypot(cols, rows)
    count = lambda length: max(1, math.ceil(length / size - 1e-9))
    return left, high, size, size, count(high - low), count(right - left)


def reproject(cells: DataFrame, src: tuple, src_crs: str, dst_crs: str) -> tuple[DataFrame, tuple]:
    """(cells on the best-fit grid in other coordinates, that grid): bilinear values, as resample() gives them."""
    dst = best_fit_grid(cells.sparkSession, src, src_crs, dst_crs)
    return resample(cells, src, dst, src_crs, dst_crs), dst


def prepare_upload(cells: DataFrame, src: tuple, template: tuple, src_crs: str | None = None, crs_: str | None = None) -> DataFrame:
    """Negative values out, logarithm and scale, then the template's grid and coordinates."""
    return resample(log_minmax(clamp_negative(cells), ["layer"]), src, template, src_crs, crs_)


def pressures_by_layer(cells: DataFrame, pad: DataFrame, activity: str) -> DataFrame:
    """pressures() of each of several layers: (source, layer, r, c, v), layer being the pressure."""
    scores = pad.where(F.col("activity") == activity).select(replace_chars(F.col("pressure")).alias("name"), F.col("rppscore").cast("double").alias("w")).distinct()
    listed = scores.agg(F.collect_list(F.struct("name", "w")).alias("scores"))  # one row
    out = cells.where("v != 0").crossJoin(F.broadcast(listed)).select(F.col("layer").alias("source"), "r", "c", "v", F.explode("scores").alias("s"))
    return out.select("source", F.col("s.name").alias("layer"), "r", "c", (F.col("v") * F.col("s.w")).alias("v")).where("v != 0")


def pressures(cells: DataFrame, pad: DataFrame, activity: str) -> DataFrame:
    """A layer for each pressure of an activity: values times its score, zeros left out; layers are named after pressures."""
    scores = pad.where(F.col("activity") == activity).select(replace_chars(F.col("pressure")).alias("name"), F.col("rppscore").cast("double").alias("w")).distinct()
    # Scores of one activity, one for each of its pressures: a value meets them as an array of its own row, no join of all with all.
    listed = scores.agg(F.collect_list(F.struct("name", "w")).alias("scores"))
    out = cells.where("v != 0").crossJoin(F.broadcast(listed)).select("r", "c", "v", F.explode("scores").alias("s"))
    return out.select(F.col("s.name").alias("layer"), "r", "c", (F.col("v") * F.col("s.w")).alias("v")).where("v != 0")


def sensitivity_long(maresa: DataFrame, jncc: DataFrame) -> DataFrame:
    """(code, pressure, score) of both assessments: rows of maresa with a code; of jncc those with a pressure that is not
    local, the first of equal (code, pressure) by pos. Pressures are normalised; a pair that both hold is an error, raised
    by duplicates()."""
    m = maresa.where(F.col("code").isNotNull()).select("code", "pressure", "level")
    j = jncc.where(F.col("pressure").isNotNull() & ~F.col("pressure").contains("local")).groupBy("code", "pressure").agg(F.min_by("level", "pos").alias("level"))
    both = m.unionByName(j.select("code", "pressure", "level"))
    return both.select("code", replace_chars(F.col("pressure")).alias("pressure"), sensitivity_score(F.col("level")).alias("score"))


def checked(sens: DataFrame) -> DataFrame:
    """sens, raising on a (code, pressure) that occurs twice."""
    n = sens.groupBy("code", "pressure").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("sensitivity given twice: "), F.col("code"), F.lit(" "), F.col("pressure")))
    return n.select("code", "pressure", F.when(F.col("n") == 1, F.col("score")).otherwise(twice).alias("score"))


def sensitivity_matrix(sens: DataFrame, pressures_: list[str]) -> DataFrame:
    """A row a code and a column a pressure; 0 where nothing is known."""
    return sens.groupBy("code").pivot("pressure", pressures_).agg(F.first("score")).na.fill(0)


def extend_with_default(sens: DataFrame, labels: DataFrame, like: str = "VME") -> DataFrame:
    """sens with the rows of `like` for every label, in place of rows that the label had."""
    default = sens.where(F.col("code") == like).select("pressure", "score")
    new = labels.select(F.col("label").alias("code")).distinct().join(default, F.lit(True)).select("code", "pressure", "score")
    return sens.join(labels.select(F.col("label").alias("code")).distinct(), "code", "left_anti").select("code", "pressure", "score").unionByName(new)


def impact_sums(eco: DataFrame, stressors: DataFrame, sens: DataFrame) -> DataFrame:
    """(r, c, v): sum over ecosystems and pressures of eco * stressor * score, values rounded to 4 places half to even.

    Ecosystems are first summed by cell and pressure, so a cell's stressors meet one row a pressure instead of one for each
    pair of layers; zeros and unknown pairs drop out before any join."""
    w = sens.where("score != 0").select(F.col("eco").alias("layer"), "pressure", F.col("score").cast("double").alias("score"))
    e = eco.select("layer", "r", "c", F.bround("v", 4).alias("e")).where("e != 0").join(w, "layer")
    held = e.groupBy("r", "c", "pressure").agg(F.sum(F.col("e") * F.col("score")).alias("e"))
    s = stressors.select(F.col("layer").alias("pressure"), "r", "c", F.bround("v", 4).alias("s")).where("s != 0")
    return held.join(s, ["r", "c", "pressure"]).groupBy("r", "c").agg(F.sum(F.col("e") * F.col("s")).alias("v"))


def cumulative_impact(eco: DataFrame, stressors: DataFrame, sens: DataFrame) -> DataFrame:
    """impact_sums, logarithm and scale. Cells without any impact are left out of the sparse result (their value is 0)."""
    return log_minmax(impact_sums(eco, stressors, sens), [])


def mask_by_polygon(cells: DataFrame, polygons: DataFrame, grid: tuple) -> DataFrame:
    """Cells whose centre lies in any polygon."""
    x0, y0, dx, dy = grid[:4]
    points = cells.withColumns({"x": x0 + (F.col("c") + 0.5) * dx, "y": y0 - (F.col("r") + 0.5) * dy})
    return points_in_polygons(points, polygons.select("geometry"), geometries=False).select(cells.columns).distinct()


def cost_from_impact(cells: DataFrame, units: DataFrame, grid: tuple) -> DataFrame:
    """(id, cost): 100 + 100 * max(v, 0) of the cell that holds the unit's centroid; outside the grid 0."""
    x0, y0, dx, dy, rows, cols = grid
    m = crs.centroid(F.col("geometry"))
    at = units.select("id", m.alias("m")).select("id", F.floor((F.col("m.x") - x0) / dx).cast("int").alias("c"), F.floor((y0 - F.col("m.y")) / dy).cast("int").alias("r"))
    inside = F.col("c").between(0, cols - 1) & F.col("r").between(0, rows - 1)
    hit = at.join(cells.select("r", "c", F.greatest(F.col("v"), F.lit(0.0)).alias("v")), ["r", "c"], "left")
    return hit.select("id", F.when(inside, 100 + 100 * F.coalesce("v", F.lit(0.0))).otherwise(0.0).alias("cost"))


def costs_from_impacts(cells: DataFrame, units: DataFrame, grid: tuple) -> DataFrame:
    """cost_from_impact() of each of several layers: (layer, id, cost) for every layer and unit.

    Units meet the layers' cells by place; a unit's cost in layers without a cell there is that of a value of 0."""
    x0, y0, dx, dy, rows, cols = grid
    m = crs.centroid(F.col("geometry"))
    at = units.select("id", m.alias("m")).select("id", F.floor((F.col("m.x") - x0) / dx).cast("int").alias("c"), F.floor((y0 - F.col("m.y")) / dy).cast("int").alias("r"))
    layers = cells.agg(F.array_sort(F.collect_set("layer")).alias("layers"))  # one row, a name a layer
    every = at.crossJoin(F.broadcast(layers)).select("id", "r", "c", F.explode("layers").alias("layer"))
    hit = every.join(cells.select("layer", "r", "c", F.greatest(F.col("v"), F.lit(0.0)).alias("v")), ["layer", "r", "c"], "left")
    inside = F.col("c").between(0, cols - 1) & F.col("r").between(0, rows - 1)
    return hit.select("layer", "id", F.when(inside, 100 + 100 * F.coalesce("v", F.lit(0.0))).otherwise(0.0).alias("cost"))


def raster_extent(cells: DataFrame, grid: tuple) -> DataFrame:
    """The box of each layer's cells."""
    x0, y0, dx, dy = grid[:4]
    b = cells.groupBy("layer").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    return b.select("layer", (x0 + F.col("c0") * dx).alias("xmin"), (y0 - (F.col("r1") + 1) * dy).alias("ymin"), (x0 + (F.col("c1") + 1) * dx).alias("xmax"), (y0 - F.col("r0") * dy).alias("ymax"))


def activities(pad: DataFrame) -> DataFrame:
    """(activity, category, id) in order of first appearance: the first category, and an id from the name."""
    rows = pad.groupBy("activity").agg(F.min_by("category", "pos").alias("category"), F.min("pos").alias("pos"))
    return rows.select("activity", "category", stable_id(F.col("activity")).alias("id"), "pos").orderBy("pos").drop("pos")


def catalogue(meta: DataFrame, name: str) -> DataFrame:
    return meta.withColumn("creation_date", fmt_date(F.col("creation_date"))).orderBy(F.lower(name))
