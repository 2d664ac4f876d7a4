"""Features: import, registration, amounts in planning units, targets and catalogues."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atollkit.functions import crs, kernels
from atollkit.functions.geometry_udf import arrow_polygons, flat, lists_of_polygons, polygons
from atollkit.functions.overlay import Overlay, Shapes, nesting_reasons
from atollkit.functions.scalars import fmt_date, format_eunis, unique_feature_name
from atollkit.operators.grid import insert_if_absent
from atollkit.operators.spatial import overlap_areas, points_in_polygons, union_area


def split_layer(layer: DataFrame, field: str | None = None, name: str | None = None, source: str = "layer") -> DataFrame:
    """layer in one long table of features: one for each distinct non-null value of field, or one for all under name."""
    if field is None:
        return layer.withColumns({"feature_class_name": F.lit(name), "alias": F.lit(name), "description": F.lit(f"Imported from '{source}'")})
    rows = layer.where(F.col(field).isNotNull())
    alias = F.col(field).cast("string")
    return rows.withColumns({"feature_class_name": unique_feature_name("f_", alias), "alias": alias, "description": F.lit(f"Imported from '{source}' and split by '{field}' field")})


def register_polygon_features(layer: DataFrame, existing: DataFrame, size: float | None = None, metric: bool = False) -> DataFrame:
    """existing (feature_class_name, alias, _area, x0, y0, x1, y1, source) and the layer's features: dissolved area and box.

    With metric the layer is in degrees and areas are in square metres of EPSG:3410 (size is then in metres); the box stays in degrees. A
    feature whose alias exists already is left out."""
    by = ["feature_class_name", "alias"]
    flat = layer.withColumn("geometry", crs.to_ease_grid(F.col("geometry"))) if metric else layer
    made = union_area(flat, by, size).join(crs.envelope_agg(layer, "geometry", by), by)
    made = made.select(*by, F.col("area").alias("_area"), "x0", "y0", "x1", "y1", F.lit("Imported shapefile").alias("source"))
    return insert_if_absent(existing, made, "alias")


def register_point_features(layer: DataFrame) -> DataFrame:
    """Each feature of points (feature_class_name, x, y, value): the sum of values as area, and the box."""
    return layer.groupBy("feature_class_name").agg(F.sum("value").alias("_area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.lit("Imported shapefile (points)").alias("source"))


def import_by_code(layer: DataFrame, rejects: DataFrame, code: str, texts: list[str], size: float | None = None) -> DataFrame:
    """A row for each non-null code: dissolved area rounded to 2, box, the largest of three texts ('' for null), status and
    message. A code with any rejected part (rejects: code, reason) has failed; one group-by, no loop over codes."""
    rows = layer.where(F.col(code).isNotNull())
    area = union_area(rows.select(code, "geometry"), [code], size).select(code, F.round("area", 2).alias("area"))
    made = rows.groupBy(code).agg(*(F.coalesce(F.max(c), F.lit("")).alias(c) for c in texts))
    failed = rejects.groupBy(code).agg(F.min("reason").alias("message"))
    out = made.join(area, code, "left").join(crs.envelope_agg(rows, "geometry", [code]), code).join(failed, code, "left")
    return out.withColumn("status", F.when(F.col("message").isNull(), "success").otherwise("failed")).withColumn("description", F.coalesce(F.nullif(F.col(texts[0]), F.lit("")), F.lit("Imported EUNIS feature")))


def eunis_code_index(layer: DataFrame, code: str, order: str) -> DataFrame:
    """(code, id): formatted codes with a dense number by first appearance of the raw code, 'Na' and null left out; of raw
    codes with one formatted code the last number stays."""
    first = layer.where(F.col(code).isNotNull() & (F.col(code) != "Na")).groupBy(code).agg(F.min(order).alias("pos"))
    numbered = first.withColumn("id", (F.row_number().over(Window.orderBy("pos")) - 1).cast("long"))  # one row a code
    return numbered.groupBy(format_eunis(F.col(code)).alias("code")).agg(F.max("id").alias("id"))


def polygon_amounts(features: DataFrame, units: DataFrame, size: float | None = None, project: str | None = None, metric: bool = False) -> DataFrame:
    """(feature_id, id, amount): area of each feature (feature_id, other) within each unit (id, geometry), over 0; with project, a
    column of units, also that column. Any simple polygons will do, with holes or concave.

    With metric both are given in degrees and the amount is in square metres of EPSG:3410: the projection is a
    cylinder's, which keeps boxes boxes. Amounts add up before anything else is joined."""
    keys = ["feature_id", *([project] if project else []), "id"]
    flat = lambda df, c: df.withColumn(c, crs.to_ease_grid(F.col(c))) if metric else df
    pairs = overlap_areas(flat(units.select(*keys[1:], "geometry"), "geometry"), flat(features.select("feature_id", "other"), "other"), size=size)
    return pairs.groupBy(*keys).agg(F.sum("area").alias("amount"))


def point_amounts(points: DataFrame, units: DataFrame, size: float | None = None) -> DataFrame:
    """(feature_id, id, amount): sum of the values of a feature's points (feature_id, x, y, value) within each unit."""
    return points_in_polygons(points, units.select("id", "geometry"), size, geometries=False).groupBy("feature_id", "id").agg(F.sum("value").alias("amount"))


def replace_amounts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Amounts with those of new's (project_id, feature_id) put in place of the earlier ones."""
    keys = new.select("project_id", "feature_id").distinct()
    return existing.join(keys, ["project_id", "feature_id"], "left_anti").select(existing.columns).unionByName(new)


def feature_stats(amounts: DataFrame) -> DataFrame:
    """(id, pu_area, pu_count): sum of a feature's amounts and number of its units."""
    return amounts.groupBy(F.col("species").alias("id")).agg(F.sum("amount").alias("pu_area"), F.count("pu").alias("pu_count"))


def feature_targets(spec: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, target): share prop of the feature's total; a feature without amounts has target 0."""
    return spec.join(stats, "id", "left").select("id", (F.col("prop") * F.coalesce("pu_area", F.lit(0.0))).alias("target"))


def units_of_feature(puvspr: DataFrame, feature: int) -> DataFrame:
    return puvspr.where(F.col("species") == feature).select("pu").distinct()


def projects_of_feature(spec: DataFrame, feature: int) -> DataFrame:
    return spec.where(F.col("id") == feature).select("project_id").distinct()


def feature_catalogue(meta: DataFrame, feature: int | None = None) -> DataFrame:
    """The catalogue under its public names, one feature or all."""
    rows = meta if feature is None else meta.where(F.col("unique_id") == feature)
    return rows.select(F.col("unique_id").cast("long").alias("id"), F.col("feature_class_name").alias("name"), "alias", fmt_date(F.col("creation_date")).alias("creation_date"), "created_by")


def features_in_project(project_features: DataFrame, meta: DataFrame) -> DataFrame:
    """A project's feature settings with their metadata, null where there is none."""
    return project_features.join(meta.select(F.col("unique_id").alias("feature_unique_id"), "feature_class_name", "alias", "created_by"), "feature_unique_id", "left")


def upsert_project_features(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """existing (project_id, feature_unique_id, target_value, spf) with requests (project_id, ids, targets, spfs: parallel
    comma lists) put in. Lists of different lengths are an error; blank ids are skipped; the last of equal ids wins."""
    lists = requests.select("project_id", *(F.split(c, ",").alias(c) for c in ("ids", "targets", "spfs")))
    same = (F.size("ids") == F.size("targets")) & (F.size("ids") == F.size("spfs"))
    lists = lists.withColumn("ids", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids, targets and spfs differ in length"))))
    rows = lists.select("project_id", F.posexplode(F.arrays_zip("ids", "targets", "spfs")).alias("pos", "z")).where(F.trim("z.ids") != "")
    typed = rows.select("project_id", F.trim("z.ids").cast("long").alias("feature_unique_id"), F.struct("pos", F.trim("z.targets").cast("double").alias("target_value"), F.trim("z.spfs").cast("double").alias("spf")).alias("s"))
    new = typed.groupBy("project_id", "feature_unique_id").agg(F.max("s").alias("s")).select("project_id", "feature_unique_id", "s.target_value", "s.spf")
    return existing.join(new.select("project_id", "feature_unique_id"), ["project_id", "feature_unique_id"], "left_anti").select(existing.columns).unionByName(new)


def distinct_on_sensitivities(jncc: DataFrame) -> DataFrame:
    """(code, habitat): the first habitat in order for each non-null code."""
    return jncc.where(F.col("code").isNotNull()).groupBy("code").agg(F.min("habitat").alias("habitat"))


def countries(gaul: DataFrame, eez: DataFrame) -> DataFrame:
    """(name, iso3, has_marine) in order of name; joint territories (iso3 with |) left out."""
    marine = eez.select("iso3", F.lit(True).alias("m")).distinct()
    rows = gaul.where(~F.col("iso3").contains("|")).select("name", "iso3").distinct().join(marine, "iso3", "left")
    return rows.select("name", "iso3", F.coalesce("m", F.lit(False)).alias("has_marine")).orderBy("name")


def prune_unused(meta: DataFrame, used: DataFrame, key: str = "unique_id") -> DataFrame:
    """meta without rows that nothing uses; those of the global administrator stay."""
    system = meta.where("created_by = 'global admin'")
    return system.unionByName(meta.where("created_by != 'global admin' OR created_by IS NULL").join(used.select(F.col(used.columns[0]).alias(key)).distinct(), key, "left_semi").select(meta.columns))


def repair_and_check(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(sound rows with repaired geometry, rejects of key and reason). Repair drops repeated points, closes rings and
    turns them the right way. Rejected is what then has too few points, crosses itself, or has rings that cross or run along each other,
    lie outside the shell, or lie in each other."""
    def run(s: pa.Array) -> pa.Array:
        fixed = [kernels.repaired(g) if g is not None else [] for g in polygons(s)]
        reasons = [kernels.validity_reason(g) for g in fixed]
        whole = [i for i, r in enumerate(reasons) if r is None and len(fixed[i]) > 1]
        for i, reason in zip(whole, nesting_reasons([fixed[i] for i in whole]), strict=True):
            reasons[i] = reason
        return pa.StructArray.from_arrays([arrow_polygons(fixed), pa.array(reasons, pa.string())], ["geometry", "reason"])

    repair = F.arrow_udf(run, f"geometry {crs.GEOMETRY}, reason string")

    rows = df.withColumn("_r", repair("geometry"))
    return rows.where("_r.reason IS NULL").withColumn("geometry", F.col("_r.geometry")).drop("_r"), rows.where("_r.reason IS NOT NULL").select(key, F.col("_r.reason").alias("reason"))


def reasons(rejects: DataFrame, n: int = 10) -> DataFrame:
    """Up to n distinct reasons, for the message of a failed layer."""
    return rejects.select("reason").distinct().orderBy("reason").limit(n)


def split_at_dateline(df: DataFrame) -> DataFrame:
    """df with polygons that cross 180 degrees (an edge jumps over it) in several rows, those east and those west of it; with their holes."""
    def run(column: pa.Array) -> pa.Array:
        rows, ends, p = flat(column)
        jump = np.append(False, np.abs(np.diff(p[:, 0])) > 180) if len(p) else np.zeros(0, bool)
        jump[ends[:-1][ends[:-1] < len(p)]] = False
        row_of = np.searchsorted(ends[rows], np.flatnonzero(jump), "right") - 1
        across = np.unique(row_of)
        out = [None if g is None else [g] for g in polygons(column)]
        if len(across):
            east = np.stack([np.where(p[:, 0] < 0, p[:, 0] + 360, p[:, 0]), p[:, 1]], 1)
            shapes = Shapes(rows, ends, east)
            low, high = p[:, 1].min() - 1, p[:, 1].max() + 1
            halves = np.array([[(x, low), (x + 180, low), (x + 180, high), (x, high), (x, low)] for x in (0.0, 180.0)]).reshape(-1, 2)
            cut = Overlay(shapes, Shapes(np.array([0, 1, 2]), np.array([0, 5, 10]), halves), np.repeat(across, 2), np.tile([0, 1], len(across))).polygons()
            for k, i in enumerate(across.tolist()):
                out[i] = cut[2 * k] + [[r - np.array([360.0, 0.0]) for r in g] for g in cut[2 * k + 1]]
        return lists_of_polygons(out)

    split = F.arrow_udf(run, f"array<{crs.GEOMETRY}>")
    others = [c for c in df.columns if c != "geometry"]
    return df.where(F.col("geometry").isNotNull()).select(*others, F.explode(split("geometry")).alias("geometry"))
