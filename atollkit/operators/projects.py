"""Projects and their planning units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atollkit.functions.scalars import area_from_alias, fmt_date


def populate_units(projects: DataFrame, grids: DataFrame, cells: DataFrame, existing: DataFrame, match_resolution: bool = False) -> DataFrame:
    """New (project_id, h3_index, cost, status) of all projects: the cells of each project's grid that it lacks.

    Areas are few, so an area's cells are dealt out to `parts` groups, each with the area's projects: no task holds a whole area, or a whole small file."""
    parts = 64
    g = grids.select(F.col("unique_id").alias("planning_unit_id"), area_from_alias(F.col("alias")).alias("area"), F.col("resolution").alias("g_res"))
    c = cells.select("h3_index", "cost", "status", F.lower(F.trim("project_area")).alias("area"), "resolution", F.pmod(F.xxhash64("h3_index"), F.lit(parts)).cast("int").alias("part"))
    own = projects.select(F.col("id").alias("project_id"), "planning_unit_id").join(g, "planning_unit_id")
    rows = c.join(own.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).hint("merge"), ["area", "part"])
    rows = rows.where("resolution = g_res") if match_resolution else rows
    return rows.select("project_id", "h3_index", "cost", "status").dropDuplicates(["project_id", "h3_index"]).join(existing.select("project_id", "h3_index").hint("merge"), ["project_id", "h3_index"], "left_anti")


def group_ids(df: DataFrame, key: str, id: str, drop_zero: bool = True, nested: bool = True) -> DataFrame:
    """(key, ids) with ids in ascending order, or with nested off the long form (key, id), the one for large groups: a list is one row
    of one task. Key 0 is dropped if asked for."""
    rows = df.where(F.col(key) != 0) if drop_zero else df
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(id)).alias("ids")) if nested else rows.select(key, id)


def group_by_status(units: DataFrame, nested: bool = True) -> DataFrame:
    """(status, ids), or (status, h3_index) with nested off: null counts as 0, and 0 stays."""
    return group_ids(units.withColumn("status", F.coalesce(F.col("status").cast("int"), F.lit(0))), "status", "h3_index", drop_zero=False, nested=nested)


def equal_interval_bins(df: DataFrame, col: str, n: int, clamp: bool = False, id: str = "id") -> DataFrame:
    """(bin, label, n_rows, low, high) of equal intervals, empty ones too: size (max + 1 - min) / n, one bin if min = max;
    label is the upper edge. With clamp what lies beyond falls in the last bin. Global extremes come from an aggregate."""
    ends = df.agg(F.min(col).alias("low"), F.max(col).alias("high")).where("low IS NOT NULL")
    ends = ends.withColumn("n", F.when(F.col("low") == F.col("high"), 1).otherwise(n)).withColumn("size", (F.col("high") + 1 - F.col("low")) / F.col("n"))
    at = F.floor((F.col(col) - F.col("low")) / F.col("size")).cast("int")
    rows = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(ends)).select((F.least(at, F.col("n") - 1) if clamp else at).alias("bin"))
    counts = rows.groupBy("bin").agg(F.count("*").alias("c"))
    all_ = ends.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"), "low", "high", "size")
    return all_.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("size") * (F.col("bin") + 1)).alias("label"), F.coalesce("c", F.lit(0)).alias("n_rows"), "low", "high")


def cost_layer(units: DataFrame, n: int = 9, nested: bool = True) -> DataFrame:
    """(project_id, bin, low, high, ids, least, most) of costs in n right-closed bins of equal width for each project; with nested off
    a row for each unit, with h3_index in place of ids.

    The lowest bin takes the least value too; if all costs are equal the edges lie 0.1 % of it (0.001 at 0) to both sides.
    low and high are the edges rounded to the fewest decimals (3 significant digits below 1) at which all differ, the lowest
    another unit of that place down. Only bins with units are listed; values are compared with computed edges."""
    ends = units.groupBy("project_id").agg(F.min("cost").alias("least"), F.max("cost").alias("most"))
    same = F.col("least") == F.col("most")
    wide = F.when(F.col("most") == 0, 0.001).otherwise(F.abs(F.col("most")) * 0.001)
    ends = ends.withColumns({"a": F.when(same, F.col("least") - wide).otherwise(F.col("least")), "b": F.when(same, F.col("most") + wide).otherwise(F.col("most"))})
    edges = ends.withColumn("e", F.expr(f"transform(sequence(0, {n}), _k -> CASE WHEN _k = 0 AND least < most THEN a - (b - a) * 0.001 WHEN _k = {n} THEN b ELSE a + _k * ((b - a) / {n}) END)"))
    shown = lambda p: _labels("e", p)
    edges = edges.withColumn("shown", F.coalesce(*(F.when(F.size(F.array_distinct(shown(p))) == n + 1, F.struct(shown(p).alias("s"), F.lit(10.0**-p).alias("u"))) for p in range(3, 16)), F.struct(F.col("e").alias("s"), F.lit(0.0).alias("u"))))
    rows = units.where(F.col("cost").isNotNull()).join(edges, "project_id")
    at = F.greatest(F.lit(0), F.size(F.filter("e", lambda x: x < F.col("cost"))) - 1)
    low = F.get("shown.s", F.col("bin")) - F.when(F.col("bin") == 0, F.col("shown.u")).otherwise(0.0)
    shape = lambda df, ids: df.select("project_id", "bin", F.round(low, 12).alias("low"), F.get("shown.s", F.col("bin") + 1).alias("high"), ids, "least", "most")
    if not nested:
        return shape(rows.withColumn("bin", at), "h3_index")
    out = rows.withColumn("bin", at).groupBy("project_id", "bin").agg(F.array_sort(F.collect_list("h3_index")).alias("ids"), F.first("shown").alias("shown"), F.first("least").alias("least"), F.first("most").alias("most"))
    return shape(out, "ids")


def _labels(e: str, p: int):
    """Edges rounded to p decimals, those below 1 to p significant digits."""
    def one(x):
        digits = F.when((x == 0) | (F.abs(x) >= 1), F.lit(p)).otherwise(F.lit(p - 1) - F.floor(F.log10(F.abs(x))).cast("int"))
        scale = F.pow(F.lit(10.0), digits)
        return F.rint(x * scale) / scale

    return F.transform(e, one)


def project_units(project_pus: DataFrame, cells: DataFrame, projects: DataFrame, grids: DataFrame, resolution: int) -> DataFrame:
    """Units of projects with their cells, where the cell has the resolution and its area is that of the project's grid."""
    g = projects.select(F.col("id").alias("project_id"), "planning_unit_id").join(grids.select(F.col("unique_id").alias("planning_unit_id"), area_from_alias(F.col("alias")).alias("area")), "planning_unit_id")
    c = cells.where(F.col("resolution") == resolution).select("h3_index", F.lower(F.trim("project_area")).alias("area"), "resolution")
    return project_pus.join(c, "h3_index").join(g, ["project_id", "area"]).select("project_id", "h3_index", "resolution", "cost", "status", "area")


def status_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("status").agg(F.count("*").alias("n"))


def unit_detail(units: DataFrame, project_features: DataFrame, amounts: DataFrame, meta: DataFrame) -> DataFrame:
    """(project_id, h3_index, cost, alias, amount): every feature of the unit's project, with its amount or null.

    The result has a row for each pair of a unit and a feature of its project, so pairs are made last and never shuffled. A project's
    features stand in arrays of about `wide`; its units are dealt out to `parts` groups, each with those arrays. A unit takes along what it
    holds of its project's features: that alone has amounts, and each array is opened but for it."""
    parts, wide, tasks = 64, 512, 2 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = project_features.select("project_id", "feature_unique_id").join(meta.select(F.col("unique_id").alias("feature_unique_id"), "alias").hint("merge"), "feature_unique_id").select("project_id", "feature_unique_id", "alias")
    own = amounts.select("project_id", "h3_index", "feature_unique_id", "amount").join(f.hint("shuffle_hash"), ["project_id", "feature_unique_id"])  # amounts are not sorted for it
    held = own.groupBy("project_id", "h3_index").agg(F.collect_list(F.struct("feature_unique_id", "alias", "amount")).alias("held"))
    u = units.select("project_id", "h3_index", F.coalesce("cost", F.lit(0.0)).alias("cost")).join(held.hint("merge"), ["project_id", "h3_index"], "left")
    counts = f.groupBy("project_id").agg(F.ceil(F.count("*") / wide).alias("n"))
    arrays = f.join(counts.hint("merge"), "project_id").withColumn("at", F.pmod(F.xxhash64("feature_unique_id", "alias"), "n"))
    arrays = arrays.groupBy("project_id", "at").agg(F.collect_list(F.struct("feature_unique_id", "alias")).alias("listed"))
    # Partitions are small where their pairs are many: stated, so that Spark does not join them.
    arrays = arrays.select("project_id", "listed", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(tasks, "project_id", "part")
    dealt = u.select("project_id", "h3_index", "cost", F.col("held.feature_unique_id").alias("has"), F.pmod(F.xxhash64("h3_index"), F.lit(parts)).cast("int").alias("part")).repartition(tasks, "project_id", "part")
    pairs = dealt.join(arrays.hint("merge"), ["project_id", "part"]).select("project_id", "h3_index", "cost", "has", F.inline("listed"))
    empty = pairs.where(F.col("has").isNull() | ~F.array_contains("has", F.col("feature_unique_id"))).select("project_id", "h3_index", "cost", "alias", F.lit(None).cast(amounts.schema["amount"].dataType).alias("amount"))
    return u.select("project_id", "h3_index", "cost", F.inline("held")).select("project_id", "h3_index", "cost", "alias", "amount").unionByName(empty)


def update_status(units: DataFrame, edits: DataFrame) -> DataFrame:
    """units of edited projects set to 0 and then to the edits (project_id, h3_index, status), the higher winning; units of
    other projects stay as they are."""
    new = edits.groupBy("project_id", "h3_index").agg(F.max("status").alias("new"))
    touched = edits.select("project_id", F.lit(True).alias("touched")).distinct()
    rows = units.join(new, ["project_id", "h3_index"], "left").join(touched, "project_id", "left")
    return rows.withColumn("status", F.when(F.col("touched"), F.coalesce("new", F.lit(0))).otherwise(F.col("status"))).select(units.columns)


def apply_cost_profile(units: DataFrame, name: str, costs: DataFrame | None = None) -> DataFrame:
    """units with cost 1 for 'Equal area', else with the costs (id, cost) of the profile, joined by id."""
    if name == "Equal area":
        return units.withColumn("cost", F.lit(1.0))
    if costs is None:
        raise ValueError(f"unknown cost profile {name!r}")
    return units.drop("cost").join(costs.select("id", "cost"), "id", "left").select(units.columns)


def cost_profiles(projects: DataFrame, costs: DataFrame) -> DataFrame:
    """(project_id, profile): 'Equal area' for all, 'Custom' for projects with costs."""
    ids = projects.select(F.col("id").alias("project_id"))
    own = ids.join(costs.select("project_id").distinct(), "project_id", "left_semi")
    return ids.withColumn("profile", F.lit("Equal area")).unionByName(own.withColumn("profile", F.lit("Custom")))


def projects_of_user(projects: DataFrame, members: DataFrame, user: int, last_project: int | None = None) -> DataFrame:
    """A user's projects with the role, in order of the lower-case name; selected marks the last project, or the first listed."""
    rows = members.where(F.col("user_id") == user).select(F.col("project_id").alias("id"), "role").join(projects, "id")
    top = rows.agg(F.coalesce(F.max(F.when(F.col("id") == last_project, F.col("id"))), F.min_by("id", F.lower("name"))).alias("top"))
    return rows.join(F.broadcast(top)).select("id", "name", "role", (F.col("id") == F.col("top")).alias("selected")).orderBy(F.lower("name"))


def first_project(projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, id): each user's earliest project, ties to the smaller id."""
    rows = members.select("user_id", F.col("project_id").alias("id")).join(projects.select("id", "created"), "id")
    return rows.groupBy("user_id").agg(F.min(F.struct("created", "id")).alias("s")).select("user_id", "s.id")


def projects_of_grid(params: DataFrame, grid: str) -> DataFrame:
    return params.where((F.col("key") == "PLANNING_UNIT_NAME") & (F.col("value") == grid)).select("project_id").distinct()


def projects_with_grids(params: DataFrame, grids: DataFrame) -> DataFrame:
    """(project_id, grid, unique_id) of every project; null where its grid is unknown."""
    p = params.where("key = 'PLANNING_UNIT_NAME'").select("project_id", F.col("value").alias("grid"))
    return p.join(grids.select(F.col("feature_class_name").alias("grid"), "unique_id"), "grid", "left").select("project_id", "grid", "unique_id")


def project_bundle(projects: DataFrame, params: DataFrame, features: DataFrame, grids: DataFrame) -> DataFrame:
    """A nested row a project: its grid, the map of its parameters and the array of its features.

    Children are gathered by project before they are joined, so rows do not fan out."""
    p = params.groupBy(F.col("project_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("parameters"))
    f = features.groupBy(F.col("project_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("feature_unique_id", "target_value", "spf"))).alias("features"))
    g = grids.select(F.col("unique_id").alias("planning_unit_id"), F.col("alias").alias("grid_alias"), "planning_unit_count")
    return projects.join(g, "planning_unit_id", "left").join(p, "id", "left").join(f, "id", "left")


def whole_bundle(projects: DataFrame, params: DataFrame, files: DataFrame, renderer: DataFrame, features: DataFrame, grids: DataFrame) -> DataFrame:
    """All that is shown of a project, a nested row each: run_parameters (key, value in the order of keys), files (type to name), renderer (key to value),
    features, and grid with all columns of grids (unique_id, alias, country, ...).

    Children are gathered by project before they are joined, so rows do not fan out; projects without a child have null there."""
    listed = lambda df, name, *cols: df.groupBy(F.col("project_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    mapped = lambda df, name, key, value: df.groupBy(F.col("project_id").alias("id"), key).agg(F.min(value).alias(value)).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    parts = [listed(params, "run_parameters", "key", "value"), mapped(files, "files", "file_type", "file_name"), mapped(renderer, "renderer", "key", "value"), listed(features, "features", "feature_unique_id", "target_value", "spf")]
    out = projects.join(grids.select(F.col("unique_id").alias("planning_unit_id"), F.struct(*grids.columns).alias("grid")), "planning_unit_id", "left")
    for part in parts:
        out = out.join(part, "id", "left")
    return out


def scenario_group(params: DataFrame, blm: list[float], step: int) -> DataFrame:
    """A copy of every project's parameters for each value: ids move on by i * step, BLM is the value, NUMREPS 1."""
    n = F.posexplode(F.array(*(F.lit(str(b)) for b in blm))).alias("i", "blm")
    rows = params.select("*", n)
    value = F.when(F.col("key") == "BLM", F.col("blm")).when(F.col("key") == "NUMREPS", "1").otherwise(F.col("value"))
    return rows.select((F.col("project_id") + (F.col("i") + 1) * step).alias("project_id"), "key", value.alias("value"))


def clone_names(projects: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, name) for clones of the projects: _copy is added until the name is free, however often that is."""
    root = F.regexp_replace("name", "(_copy)+$", "")
    copies = ((F.length("name") - F.length(root)) / 5).cast("int")
    taken = projects.select(root.alias("root"), copies.alias("taken")).distinct()
    asked = projects.join(ids, "id").select("id", "name", root.alias("root"), copies.alias("copies")).distinct()
    more = asked.join(taken, "root").where(F.col("taken") > F.col("copies")).select("id", "name", (F.col("taken") - F.col("copies")).alias("k"))
    place = F.row_number().over(Window.partitionBy("id", "name").orderBy("k"))
    run = more.withColumn("place", place).where("k = place").groupBy("id", "name").agg(F.max("k").alias("k"))  # names taken without a gap
    free = asked.join(run, ["id", "name"], "left").withColumn("k", F.coalesce("k", F.lit(0)) + 1)
    return free.groupBy("id").agg(F.min_by(F.expr("concat(name, repeat('_copy', k))"), "k").alias("name"))


def cloned(projects: DataFrame, params: DataFrame, ids: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(projects, params) with clones of the projects in ids (id, new_id): a free name, and the parameters with a new DESCRIPTION and
    CREATEDATE (now: a timestamp, by default the present one)."""
    named = projects.join(ids, "id").join(clone_names(projects, ids).withColumnRenamed("name", "_free"), "id")
    rows = named.withColumns({"id": F.col("new_id"), "name": F.col("_free")}).select(projects.columns)
    said = F.concat(F.lit("Clone of project '"), F.col("name"), F.lit("'"))
    about = projects.join(ids, "id").select(F.col("id").alias("project_id"), "new_id", said.alias("_said"))
    fresh = F.when(F.col("key") == "DESCRIPTION", F.col("_said")).when(F.col("key") == "CREATEDATE", fmt_date(F.current_timestamp() if now is None else now)).otherwise(F.col("value"))
    copies = params.join(about, "project_id").where("key NOT IN ('DESCRIPTION', 'CREATEDATE')").withColumns({"project_id": F.col("new_id")}).select(params.columns)
    keys = about.select("*", F.explode(F.array(F.lit("DESCRIPTION"), F.lit("CREATEDATE"))).alias("key")).withColumn("value", F.lit(None).cast("string"))
    added = keys.withColumn("value", fresh).select(F.col("new_id").alias("project_id"), "key", "value", *(F.lit(None).cast(t).alias(c) for c, t in params.dtypes if c not in ("project_id", "key", "value")))
    return projects.unionByName(rows), params.unionByName(copies).unionByName(added.select(params.columns))


def clone_projects(table: DataFrame, ids: DataFrame, key: str = "project_id") -> DataFrame:
    """table with the rows of the projects in ids (id, new_id) once more under their new ids."""
    copies = table.join(ids.select(F.col("id").alias(key), "new_id"), key).withColumn(key, F.col("new_id")).select(table.columns)
    return table.unionByName(copies)


def set_parameters(params: DataFrame, updates: DataFrame) -> DataFrame:
    """params with the values of updates (project_id, key, value) for keys that exist already; exact keys.

    Both sides are dealt out to all shuffle partitions: keys compress so well that Spark would else put together far more rows than a task can sort."""
    n = int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new = updates.select("project_id", "key", F.col("value").alias("new")).repartition(n, "project_id", "key").hint("merge")
    return params.repartition(n, "project_id", "key").join(new, ["project_id", "key"], "left").withColumn("value", F.coalesce("new", "value")).select(params.columns)


def add_parameter(params: DataFrame, key: str, value: str) -> DataFrame:
    """params with the key set in every project, whether it was there or not."""
    others = params.where(F.col("key") != key).select("project_id", "key", "value")
    return others.unionByName(params.select("project_id").distinct().select("project_id", F.lit(key).alias("key"), F.lit(value).alias("value")))


def project_list(projects: DataFrame, params: DataFrame) -> DataFrame:
    """(id, name, description, is_private, blm) with defaults; names that begin with __ are skipped; in order of the name."""
    wide = params.groupBy(F.col("project_id").alias("id")).pivot("key", ["DESCRIPTION", "PRIVATE", "BLM"]).agg(F.min("value"))
    rows = projects.where(~F.col("name").startswith("__")).join(wide, "id", "left")
    return rows.select("id", "name", F.coalesce("DESCRIPTION", F.lit("No description")).alias("description"), (F.coalesce("PRIVATE", F.lit("False")) == "True").alias("is_private"), F.coalesce("BLM", F.lit("0")).alias("blm")).orderBy("name")

