"""Solver runs: solutions, their evaluation, and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atollkit.operators.projects import group_ids


def solution_units(solutions: DataFrame, run: int | None = None, nested: bool = True) -> DataFrame:
    """(run, selected, ids): units by value, 0 dropped."""
    rows = solutions.where("selected != 0") if run is None else solutions.where((F.col("run") == run) & (F.col("selected") != 0))
    return rows.groupBy("run", "selected").agg(F.array_sort(F.collect_list("planning_unit")).alias("ids")) if nested else rows.select("run", "selected", "planning_unit")


def missing_values(mv: DataFrame) -> DataFrame:
    return mv.select("run", "feature", "target", "held", "target_met", "mpm")


def summed_solution(solutions: DataFrame) -> DataFrame:
    """(planning_unit, number): how many runs select each unit."""
    return solutions.groupBy("planning_unit").agg(F.sum("selected").alias("number"))


def summed_by_number(summed: DataFrame, nested: bool = True) -> DataFrame:
    """(number, ids), 0 dropped."""
    return group_ids(summed, "number", "planning_unit", nested=nested)


def best_run(summary: DataFrame, mv: DataFrame) -> DataFrame:
    """The rows of mv for the run with the lowest score, ties to the lower number."""
    best = summary.agg(F.min(F.struct("score", "run")).alias("s")).select(F.col("s.run").alias("run"))
    return mv.join(F.broadcast(best), "run", "left_semi")  # one row


def held_amounts(solutions: DataFrame, puvspr: DataFrame) -> DataFrame:
    """(run, id, held, occurrences) of features in each run's selected units."""
    chosen = solutions.where("selected = 1").select("run", F.col("planning_unit").alias("pu"))
    return chosen.join(puvspr, "pu").groupBy("run", F.col("species").alias("id")).agg(F.sum("amount").alias("held"), F.count("*").alias("occurrences"))


def evaluate_features(solutions: DataFrame, puvspr: DataFrame, targets: DataFrame) -> DataFrame:
    """(run, id, target, held, occurrences, met, mpm) of every feature in every run; absent features hold 0.

    mpm is held / target, 1 at most, and 1 where the target is 0."""
    runs = solutions.select("run").distinct()
    all_ = targets.select("id", "target").join(runs, F.lit(True))  # features x runs is the result's size
    rows = all_.join(held_amounts(solutions, puvspr), ["run", "id"], "left")
    held = F.coalesce("held", F.lit(0.0))
    mpm = F.least(F.lit(1.0), F.coalesce(F.try_divide(held, F.nullif(F.col("target"), F.lit(0.0))), F.lit(1.0)))
    return rows.select("run", "id", "target", held.alias("held"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), (held >= F.col("target")).alias("met"), mpm.alias("mpm"))


def evaluate_runs(solutions: DataFrame, units: DataFrame, bounds: DataFrame, features: DataFrame, blm: float, penalties: DataFrame | None = None) -> DataFrame:
    """A row a run: cost, planning_units, shortfall, missing_values, mpm, connectivity (in, edge, out, total, in_fraction),
    penalty and score = cost + blm * edge + penalty. features is evaluate_features' result, penalties (run, penalty).

    Boundaries meet each run's selected units at both ends; what no end selects is the rest of the total."""
    chosen = solutions.where("selected = 1").select("run", F.col("planning_unit").alias("id"))
    costs = chosen.join(units.select("id", "cost").hint("merge"), "id").groupBy("run").agg(F.sum("cost").alias("cost"), F.count("*").alias("planning_units"))
    ends = bounds.select(F.col("id1").alias("id"), "id1", "id2", "boundary").unionByName(bounds.where("id1 != id2").select(F.col("id2").alias("id"), "id1", "id2", "boundary"))
    hits = ends.join(chosen, "id").groupBy("run", "id1", "id2").agg(F.max("boundary").alias("boundary"), F.count("*").alias("n"))
    links = hits.groupBy("run").agg(F.sum(F.when(F.col("n") == 2, F.col("boundary")).otherwise(0.0)).alias("connectivity_in"), F.sum(F.when(F.col("n") == 1, F.col("boundary")).otherwise(0.0)).alias("connectivity_edge"))
    total = bounds.agg(F.coalesce(F.sum("boundary"), F.lit(0.0)).alias("connectivity_total"))
    f = features.groupBy("run").agg(F.sum(F.greatest(F.lit(0.0), F.col("target") - F.col("held"))).alias("shortfall"), F.sum((~F.col("met")).cast("long")).alias("missing_values"), F.min("mpm").alias("mpm"))
    runs = solutions.select("run").distinct().join(F.broadcast(total))  # one row
    rows = runs.join(costs, "run", "left").join(links, "run", "left").join(f, "run", "left")
    rows = rows.join(penalties, "run", "left") if penalties is not None else rows.withColumn("penalty", F.lit(0.0))
    rows = rows.na.fill(0.0, ["cost", "connectivity_in", "connectivity_edge", "penalty", "shortfall"]).na.fill(0, ["planning_units", "missing_values"])
    out = F.col("connectivity_total") - F.col("connectivity_in") - F.col("connectivity_edge")
    fraction = F.coalesce(F.try_divide(F.col("connectivity_in"), F.col("connectivity_total")), F.lit(0.0))
    return rows.withColumns({"connectivity_out": out, "connectivity_in_fraction": fraction, "score": F.col("cost") + blm * F.col("connectivity_edge") + F.col("penalty")})


def run_progress(run_log: DataFrame, files: DataFrame) -> DataFrame:
    """run_log with runs 'found/required' for running rows; files (user_id, project_id, found, required)."""
    rows = run_log.join(files, ["user_id", "project_id"], "left")
    text = F.concat_ws("/", F.coalesce("found", F.lit(0)).cast("string"), F.coalesce("required", F.lit(0)).cast("string"))
    return rows.withColumn("runs", F.when(F.col("status") == "Running", text).otherwise(F.col("runs"))).select(run_log.columns)


def close_run(run_log: DataFrame, ends: DataFrame) -> DataFrame:
    """run_log with the ends (pid, endtime, done, required) written: runtime in whole seconds, runs done/required; the status
    changes for running rows alone: Completed if all runs are done, else Killed."""
    rows = run_log.join(ends, "pid", "left")
    ended = F.col("endtime").isNotNull()
    status = F.when(ended & (F.col("status") == "Running"), F.when(F.col("done") == F.col("required"), "Completed").otherwise("Killed")).otherwise(F.col("status"))
    seconds = F.unix_timestamp("endtime") - F.unix_timestamp("starttime")
    return rows.select("pid", "user_id", "project_id", "starttime", "endtime", F.when(ended, F.concat(seconds.cast("string"), F.lit("s"))).alias("runtime"), F.when(ended, F.concat_ws("/", F.col("done").cast("string"), F.col("required").cast("string"))).alias("runs"), status.alias("status"))


def already_running(run_log: DataFrame, user: int, project: int) -> DataFrame:
    return run_log.where((F.col("user_id") == user) & (F.col("project_id") == project) & (F.col("status") == "Running"))


def clear_log(run_log: DataFrame) -> DataFrame:
    return run_log.where("pid = -1")
