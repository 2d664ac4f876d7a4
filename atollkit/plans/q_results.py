"""Queries of solver runs and run events."""

from pyspark.sql import functions as F

from atollkit.operators import features as f
from atollkit.operators import results as r
from atollkit.plans.domain import query
from atollkit.streaming import runs

STATS = "SELECT species AS id, SUM(amount) AS pu_area, COUNT(*) AS pu_count FROM puvspr GROUP BY species"
TARGETS = f"SELECT s.id, s.prop * COALESCE(x.pu_area, 0) AS target FROM spec s LEFT JOIN ({STATS}) x ON x.id = s.id"
HELD = "SELECT s.run, p.species AS id, SUM(p.amount) AS held, COUNT(*) AS occurrences FROM solutions s JOIN puvspr p ON p.pu = s.planning_unit WHERE s.selected = 1 GROUP BY s.run, p.species"
EVALUATED = f"SELECT r.run, t.id, t.target, COALESCE(h.held, 0) AS held, COALESCE(h.occurrences, 0) AS occurrences, COALESCE(h.held, 0) >= t.target AS met, least(1.0, COALESCE(COALESCE(h.held, 0) / NULLIF(t.target, 0), 1.0)) AS mpm FROM ({TARGETS}) t CROSS JOIN (SELECT DISTINCT run FROM solutions) r LEFT JOIN ({HELD}) h ON h.run = r.run AND h.id = t.id"


def targets(t):
    return f.feature_targets(t("spec"), f.feature_stats(t("puvspr")))


def evaluated(t):
    return r.evaluate_features(t("solutions"), t("puvspr"), targets(t))


@query("rs1_solution_units", "SELECT run, selected, COUNT(*) AS n, MIN(planning_unit) AS first, MAX(planning_unit) AS last FROM solutions WHERE selected != 0 GROUP BY run, selected")
def rs1(t):
    rows = r.solution_units(t("solutions"), nested=False)
    return rows.groupBy("run", "selected").agg(F.count("*").alias("n"), F.min("planning_unit").alias("first"), F.max("planning_unit").alias("last"))


@query("rs2_missing_values", f"SELECT run, id AS feature, round(target, 4) AS target, held, CASE WHEN met THEN 'yes' ELSE 'no' END AS target_met, round(mpm, 6) AS mpm FROM ({EVALUATED}) e")
def rs2(t):
    mv = evaluated(t).select("run", F.col("id").alias("feature"), F.round("target", 4).alias("target"), "held", F.when(F.col("met"), "yes").otherwise("no").alias("target_met"), F.round("mpm", 6).alias("mpm"), "occurrences")
    return r.missing_values(mv)


@query("rs3_summed_solution", "SELECT number, COUNT(*) AS n, MIN(planning_unit) AS first FROM (SELECT planning_unit, CAST(SUM(selected) AS BIGINT) AS number FROM solutions GROUP BY planning_unit) x WHERE number != 0 GROUP BY number")
def rs3(t):
    rows = r.summed_by_number(r.summed_solution(t("solutions")), nested=False)
    return rows.groupBy("number").agg(F.count("*").alias("n"), F.min("planning_unit").alias("first"))


@query("rs4_best_run", f"SELECT e.run, e.id, e.held FROM ({EVALUATED}) e WHERE e.run = (SELECT run FROM (SELECT run, SUM(selected) AS score FROM solutions GROUP BY run) s ORDER BY score, run LIMIT 1)")
def rs4(t):
    summary = t("solutions").groupBy("run").agg(F.sum("selected").alias("score"))
    return r.best_run(summary, evaluated(t).select("run", "id", "held"))


@query("rs5_evaluate_features", f"SELECT run, id, round(target, 4) AS target, held, occurrences, met, round(mpm, 6) AS mpm FROM ({EVALUATED}) e")
def rs5(t):
    return evaluated(t).withColumns({"target": F.round("target", 4), "mpm": F.round("mpm", 6)})


RUNS = f"""SELECT r.run, round(COALESCE(c.cost, 0), 2) AS cost, COALESCE(c.n, 0) AS planning_units, f.missing_values, round(f.mpm, 6) AS mpm,
COALESCE(l.cin, 0) AS connectivity_in, COALESCE(l.edge, 0) AS connectivity_edge, b.total - COALESCE(l.cin, 0) - COALESCE(l.edge, 0) AS connectivity_out, round(COALESCE(c.cost, 0) + 0.5 * COALESCE(l.edge, 0), 2) AS score
FROM (SELECT DISTINCT run FROM solutions) r CROSS JOIN (SELECT SUM(boundary) AS total FROM bounds) b
LEFT JOIN (SELECT s.run, SUM(u.cost) AS cost, COUNT(*) AS n FROM solutions s JOIN units u ON u.id = s.planning_unit WHERE s.selected = 1 GROUP BY s.run) c ON c.run = r.run
LEFT JOIN (SELECT run, SUM(CASE WHEN n = 2 THEN boundary ELSE 0 END) AS cin, SUM(CASE WHEN n = 1 THEN boundary ELSE 0 END) AS edge FROM (SELECT s.run, b.id1, b.id2, MAX(b.boundary) AS boundary, COUNT(*) AS n FROM bounds b JOIN solutions s ON s.selected = 1 AND s.planning_unit IN (b.id1, b.id2) GROUP BY s.run, b.id1, b.id2) x GROUP BY run) l ON l.run = r.run
LEFT JOIN (SELECT run, CAST(SUM(CASE WHEN met THEN 0 ELSE 1 END) AS BIGINT) AS missing_values, MIN(mpm) AS mpm FROM ({EVALUATED}) e GROUP BY run) f ON f.run = r.run"""


@query("rs6_evaluate_runs", RUNS)
def rs6(t):
    out = r.evaluate_runs(t("solutions"), t("units"), t("bounds"), evaluated(t), 0.5)
    return out.select("run", F.round("cost", 2).alias("cost"), "planning_units", "missing_values", F.round("mpm", 6).alias("mpm"), "connectivity_in", "connectivity_edge", "connectivity_out", F.round("score", 2).alias("score"))


FILES = "SELECT user_id, project_id, MAX(done) AS found, CAST(100 AS BIGINT) AS required FROM run_log GROUP BY user_id, project_id"


@query("rs7_run_progress", f"SELECT l.pid, l.status, CASE WHEN l.status = 'Running' THEN concat(f.found, '/', f.required) ELSE 'x' END AS runs FROM run_log l LEFT JOIN ({FILES}) f USING (user_id, project_id)")
def rs7(t):
    return r.run_progress(t("run_log").withColumn("runs", F.lit("x")), t.sql(FILES)).select("pid", "status", "runs")


ENDS = "SELECT user_id AS pid, MAX(ts) AS endtime, COUNT(*) AS done, CAST(200 AS BIGINT) AS required FROM events WHERE user_id % 2 = 0 GROUP BY user_id"


@query("rs8_close_run", f"SELECT l.pid, CASE WHEN e.endtime IS NOT NULL THEN concat(CAST(floor(epoch(e.endtime)) - floor(epoch(l.starttime)) AS BIGINT), 's') END AS runtime, CASE WHEN e.endtime IS NOT NULL THEN concat(e.done, '/', e.required) END AS runs, CASE WHEN e.endtime IS NOT NULL AND l.status = 'Running' THEN CASE WHEN e.done = e.required THEN 'Completed' ELSE 'Killed' END ELSE l.status END AS status FROM run_log l LEFT JOIN ({ENDS}) e ON e.pid = l.pid")
def rs8(t):
    return r.close_run(t("run_log").drop("done"), t.sql(ENDS)).select("pid", "runtime", "runs", "status")


@query("rs9_already_running", "SELECT pid FROM run_log WHERE user_id = 3 AND project_id = 3 AND status = 'Running'")
def rs9(t):
    return r.already_running(t("run_log"), 3, 3).select("pid")


EVENTS = "SELECT event_id, user_id AS pid, user_id % 10 AS user_id, ts, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Stopped' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'Completed' ELSE 'Running' END AS status, CAST(event_id % 11 AS INT) AS done FROM events"


@query("st1_latest_run_state", f"SELECT pid, status, done FROM (SELECT pid, status, done, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY CASE WHEN status != 'Running' THEN 0 ELSE 1 END, CASE WHEN status != 'Running' THEN epoch_us(ts) ELSE -epoch_us(ts) END) AS n FROM ({EVENTS}) e) x WHERE n = 1")
def st1(t):
    return runs.latest_run_state(t.sql(EVENTS)).select("pid", "status", "done")


@query("st2_runs_per_window", f"SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, user_id, CAST(SUM(CASE WHEN status = 'Running' THEN 1 ELSE 0 END) AS BIGINT) AS started, CAST(SUM(CASE WHEN status != 'Running' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM ({EVENTS}) e GROUP BY 1, user_id")
def st2(t):
    return runs.runs_per_window(t.sql(EVENTS).drop("pid"))
