"""Queries of the evaluation: conversations are logs (user turn = prompt, next turn = output)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.config import EVALUATION
from tracemill.functions.scores import priority, quality_weight
from tracemill.operators import evaluation
from tracemill.operators.embedding import embed
from tracemill.operators.relational import stratified
from tracemill.registry import query
from tracemill.registry.tables import cosine_sql, hashed_vectors_sql, table
from tracemill.sources import readers, sinks
from tracemill.streaming import flows

LOGS_SQL = """
logs AS (
  SELECT u.conv_id * 100 + u.turn AS id, u.conv_id, u.turn, u.text AS prompt, coalesce(a.text, '') AS old_output,
         CASE (u.conv_id + u.turn) % 3 WHEN 0 THEN 'code_generation' WHEN 1 THEN 'bug_fixing' ELSE 'code_explanation' END AS task_type,
         (u.conv_id + u.turn) % 2 = 0 AS copied, u.conv_id % 5 = 0 AS re_asked, CASE WHEN u.turn % 4 = 0 THEN 0.05 ELSE 0.5 END AS edit_distance,
         CASE u.conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS thumbs_up
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
weighted AS (
  SELECT *, CASE WHEN copied AND edit_distance < 0.1 AND NOT re_asked THEN 1.0 WHEN coalesce(thumbs_up, false) THEN 0.9
                 WHEN re_asked OR (NOT copied AND thumbs_up IS NULL) THEN 0.3 ELSE 0.6 END AS weight FROM logs)
"""


def raw_logs(spark, sf_dir):
    """Log entries with their signals and test cases as JSON text."""
    talk = table(spark, sf_dir, "conversations")
    answer = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_answer"))
    conv, turn = F.col("conv_id"), F.col("turn")
    signals = F.struct(
        ((conv + turn) % 2 == 0).alias("copied"), (conv % 5 == 0).alias("re_asked_within_60s"),
        F.when(turn % 4 == 0, 0.05).otherwise(0.5).alias("edit_distance_after_copy"),
        F.when(conv % 3 == 0, True).when(conv % 3 == 1, False).alias("thumbs_up"),
    )
    case = F.struct(F.lit("1").alias("input_data"), F.lit("2").alias("expected_output"), F.lit(10.0).alias("timeout_seconds"))
    kinds = F.array(*[F.lit(k) for k in ("code_generation", "bug_fixing", "code_explanation")])
    return talk.where("role = 'user'").join(answer, ["conv_id", "turn"], "left").select(
        (conv * 100 + turn).alias("id"), conv, turn, F.col("text").alias("prompt"), F.coalesce("_answer", F.lit("")).alias("old_model_output"),
        F.element_at(kinds, ((conv + turn) % 3 + 1).cast("int")).alias("task_type"), F.lit(None).cast("string").alias("language"),
        F.to_json(signals).alias("implicit_signals"), F.when(conv % 4 > 0, F.to_json(F.array(case))).alias("test_cases"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=conv * 100 + turn)).alias("created_at"),
    )


def logs(spark, sf_dir):
    """Decoded logs with their quality weight."""
    s = "implicit_signals."
    weight = quality_weight(F.col(s + "copied"), F.col(s + "re_asked_within_60s"), F.col(s + "edit_distance_after_copy"), F.col(s + "thumbs_up"))
    return readers.load_logs(raw_logs(spark, sf_dir), limit=None).withColumn("weight", weight).withColumn(
        "has_cases", F.size("test_cases") > 0
    ).withColumnRenamed("old_model_output", "old_output")


@query("src6_load_logs", f"""
WITH {LOGS_SQL} SELECT id, copied, re_asked, edit_distance, CASE WHEN thumbs_up IS NULL THEN 'none' ELSE CAST(thumbs_up AS VARCHAR) END AS thumbs_up, conv_id % 4 > 0 AS has_cases
FROM logs WHERE task_type = 'bug_fixing' ORDER BY id DESC LIMIT 50
""")
def src6(spark, sf_dir):
    rows = readers.load_logs(raw_logs(spark, sf_dir), "bug_fixing", 50)
    s = rows["implicit_signals"]
    return rows.select(
        "id", s["copied"].alias("copied"), s["re_asked_within_60s"].alias("re_asked"), s["edit_distance_after_copy"].alias("edit_distance"),
        F.coalesce(s["thumbs_up"].cast("string"), F.lit("none")).alias("thumbs_up"), (F.size("test_cases") > 0).alias("has_cases"),
    )


@query("num2_quality_weight", f"WITH {LOGS_SQL} SELECT id, CAST(weight AS DOUBLE) AS weight FROM weighted")
def num2(spark, sf_dir):
    return logs(spark, sf_dir).select("id", "weight")


@query("top5_stratified_sample", f"""
WITH {LOGS_SQL}, shuffled AS (SELECT id, task_type, md5(id || '|42') AS shuffle FROM logs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY shuffle, id) AS r FROM shuffled)
SELECT id, task_type, shuffle FROM ranked WHERE r <= 40
""")
def top5(spark, sf_dir):
    return stratified(logs(spark, sf_dir), "task_type", 40, F.col("id"), 42).select("id", "task_type", "shuffle")


@query("top6_high_signal_first", f"WITH {LOGS_SQL} SELECT id, CAST(weight AS DOUBLE) AS weight FROM weighted ORDER BY weight DESC, id")
def top6(spark, sf_dir):
    return evaluation.high_signal_first(logs(spark, sf_dir)).select("id", "weight")


OUTPUTS_SQL = f"""
{LOGS_SQL}, outputs AS (
  SELECT id, CASE id % 4 WHEN 0 THEN old_output WHEN 1 THEN old_output || ' and one more remark' ELSE prompt END AS output FROM logs WHERE id % 7 <> 3)
"""


def outputs(spark, sf_dir):
    """Candidate outputs: some equal the old one, some nearly, some differ, some are missing."""
    number = F.col("id")
    new = F.when(number % 4 == 0, F.col("old_output")).when(
        number % 4 == 1, F.concat("old_output", F.lit(" and one more remark"))).otherwise(F.col("prompt"))
    return logs(spark, sf_dir).where("id % 7 <> 3").select("id", new.alias("output"))


@query("joi19_pair_outputs", f"""
WITH {OUTPUTS_SQL} SELECT l.id, length(old_output) AS old_chars, length(coalesce(o.output, '')) AS new_chars FROM logs l LEFT JOIN outputs o USING (id)
""")
def joi19(spark, sf_dir):
    paired = evaluation.pair_outputs(logs(spark, sf_dir), outputs(spark, sf_dir))
    return paired.select(
        "id", F.length("old_output").cast("bigint").alias("old_chars"), F.length("new_output").cast("bigint").alias("new_chars")
    )


RUNS_SQL = """
runs AS (
  SELECT l.id, s.side, CASE (l.id * 13 + c.n * 7 + CASE s.side WHEN 'new' THEN 5 ELSE 0 END) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'timeout' ELSE 'passed' END AS outcome
  FROM logs l, (VALUES ('old'), ('new')) AS s(side), (SELECT unnest(range(4)) AS n) c WHERE l.conv_id % 4 > 0),
rates AS (
  SELECT id, side, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome IN ('failed', 'timeout')) AS failed,
         count(*) FILTER (WHERE outcome = 'error') AS errors FROM runs GROUP BY 1, 2)
"""


def runs(spark, sf_dir):
    """Four case runs per entry and side."""
    rows = logs(spark, sf_dir).where("conv_id % 4 > 0").select("id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3))))
    code = (F.col("id") * 13 + F.col("n") * 7 + F.when(F.col("side") == "new", 5).otherwise(0)) % 5
    return rows.select("id", "side", F.when(code == 0, "failed").when(code == 1, "error").when(code == 2, "timeout").otherwise("passed").alias("outcome"))


@query("agg4_pass_rate", f"WITH {LOGS_SQL}, {RUNS_SQL} SELECT id, side, passed, failed, errors, round(passed / (passed + failed + errors), 6) AS pass_rate FROM rates")
def agg4(spark, sf_dir):
    return evaluation.pass_rate(runs(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


JUDGED_SQL = """
scores AS (
  SELECT l.id, s.side, o.ordering, (l.id + o.ordering + CASE s.side WHEN 'new' THEN 1 ELSE 0 END) % 4 AS correctness, (l.id * 3 + o.ordering) % 4 AS clarity, (l.id * 5 + CASE s.side WHEN 'new' THEN 2 ELSE 0 END) % 4 AS completeness
  FROM logs l, (VALUES ('old'), ('new')) AS s(side), (VALUES (1), (2)) AS o(ordering) WHERE l.id % 6 <> 5 AND NOT (l.id % 6 = 4 AND o.ordering = 2)),
judged AS (
  SELECT l.id, CASE WHEN count(s.id) >= 4 THEN avg(correctness + clarity + completeness) FILTER (WHERE side = 'old') ELSE 4.5 END / 9 AS old_judge,
         CASE WHEN count(s.id) >= 4 THEN avg(correctness + clarity + completeness) FILTER (WHERE side = 'new') ELSE 4.5 END / 9 AS new_judge
  FROM logs l LEFT JOIN scores s ON s.id = l.id GROUP BY 1)
"""


def scores(spark, sf_dir):
    """Judge scores of both orderings; some entries lack a run."""
    rows = logs(spark, sf_dir).where("id % 6 <> 5").select("id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"))
    rows = rows.withColumn("ordering", F.explode(F.array(F.lit(1), F.lit(2)))).where("not (id % 6 = 4 and ordering = 2)")
    new = F.when(F.col("side") == "new", 1).otherwise(0)
    return rows.select(
        "id", "side", "ordering", ((F.col("id") + F.col("ordering") + new) % 4).alias("correctness"),
        ((F.col("id") * 3 + F.col("ordering")) % 4).alias("clarity"), ((F.col("id") * 5 + 2 * new) % 4).alias("completeness"),
    )


@query("agg5_judge_average", f"WITH {LOGS_SQL}, {JUDGED_SQL} SELECT id, round(old_judge, 6) AS old_judge, round(new_judge, 6) AS new_judge FROM judged")
def agg5(spark, sf_dir):
    averaged = evaluation.judge_average(logs(spark, sf_dir), scores(spark, sf_dir))
    return averaged.select("id", F.round("old_judge", 6).alias("old_judge"), F.round("new_judge", 6).alias("new_judge"))


RESULTS_SQL = f"""
{OUTPUTS_SQL}, {RUNS_SQL}, {JUDGED_SQL}, {hashed_vectors_sql('ov', 'logs', 'id', 'old_output')}, {hashed_vectors_sql('nv', 'outputs', 'id', 'output')},
pairs AS (
  SELECT s.*, trim(s.old_output) <> '' AND trim(coalesce(o.output, '')) <> '' AND coalesce({cosine_sql('ov.e', 'nv.e')}, 0) >= 0.95 AS skip
  FROM weighted s LEFT JOIN outputs o USING (id) LEFT JOIN ov USING (id) LEFT JOIN nv USING (id)),
joined AS (
  SELECT p.*, CASE WHEN NOT skip AND conv_id % 4 > 0 AND task_type <> 'code_explanation' THEN coalesce(ro.passed / (ro.passed + ro.failed + ro.errors), 0) END AS old_rate,
         CASE WHEN NOT skip AND conv_id % 4 > 0 AND task_type <> 'code_explanation' THEN coalesce(rn.passed / (rn.passed + rn.failed + rn.errors), 0) END AS new_rate,
         CASE WHEN NOT skip AND task_type = 'code_explanation' THEN j.old_judge END AS old_judge, CASE WHEN NOT skip AND task_type = 'code_explanation' THEN j.new_judge END AS new_judge
  FROM pairs p LEFT JOIN rates ro ON ro.id = p.id AND ro.side = 'old' LEFT JOIN rates rn ON rn.id = p.id AND rn.side = 'new' LEFT JOIN judged j ON j.id = p.id),
results AS (
  SELECT *, CASE WHEN old_rate IS NOT NULL THEN new_rate < old_rate - 0.05 WHEN old_judge IS NOT NULL THEN new_judge < old_judge - 0.1 ELSE false END AS regressed,
         CASE WHEN old_rate IS NOT NULL THEN new_rate > old_rate + 0.05 WHEN old_judge IS NOT NULL THEN new_judge > old_judge + 0.1 ELSE false END AS improved FROM joined),
card AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE skip) AS filtered, count(*) FILTER (WHERE NOT skip) AS evaluated,
         coalesce(avg(old_rate) FILTER (WHERE task_type = 'code_generation'), 0) AS code_gen_old, coalesce(avg(new_rate) FILTER (WHERE task_type = 'code_generation'), 0) AS code_gen_new,
         coalesce(avg(old_rate) FILTER (WHERE task_type = 'bug_fixing'), 0) AS bug_fix_old, coalesce(avg(new_rate) FILTER (WHERE task_type = 'bug_fixing'), 0) AS bug_fix_new,
         coalesce(avg(old_judge), 0) AS explanation_old, coalesce(avg(new_judge), 0) AS explanation_new,
         count(*) FILTER (WHERE regressed) AS regressions, count(*) FILTER (WHERE improved) AS improvements, coalesce(sum(weight) FILTER (WHERE regressed), 0) AS weighted_regression
  FROM results)
"""


def evaluated(spark, sf_dir, sample=None):
    entries = embed(logs(spark, sf_dir), F.col("old_output"), "old_vec")
    new = embed(outputs(spark, sf_dir), F.col("output"), "new_vec")
    return evaluation.evaluate(entries, new, runs(spark, sf_dir), scores(spark, sf_dir), sample=sample)


@query("dec19_task_results", f"""
WITH {RESULTS_SQL} SELECT id, task_type, skip, round(coalesce(old_rate, -1), 6) AS old_rate, round(coalesce(new_rate, -1), 6) AS new_rate, round(coalesce(old_judge, -1), 6) AS old_judge, round(coalesce(new_judge, -1), 6) AS new_judge FROM results
""")
def dec19(spark, sf_dir):
    results, _ = evaluated(spark, sf_dir)
    return results.select("id", "task_type", "skip", *[
        F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("old_rate", "new_rate", "old_judge", "new_judge")
    ])


@query("num3_change_flags", f"WITH {RESULTS_SQL} SELECT id, regressed, improved FROM results")
def num3(spark, sf_dir):
    return evaluated(spark, sf_dir)[0].select("id", "regressed", "improved")


@query("dec10_priority", f"""
WITH {RESULTS_SQL} SELECT id, CASE WHEN regressed AND weight >= 0.8 THEN 'critical_regression' WHEN regressed AND weight >= 0.5 THEN 'regression' WHEN regressed THEN 'low_priority_regression'
  WHEN improved AND weight <= 0.4 THEN 'likely_improvement' WHEN improved THEN 'improvement' ELSE 'neutral' END AS priority FROM results
""")
def dec10(spark, sf_dir):
    results, _ = evaluated(spark, sf_dir)
    return results.select("id", priority(F.col("regressed"), F.col("improved"), F.col("weight")).alias("priority"))


CARD = ("code_gen_old", "code_gen_new", "bug_fix_old", "bug_fix_new", "explanation_old", "explanation_new", "weighted_regression")


@query("agg2_scorecard", f"WITH {RESULTS_SQL} SELECT total, filtered, evaluated, regressions, improvements, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in CARD)} FROM card")
def agg2(spark, sf_dir):
    card = evaluation.scorecard(evaluated(spark, sf_dir)[0])
    return card.select("total", "filtered", "evaluated", "regressions", "improvements", *[F.round(c, 6).alias(c) for c in CARD])


@query("agg3_weighted_regression", f"WITH {RESULTS_SQL} SELECT round(CAST(weighted_regression AS DOUBLE), 6) AS weighted_regression FROM card")
def agg3(spark, sf_dir):
    return evaluation.weighted_regression(evaluated(spark, sf_dir)[0]).select(F.round("weighted_regression", 6).alias("weighted_regression"))


SHIP_SQL = f"""
{RESULTS_SQL}, reasons AS (
  SELECT *, concat_ws(';', CASE WHEN code_gen_old - code_gen_new > 0.05 THEN format('Code gen pass rate dropped {{:.1f}}% (threshold 5.0%)', (code_gen_old - code_gen_new) * 100) END,
    CASE WHEN bug_fix_old - bug_fix_new > 0.10 THEN format('Bug fix pass rate dropped {{:.1f}}% (threshold 10.0%)', (bug_fix_old - bug_fix_new) * 100) END,
    CASE WHEN explanation_old - explanation_new > 0.30 THEN format('Explanation score dropped {{:.2f}} (threshold 0.30)', explanation_old - explanation_new) END,
    CASE WHEN weighted_regression > 5 THEN format('Weighted regression score {{:.1f}} exceeds threshold', CAST(weighted_regression AS DOUBLE)) END) AS holds FROM card)
"""


@query("dec9_ship", f"""
WITH {SHIP_SQL} SELECT CASE WHEN holds <> '' THEN 'hold' WHEN regressions = 0 THEN 'ship' ELSE 'review' END AS decision,
  CASE WHEN holds <> '' THEN holds WHEN regressions = 0 THEN 'No regressions detected across all task types' ELSE 'Some differences detected, manual review recommended' END AS reasons FROM reasons
""")
def dec9(spark, sf_dir):
    card = evaluation.ship(evaluation.scorecard(evaluated(spark, sf_dir)[0]))
    return card.select("decision", F.array_join("reasons", ";").alias("reasons"))


#: The same over a sample of each task type.
SAMPLED_SHIP_SQL = SHIP_SQL.replace("FROM weighted s", """FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY md5(id || '|42'), id) AS r FROM weighted) WHERE r <= 100) s""")


@query("dec18_evaluate", f"""
WITH {SAMPLED_SHIP_SQL} SELECT total, regressions, improvements, CASE WHEN holds <> '' THEN 'hold' WHEN regressions = 0 THEN 'ship' ELSE 'review' END AS decision,
  CASE WHEN holds <> '' THEN -1 WHEN regressions = 0 THEN 1 ELSE 0 END AS decision_gauge FROM reasons
""")
def dec18(spark, sf_dir):
    return evaluated(spark, sf_dir, EVALUATION.per_task_type)[1].select("total", "regressions", "improvements", "decision", "decision_gauge")


@query("snk7_run_results", f"WITH {RESULTS_SQL} SELECT id, 'run-1' AS run_id, regressed FROM results")
def snk7(spark, sf_dir):
    folder = flows.work_folder(spark)
    results = sinks.with_run(evaluated(spark, sf_dir)[0], "run-1").select("id", "run_id", "regressed")
    for _ in range(2):  # a run that is reported again adds nothing
        sinks.append_once(results, folder, "run-1")
    return sinks.committed(spark, folder)
