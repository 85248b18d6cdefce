"""Model-upgrade evaluation: sample on request, pair, score, summarise, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import EVALUATION, Evaluation
from tracemill.functions.scores import change_flags, priority
from tracemill.operators.relational import stratified
from tracemill.operators.retrieval import similarity_filter

CODE_GEN, BUG_FIX, EXPLAIN = "code_generation", "bug_fixing", "code_explanation"


def pair_outputs(logs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Log entries with the candidate's output, empty when there is none."""
    new = outputs.select("id", F.col("output").alias("_new"))
    return logs.join(new, "id", "left").withColumn("new_output", F.coalesce("_new", F.lit(""))).drop("_new")


def pass_rate(runs: DataFrame, keys: tuple[str, ...] = ("id", "side")) -> DataFrame:
    """Share of passed cases per entry and side; ``outcome`` is passed, failed or error. A timeout counts as failed."""
    return runs.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "passed").alias("passed"),
        F.count_if(F.col("outcome").isin("failed", "timeout")).alias("failed"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    ).withColumn("_all", F.col("passed") + F.col("failed") + F.col("errors")).withColumn(
        "pass_rate", F.when(F.col("_all") > 0, F.col("passed") / F.col("_all")).otherwise(0.0)
    ).drop("_all")


def judge_average(entries: DataFrame, scores: DataFrame, cfg: Evaluation = EVALUATION) -> DataFrame:
    """Overall judge score per entry and side over both orderings; the default when a judge run is missing.

    ``scores`` has (id, side, ordering, correctness, clarity, completeness).
    Unless both orderings scored both sides, both sides get the default.
    """
    parts = ("correctness", "clarity", "completeness")
    averaged = scores.groupBy("id").agg(
        F.count(F.lit(1)).alias("_runs"),
        *[F.avg(F.when(F.col("side") == s, F.col(p))).alias(f"{s}_{p}") for s in ("old", "new") for p in parts],
    )
    joined = entries.select("id").join(averaged, "id", "left")
    whole = F.coalesce(F.col("_runs") >= 4, F.lit(False))

    def overall(side: str) -> Column:
        total = sum((F.when(whole, F.col(f"{side}_{p}")).otherwise(cfg.default_judge_score) for p in parts), F.lit(0.0))
        return total / 9.0

    return joined.select("id", overall("old").alias("old_judge"), overall("new").alias("new_judge"))


def task_results(pairs: DataFrame, rates: DataFrame, judged: DataFrame, cfg: Evaluation = EVALUATION) -> DataFrame:
    """Result row per entry: pass rates for code and fixes, judge scores for explanations, none when skipped.

    ``pairs``: (id, task_type, similarity, skip, weight, has_cases);
    ``rates``: (id, side, pass_rate); ``judged``: (id, old_judge, new_judge).
    """
    wide = rates.groupBy("id").agg(
        F.max(F.when(F.col("side") == "old", F.col("pass_rate"))).alias("_old"),
        F.max(F.when(F.col("side") == "new", F.col("pass_rate"))).alias("_new"),
    )
    joined = pairs.join(wide, "id", "left").join(judged, "id", "left")
    runs = ~F.col("skip") & F.col("has_cases") & F.col("task_type").isin(CODE_GEN, BUG_FIX)
    reads = ~F.col("skip") & (F.col("task_type") == EXPLAIN)
    scored = (
        joined.withColumn("old_rate", F.when(runs, F.coalesce("_old", F.lit(0.0))))
        .withColumn("new_rate", F.when(runs, F.coalesce("_new", F.lit(0.0))))
        .withColumn("old_judge", F.when(reads, F.col("old_judge")))
        .withColumn("new_judge", F.when(reads, F.col("new_judge")))
    )
    regressed, improved = change_flags(F.col("old_rate"), F.col("new_rate"), F.col("old_judge"), F.col("new_judge"), cfg)
    return (
        scored.withColumn("regressed", regressed).withColumn("improved", improved)
        .withColumn("priority", priority(F.col("regressed"), F.col("improved"), F.col("weight")))
        .drop("_old", "_new")
    )


def weighted_regression(results: DataFrame) -> DataFrame:
    """Sum of the weights of regressed entries."""
    return results.agg(F.coalesce(F.sum(F.when(F.col("regressed"), F.col("weight"))), F.lit(0.0)).alias("weighted_regression"))


def scorecard(results: DataFrame, *by: str) -> DataFrame:
    """Totals and mean rates in one aggregation, optionally per run."""
    def mean(kind: str, column: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("task_type") == kind, F.col(column))), F.lit(0.0))

    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("skip").alias("filtered"), F.count_if(~F.col("skip")).alias("evaluated"),
        mean(CODE_GEN, "old_rate").alias("code_gen_old"), mean(CODE_GEN, "new_rate").alias("code_gen_new"),
        mean(BUG_FIX, "old_rate").alias("bug_fix_old"), mean(BUG_FIX, "new_rate").alias("bug_fix_new"),
        mean(EXPLAIN, "old_judge").alias("explanation_old"), mean(EXPLAIN, "new_judge").alias("explanation_new"),
        F.count_if("regressed").alias("regressions"), F.count_if("improved").alias("improvements"),
        F.coalesce(F.sum(F.when(F.col("regressed"), F.col("weight"))), F.lit(0.0)).alias("weighted_regression"),
    )


def ship(card: DataFrame, cfg: Evaluation = EVALUATION) -> DataFrame:
    """Decision (hold, ship, review) with its reasons."""
    def percent(value: Column) -> Column:
        return F.format_string("%.1f%%", value * 100)

    # The texts of the reasons, here and below.
    drops = (
        ("code_gen_old", "code_gen_new", cfg.code_gen_drop, "Code gen pass rate dropped ", True),
        ("bug_fix_old", "bug_fix_new", cfg.bug_fix_drop, "Bug fix pass rate dropped ", True),
        ("explanation_old", "explanation_new", cfg.explanation_drop, "Explanation score dropped ", False),
    )
    holds = []
    for old, new, limit, label, as_percent in drops:
        drop = F.col(old) - F.col(new)
        shown = percent(drop) if as_percent else F.format_string("%.2f", drop)
        bound = f" (threshold {limit:.1%})" if as_percent else f" (threshold {limit:.2f})"
        holds.append(F.when(drop > limit, F.concat(F.lit(label), shown, F.lit(bound))))
    weighted = F.col("weighted_regression")
    holds.append(F.when(weighted > cfg.weighted_hold, F.concat(
        F.lit("Weighted regression score "), F.format_string("%.1f", weighted), F.lit(" exceeds threshold"))))
    found = card.withColumn("_holds", F.array_compact(F.array(*holds)))
    held, clean = F.size("_holds") > 0, F.col("regressions") == 0
    return (
        found.withColumn("decision", F.when(held, "hold").when(clean, "ship").otherwise("review"))
        .withColumn("reasons", F.when(held, F.col("_holds"))
                    .when(clean, F.array(F.lit("No regressions detected across all task types")))
                    .otherwise(F.array(F.lit("Some differences detected, manual review recommended"))))
        .withColumn("decision_gauge", F.when(held, -1).when(clean, 1).otherwise(0))
        .drop("_holds")
    )


def high_signal_first(entries: DataFrame) -> DataFrame:
    """Entries by falling quality weight, ties by id."""
    return entries.orderBy(F.col("weight").desc(), F.col("id"))


def evaluate(logs: DataFrame, outputs: DataFrame, runs: DataFrame, scores: DataFrame,
             cfg: Evaluation = EVALUATION, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, card): one run from the logs to the decision, over all entries or a ``sample`` of so many per task type.

    ``logs``: (id, task_type, old_output, weight, has_cases, old_vec);
    ``outputs``: (id, output, new_vec); ``runs`` and ``scores`` as for
    :func:`pass_rate` and :func:`judge_average`.
    """
    if sample is not None:
        logs = stratified(logs, "task_type", sample, F.col("id"), cfg.seed)
    vectors = outputs.select("id", "new_vec")
    paired = pair_outputs(logs, outputs).join(vectors, "id", "left")
    filtered = similarity_filter(paired, "old_vec", "new_vec", "old_output", "new_output", cfg.similarity_threshold)
    ids = filtered.select("id")
    if sample is not None:  # only sampled entries need outcomes
        runs, scores = (df.join(ids, "id", "left_semi") for df in (runs, scores))
    results = task_results(filtered, pass_rate(runs), judge_average(ids, scores, cfg), cfg)
    return results, ship(scorecard(results), cfg)
