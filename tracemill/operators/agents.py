"""Loop detection over agent steps.

A steps table has (session_id, step, tool_name, tool_args, observation,
tokens_used, ts) with dense steps from 1. Each detector adds its own columns;
all of them work on blocks of steps, so one very long session is many tasks.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.config import AGENTS, Agents
from tracemill.operators.skew import (
    BLOCK_ROWS, latest_per, ordered_fold, overlapping_blocks, running, stage, top_per,
)
from tracemill.operators.vectors import cosine

KEY = "session_id"


def budget(steps: DataFrame, cfg: Agents = AGENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running tokens, what is left, and the exhausted budget (``steps`` is looked at before ``tokens``)."""
    totals = running(steps, [KEY], "step", {"tokens": (F.sum, F.col("tokens_used"))}, block_rows)
    return (
        totals
        .withColumn("steps_left", F.greatest(F.lit(0), cfg.max_steps - F.col("step")))
        .withColumn("tokens_left", F.greatest(F.lit(0), cfg.max_tokens - F.col("tokens")))
        .withColumn("exhausted", F.when(F.col("step") >= cfg.max_steps, "steps")
                    .when(F.col("tokens") >= cfg.max_tokens, "tokens"))
    )


def first_seen(steps: DataFrame) -> DataFrame:
    """Step at which each observation first occurred in its session (aggregated before the shuffle)."""
    hashed = steps.withColumn("observation_hash", F.sha2("observation", 256))
    firsts = hashed.groupBy(KEY, "observation_hash").agg(F.min("step").alias("first_step"))
    return hashed.join(firsts, [KEY, "observation_hash"])


def no_progress(steps: DataFrame, cfg: Agents = AGENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean novelty of the last full window, and whether it is under the threshold."""
    novel = first_seen(steps).withColumn("novelty", (F.col("step") == F.col("first_step")).cast("double"))
    window = cfg.progress_window
    frame = Window.partitionBy(KEY, "_block").orderBy("step").rowsBetween(1 - window, 0)
    return (
        overlapping_blocks(novel, "step", window - 1, block_rows)
        .withColumn("avg_novelty", F.avg("novelty").over(frame))
        .where(~F.col("_halo"))
        .withColumn("no_progress", (F.col("step") >= window) & (F.col("avg_novelty") < cfg.progress_threshold))
        .drop("_block", "_halo")
    )


def causal_cycle(steps: DataFrame, cfg: Agents = AGENTS) -> DataFrame:
    """Distance to the first step with the same output; a cycle from a distance of two on."""
    distance = F.col("step") - F.col("first_step")
    return (
        first_seen(steps)
        .withColumn("cycle_length", distance)
        .withColumn("causal_cycle", distance >= cfg.cycle_length)
    )


def soft_loop(steps: DataFrame, vec: str = "embedding", cfg: Agents = AGENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best cosine with the steps just before, never under 0, and whether it reaches the threshold."""
    window = cfg.semantic_window
    order = Window.partitionBy(KEY, "_block").orderBy("step")
    blocks = overlapping_blocks(steps, "step", window, block_rows)
    for back in range(1, window + 1):
        blocks = blocks.withColumn(f"_v{back}", F.lag(vec, back).over(order))
    scores = [F.coalesce(cosine(F.col(vec), F.col(f"_v{b}")), F.lit(0.0)) for b in range(1, window + 1)]
    return (
        blocks.where(~F.col("_halo"))
        .withColumn("best_score", F.greatest(F.lit(0.0), *scores))
        .withColumn("soft_loop", F.col("best_score") >= cfg.semantic_threshold)
        .drop("_block", "_halo", *[f"_v{b}" for b in range(1, window + 1)])
    )


def exact_repeat(
    steps: DataFrame, fingerprint: str = "args_hash", cfg: Agents = AGENTS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(session_id, step, exact_repeat): fingerprint among the last kept ones; a flagged step is not kept."""
    size = cfg.fingerprint_window

    def advance(kept: list, rows: dict[str, list]) -> tuple[list, list]:
        recent, flags = deque(kept, maxlen=size), []
        for mark in rows[fingerprint]:
            repeated = mark in recent
            flags.append(repeated)
            if not repeated:
                recent.append(mark)
        return flags, list(recent)

    return ordered_fold(steps, KEY, "step", [fingerprint], [], advance, "exact_repeat", "boolean", block_rows)


def consecutive(flags: DataFrame, flagged: str = "flagged", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Detections in a row up to each step; a clean step sets it back to 0.

    Steps are dense, so it is the distance to the last clean step.
    """
    clean_step = F.when(~F.col(flagged), F.col("step")).otherwise(F.lit(0))
    marked = running(flags, [KEY], "step", {"_clean": (F.max, clean_step)}, block_rows)
    return marked.withColumn("consecutive", F.col("step") - F.col("_clean")).drop("_clean")


def recovery(flags: DataFrame, cfg: Agents = AGENTS) -> DataFrame:
    """Recovery per flagged step: human checkpoint after enough in a row, else stop on budget, else correct.

    Needs ``flagged``, ``consecutive`` and ``exhausted``.
    """
    strategy = (
        F.when(~F.col("flagged"), F.lit(None).cast("string"))
        .when(F.col("consecutive") >= cfg.checkpoint_after, "human_checkpoint")
        .when(F.col("exhausted").isNotNull(), "force_summarize")
        .otherwise("inject_correction")
    )
    return flags.withColumn("strategy", strategy)


def until_stopped(recovered: DataFrame) -> DataFrame:
    """Drop the steps after the first forced summary of a session: the run ends there."""
    stops = (
        recovered.where(F.col("strategy") == "force_summarize")
        .groupBy(KEY).agg(F.min("step").alias("_stop"))
    )
    joined = recovered.join(stops, KEY, "left")
    return joined.where(F.col("_stop").isNull() | (F.col("step") <= F.col("_stop"))).drop("_stop")


SIGNALS = ("exact_duplicate", "semantic_similarity", "budget_exhausted", "no_progress", "causal_cycle")


def detect(steps: DataFrame, fingerprint: str = "args_hash", vec: str | None = None,
           cfg: Agents = AGENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All detectors at once: ``signals`` (array, in layer order), ``flagged``, ``consecutive``, ``strategy``.

    The steps are staged once; the windows of all detectors share one
    partitioning by session and block.
    """
    steps = stage(steps)
    marked = first_seen(steps).join(exact_repeat(steps, fingerprint, cfg, block_rows), [KEY, "step"])
    novelty = (F.col("step") == F.col("first_step")).cast("double")
    halo = max(cfg.progress_window - 1, cfg.semantic_window if vec else 0)
    own_block = F.floor((F.col("step") - 1) / block_rows).alias("_block")
    before = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.groupBy(KEY, own_block).agg(F.sum("tokens_used").alias("_sum")).select(
        KEY, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried")
    )
    # A halo block without rows of its own has no carry and drops out here.
    blocks = overlapping_blocks(marked, "step", halo, block_rows).join(carried, [KEY, "_block"])
    order = Window.partitionBy(KEY, "_block").orderBy("step")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        blocks.withColumn("tokens", F.col("_carried") + F.coalesce(F.sum(F.when(~F.col("_halo"), F.col("tokens_used"))).over(so_far), F.lit(0)))
        .withColumn("avg_novelty", F.avg(novelty).over(order.rowsBetween(1 - cfg.progress_window, 0)))
    )
    soft = F.lit(False)
    if vec:
        scores = [cosine(F.col(vec), F.lag(vec, b).over(order)) for b in range(1, cfg.semantic_window + 1)]
        blocks = blocks.withColumn("best_score", F.greatest(F.lit(0.0), *[F.coalesce(s, F.lit(0.0)) for s in scores]))
        soft = F.col("best_score") >= cfg.semantic_threshold
    exhausted = F.when(F.col("step") >= cfg.max_steps, "steps").when(F.col("tokens") >= cfg.max_tokens, "tokens")
    stuck = (F.col("step") >= cfg.progress_window) & (F.col("avg_novelty") < cfg.progress_threshold)
    cycle = F.col("step") - F.col("first_step") >= cfg.cycle_length
    found = (F.col("exact_repeat"), soft, F.col("exhausted").isNotNull(), stuck, cycle)
    signals = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in zip(SIGNALS, found)]))
    flagged = (
        blocks.where(~F.col("_halo")).drop("_halo", "_carried").withColumn("exhausted", exhausted).withColumn("signals", signals)
        .withColumn("flagged", F.size("signals") > 0)
        .withColumn("_clean", F.when(~F.col("flagged"), F.col("step")).otherwise(F.lit(0)))
    )
    clean = flagged.groupBy(KEY, "_block").agg(F.max("_clean").alias("_max")).select(
        KEY, "_block", F.coalesce(F.max("_max").over(before), F.lit(0)).alias("_clean_before")
    )
    counted = flagged.join(clean, [KEY, "_block"]).withColumn(
        "consecutive", F.col("step") - F.greatest(F.col("_clean_before"), F.max("_clean").over(so_far))
    )
    return recovery(counted.drop("_block", "_clean", "_clean_before"), cfg)


def signal_rows(detected: DataFrame) -> DataFrame:
    """One row per signal and step with a metadata map, ready to append."""
    metadata = (
        F.when(F.col("signal_type") == "budget_exhausted", F.create_map(
            F.lit("steps"), F.col("step").cast("string"), F.lit("tokens"), F.col("tokens").cast("string")))
        .when(F.col("signal_type") == "causal_cycle", F.create_map(
            F.lit("prior_step"), F.col("first_step").cast("string"),
            F.lit("cycle_length"), (F.col("step") - F.col("first_step")).cast("string")))
        .when(F.col("signal_type") == "no_progress", F.create_map(
            F.lit("avg_novelty"), F.col("avg_novelty").cast("string")))
        .otherwise(F.create_map(F.lit("tool"), F.col("tool_name")))
    )
    return (
        detected.select("*", F.explode("signals").alias("signal_type"))
        .select(KEY, "step", "tool_name", "signal_type", metadata.alias("metadata"))
    )


def session_stats(detected: DataFrame) -> DataFrame:
    """Per session: steps, tokens, signals, last strategy, first and last time."""
    # max_by skips nothing: a null strategy must not hide an earlier one, so it is ranked below.
    last = F.max_by("strategy", F.when(F.col("strategy").isNotNull(), F.col("step")))
    return detected.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.sum("tokens_used").alias("total_tokens"),
        F.sum(F.size("signals")).alias("loop_signals"),
        last.alias("last_strategy"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_active"),
    )


# The correction texts, with %s for the tool, step, score or distance.
_HEAD = "[LOOP DETECTOR -- SYSTEM]\n"
REPEAT_TEXT = _HEAD + (
    "You have called %s with identical arguments multiple times within the last several steps. "
    "The results did not change. This approach is not working. You must now:\n"
    "1. Try a fundamentally different tool or approach, OR\n"
    "2. Ask the user for clarification if the task requirements are ambiguous.\n"
    "Do NOT repeat the same call again."
)
SOFT_TEXT = _HEAD + (
    "Your recent action at step %s is semantically very similar (similarity=%s) to actions you took earlier. "
    "You appear to be rephrasing the same failed approach. "
    "The pattern has been recognised -- please try a genuinely different strategy.\n"
    "If you are stuck because of missing information, say so explicitly."
)
STUCK_TEXT = _HEAD + (
    "The last several steps have not added new information to your reasoning. "
    "You are spending tokens without making progress. "
    "Either the task is not solvable with the available tools, or you need to change your approach entirely. "
    "Summarise what you have learned so far, then either ask the user "
    "for additional context or produce a partial answer."
)
CYCLE_TEXT = _HEAD + (
    "A causal cycle has been detected at step %s: you are re-deriving "
    "the same intermediate result through a repeated chain of tool calls. "
    "The output you just produced matches an output from %s steps ago. "
    "You are stuck in a logical loop. Try a different entry point."
)
OTHER_TEXT = _HEAD + (
    "A loop pattern was detected at step %s. Your recent actions are not advancing the task. "
    "Please reconsider your approach."
)
NO_TOOL_TEXT = "your last tool call"
# End of fixed values.


def correction(detected: DataFrame) -> DataFrame:
    """Correction message for each flagged step, chosen by its last signal."""
    last = F.try_element_at("signals", F.lit(-1))
    step = F.col("step").cast("string")
    tool = F.when(F.coalesce("tool_name", F.lit("")) == "", NO_TOOL_TEXT).otherwise(F.concat(F.lit("'"), F.col("tool_name"), F.lit("'")))
    score = F.format_number("best_score", 2) if "best_score" in detected.columns else F.lit("0.00")
    distance = (F.col("step") - F.col("first_step")).cast("string")
    message = (
        F.when(last == "exact_duplicate", F.format_string(REPEAT_TEXT, tool))
        .when(last == "semantic_similarity", F.format_string(SOFT_TEXT, step, score))
        .when(last == "no_progress", F.lit(STUCK_TEXT))
        .when(last == "causal_cycle", F.format_string(CYCLE_TEXT, step, distance))
        .otherwise(F.format_string(OTHER_TEXT, step))
    )
    return detected.where("flagged").withColumn("message", message)


def step_tail(steps: DataFrame, text_rows: int = 20, array_rows: int = 30) -> DataFrame:
    """Per session: the last steps as text lines (arguments cut at 100, observations at 200) and as an array."""
    def cut(col: Column, size: int) -> Column:
        return F.when(F.length(col) <= size, col).otherwise(F.concat(F.substring(col, 1, size), F.lit("...")))

    line = F.format_string(
        "Step %s: %s(%s) -> %s", F.col("step").cast("string"), F.col("tool_name"),
        cut(F.col("tool_args"), 100), cut(F.col("observation"), 200),
    )
    tail = top_per(steps, [KEY], [F.col("step").desc()], max(text_rows, array_rows))
    ordered = F.sort_array(F.collect_list(F.struct("step", "tool_name", "observation")))
    lines = F.sort_array(F.collect_list(F.when(F.col("rank") <= text_rows, F.struct("step", line.alias("line")))))
    return tail.groupBy(KEY).agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("step_log"),
        F.slice(ordered, -F.least(F.lit(array_rows), F.size(ordered)), array_rows).alias("history"),
    )


def tool_timeouts(calls: DataFrame, tool: str = "tool_name", seconds: str = "seconds", cfg: Agents = AGENTS,
                  accuracy: int = 10_000) -> DataFrame:
    """Dynamic time limit per tool: 95th percentile of its history times the multiplier."""
    return calls.groupBy(tool).agg(
        (F.percentile_approx(seconds, 0.95, accuracy) * cfg.timeout_multiplier).alias("timeout_seconds")
    )


def stalled(calls: DataFrame, as_of: Column) -> DataFrame:
    """Calls started but not finished whose age passed their timeout, as one signal each.

    ``calls`` has (exec_id, tool_name, event, ts, timeout_seconds) with event start or finish.
    """
    seconds = as_of.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    starts = calls.where(F.col("event") == "start")
    finishes = calls.where(F.col("event") == "finish").select("exec_id")
    return (
        starts.join(finishes, "exec_id", "left_anti")
        .withColumn("elapsed_seconds", seconds).where(F.col("elapsed_seconds") > F.col("timeout_seconds"))
        .withColumn("signal_type", F.lit("tool_timeout"))
    )


def pending_checkpoints(queue: DataFrame) -> DataFrame:
    """Unresolved reviews, oldest first."""
    return queue.where(F.col("resolved_at").isNull()).orderBy("created_at", "checkpoint_id")


def resolve_checkpoints(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Set who resolved a review, when and why; the latest update of a review wins."""
    newest = latest_per(updates, ["checkpoint_id"], [F.col("resolved_at")]).select(
        "checkpoint_id", F.col("resolved_at").alias("_at"), F.col("resolved_by").alias("_by"), F.col("note").alias("_note")
    )
    return (
        queue.join(newest, "checkpoint_id", "left")
        .withColumn("resolved_at", F.coalesce("_at", "resolved_at"))
        .withColumn("resolved_by", F.coalesce("_by", "resolved_by"))
        .withColumn("note", F.coalesce("_note", "note"))
        .drop("_at", "_by", "_note")
    )
