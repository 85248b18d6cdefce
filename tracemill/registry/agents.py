"""Queries over agent steps (events: session = user, observation = props) and step vectors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracemill.config import AGENTS
from tracemill.functions import keys
from tracemill.operators import agents, metrics
from tracemill.operators.skew import number_rows
from tracemill.registry import query
from tracemill.registry.tables import STEPS_SQL, steps, table
from tracemill.sources import sinks
from tracemill.streaming import flows

# Vectors of the given table are random, so the threshold is lowered for the query to find pairs.
VECTOR_CFG = replace(AGENTS, semantic_threshold=0.25)


def fingerprinted(spark, sf_dir):
    return steps(spark, sf_dir).withColumn(
        "args_hash", keys.call_fingerprint(F.col("tool_name"), F.col("tool_args"))
    )


@query("win1_budget", f"""
WITH {STEPS_SQL}, run AS (
  SELECT session_id, step, sum(tokens_used) OVER (PARTITION BY session_id ORDER BY step) AS tokens FROM steps)
SELECT session_id, step, CAST(tokens AS BIGINT) AS tokens,
       greatest(0, 50 - step) AS steps_left, CAST(greatest(0, 100000 - tokens) AS BIGINT) AS tokens_left,
       CASE WHEN step >= 50 THEN 'steps' WHEN tokens >= 100000 THEN 'tokens' ELSE '' END AS exhausted
FROM run
""")
def win1(spark, sf_dir):
    return agents.budget(steps(spark, sf_dir)).select(
        "session_id", "step", "tokens", "steps_left", "tokens_left",
        F.coalesce("exhausted", F.lit("")).alias("exhausted"),
    )


@query("win2_no_progress", f"""
WITH {STEPS_SQL}, marked AS (
  SELECT session_id, step,
         CASE WHEN row_number() OVER (PARTITION BY session_id, observation ORDER BY step) = 1 THEN 1.0 ELSE 0.0 END AS novelty
  FROM steps), rolled AS (
  SELECT session_id, step,
         avg(novelty) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_novelty
  FROM marked)
SELECT session_id, step, round(CAST(avg_novelty AS DOUBLE), 6) AS avg_novelty,
       step >= 5 AND avg_novelty < 0.05 AS no_progress FROM rolled
""")
def win2(spark, sf_dir):
    return agents.no_progress(steps(spark, sf_dir)).select(
        "session_id", "step", F.round("avg_novelty", 6).alias("avg_novelty"), "no_progress"
    )


@query("win3_causal_cycle", f"""
WITH {STEPS_SQL}, marked AS (
  SELECT session_id, step, step - min(step) OVER (PARTITION BY session_id, observation) AS cycle_length FROM steps)
SELECT session_id, step, cycle_length, cycle_length >= 2 AS causal_cycle FROM marked
""")
def win3(spark, sf_dir):
    return agents.causal_cycle(steps(spark, sf_dir)).select("session_id", "step", "cycle_length", "causal_cycle")


def vector_steps(spark, sf_dir):
    """Steps with vectors: one session per label, in id order."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("session_id"), "vec_id", "embedding")
    return number_rows(vectors, ["session_id"], [F.col("vec_id")], F.floor(F.col("vec_id") / 4096))


@query("win4_soft_loop", """
WITH v AS (
  SELECT label AS session_id, vec_id, embedding::DOUBLE[] AS e,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) AS step FROM embeddings),
best AS (
  SELECT a.session_id, a.step,
         greatest(0.0, coalesce(max(list_cosine_similarity(a.e, b.e)), 0.0)) AS best_score
  FROM v a LEFT JOIN v b ON a.session_id = b.session_id AND b.step BETWEEN a.step - 5 AND a.step - 1
  GROUP BY 1, 2)
SELECT CAST(session_id AS BIGINT) AS session_id, step, round(best_score, 6) AS best_score, best_score >= 0.25 AS soft_loop FROM best
""")
def win4(spark, sf_dir):
    return agents.soft_loop(vector_steps(spark, sf_dir), cfg=VECTOR_CFG).select(
        F.col("session_id").cast("bigint").alias("session_id"), "step",
        F.round("best_score", 6).alias("best_score"), "soft_loop",
    )


FIFO_SQL = f"""
{STEPS_SQL}, fold(session_id, step, kept, repeated) AS (
  SELECT session_id, step, [tool_name || tool_args], false FROM steps WHERE step = 1
  UNION ALL
  SELECT s.session_id, s.step,
         CASE WHEN list_contains(f.kept, s.tool_name || s.tool_args) THEN f.kept
              ELSE list_concat(f.kept, [s.tool_name || s.tool_args])[-10:] END,
         list_contains(f.kept, s.tool_name || s.tool_args)
  FROM fold f JOIN steps s ON s.session_id = f.session_id AND s.step = f.step + 1)
"""


@query("win5_exact_repeat", f"WITH RECURSIVE {FIFO_SQL} SELECT session_id, step, repeated AS exact_repeat FROM fold")
def win5(spark, sf_dir):
    return agents.exact_repeat(fingerprinted(spark, sf_dir))


CONSECUTIVE_SQL = f"""
{STEPS_SQL}, marked AS (
  SELECT session_id, step, step - min(step) OVER (PARTITION BY session_id, observation) >= 2 AS flagged FROM steps),
isles AS (
  SELECT *, sum(CASE WHEN flagged THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY step) AS isle FROM marked),
counted AS (
  SELECT session_id, step, flagged,
         sum(CASE WHEN flagged THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, isle ORDER BY step) AS consecutive
  FROM isles)
"""


@query("win6_consecutive", f"""
WITH {CONSECUTIVE_SQL} SELECT session_id, step, flagged, CAST(consecutive AS BIGINT) AS consecutive FROM counted
""")
def win6(spark, sf_dir):
    flags = agents.causal_cycle(steps(spark, sf_dir)).withColumn("flagged", F.col("causal_cycle"))
    return agents.consecutive(flags).select("session_id", "step", "flagged", "consecutive")


DETECT_SQL = f"""
{FIFO_SQL}, base AS (
  SELECT s.*, f.repeated,
         sum(tokens_used) OVER (PARTITION BY s.session_id ORDER BY s.step) AS tokens,
         min(s.step) OVER (PARTITION BY s.session_id, observation) AS first_step
  FROM steps s JOIN fold f ON s.session_id = f.session_id AND s.step = f.step),
novel AS (
  SELECT *, avg(CASE WHEN step = first_step THEN 1.0 ELSE 0.0 END)
              OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS avg_novelty
  FROM base),
signals AS (
  SELECT *, CASE WHEN step >= 50 THEN 'steps' WHEN tokens >= 100000 THEN 'tokens' END AS exhausted,
         concat_ws(',', CASE WHEN repeated THEN 'exact_duplicate' END,
                   CASE WHEN step >= 50 OR tokens >= 100000 THEN 'budget_exhausted' END,
                   CASE WHEN step >= 5 AND avg_novelty < 0.05 THEN 'no_progress' END,
                   CASE WHEN step - first_step >= 2 THEN 'causal_cycle' END) AS signals
  FROM novel),
isles AS (
  SELECT *, signals <> '' AS flagged,
         sum(CASE WHEN signals = '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step) AS isle FROM signals),
counted AS (
  SELECT *, sum(CASE WHEN flagged THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, isle ORDER BY step) AS consecutive
  FROM isles),
detected AS (
  SELECT *, CASE WHEN NOT flagged THEN '' WHEN consecutive >= 3 THEN 'human_checkpoint'
                 WHEN exhausted IS NOT NULL THEN 'force_summarize' ELSE 'inject_correction' END AS strategy
  FROM counted)
"""


@query("str8_loop_detectors", f"""
WITH RECURSIVE {DETECT_SQL}
SELECT session_id, step, signals, CAST(consecutive AS BIGINT) AS consecutive, strategy FROM detected
""")
def str8(spark, sf_dir):
    return agents.detect(fingerprinted(spark, sf_dir)).select(
        "session_id", "step", F.array_join("signals", ",").alias("signals"), "consecutive",
        F.coalesce("strategy", F.lit("")).alias("strategy"),
    )


@query("dec3_recovery", f"""
WITH RECURSIVE {DETECT_SQL}, stops AS (
  SELECT session_id, min(step) AS stop FROM detected WHERE strategy = 'force_summarize' GROUP BY 1)
SELECT d.session_id, d.step, d.strategy FROM detected d LEFT JOIN stops s ON d.session_id = s.session_id
WHERE s.stop IS NULL OR d.step <= s.stop
""")
def dec3(spark, sf_dir):
    return agents.until_stopped(agents.detect(fingerprinted(spark, sf_dir))).select(
        "session_id", "step", F.coalesce("strategy", F.lit("")).alias("strategy")
    )


@query("agg6_session_stats", f"""
WITH RECURSIVE {DETECT_SQL}
SELECT session_id, count(*) AS total_steps, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
       CAST(sum(CASE WHEN signals = '' THEN 0 ELSE length(signals) - length(replace(signals, ',', '')) + 1 END) AS BIGINT) AS loop_signals,
       coalesce(max_by(strategy, step) FILTER (WHERE strategy <> ''), '') AS last_strategy,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_active
FROM detected GROUP BY session_id
""")
def agg6(spark, sf_dir):
    stats = agents.session_stats(agents.detect(fingerprinted(spark, sf_dir)))
    form = "yyyy-MM-dd HH:mm:ss"
    return stats.select(
        "session_id", "total_steps", "total_tokens", "loop_signals",
        F.coalesce("last_strategy", F.lit("")).alias("last_strategy"),
        F.date_format("started_at", form).alias("started_at"), F.date_format("last_active", form).alias("last_active"),
    )


@query("snk8_signal_rows", f"""
WITH RECURSIVE {DETECT_SQL}, named AS (
  SELECT *, unnest(string_split(signals, ',')) AS signal_type FROM detected WHERE flagged)
SELECT session_id, step, tool_name, signal_type,
       CASE signal_type WHEN 'budget_exhausted' THEN 'steps=' || step || ';tokens=' || tokens
            WHEN 'causal_cycle' THEN 'prior_step=' || first_step || ';cycle_length=' || (step - first_step)
            WHEN 'no_progress' THEN 'avg_novelty=0.0' ELSE 'tool=' || tool_name END AS metadata
FROM named
""")
def snk8(spark, sf_dir):
    rows = agents.signal_rows(agents.detect(fingerprinted(spark, sf_dir)))
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    folder = flows.work_folder(spark)
    for _ in range(2):  # signals that are sent again add nothing
        sinks.append_once(rows.withColumn("metadata", F.array_join(pairs, ";")), folder, "detection")
    return sinks.committed(spark, folder)


@query("txt21_correction", f"""
WITH RECURSIVE {DETECT_SQL}
SELECT session_id, step, CASE string_split(signals, ',')[-1]
  WHEN 'exact_duplicate' THEN '[LOOP DETECTOR -- SYSTEM]' || chr(10) || 'You have called ''' || tool_name || ''' with identical arguments multiple times within the last several steps. The results did not change. This approach is not working. You must now:' || chr(10) || '1. Try a fundamentally different tool or approach, OR' || chr(10) || '2. Ask the user for clarification if the task requirements are ambiguous.' || chr(10) || 'Do NOT repeat the same call again.'
  WHEN 'no_progress' THEN '[LOOP DETECTOR -- SYSTEM]' || chr(10) || 'The last several steps have not added new information to your reasoning. You are spending tokens without making progress. Either the task is not solvable with the available tools, or you need to change your approach entirely. Summarise what you have learned so far, then either ask the user for additional context or produce a partial answer.'
  WHEN 'causal_cycle' THEN '[LOOP DETECTOR -- SYSTEM]' || chr(10) || 'A causal cycle has been detected at step ' || step || ': you are re-deriving the same intermediate result through a repeated chain of tool calls. The output you just produced matches an output from ' || (step - first_step) || ' steps ago. You are stuck in a logical loop. Try a different entry point.'
  ELSE '[LOOP DETECTOR -- SYSTEM]' || chr(10) || 'A loop pattern was detected at step ' || step || '. Your recent actions are not advancing the task. Please reconsider your approach.' END AS message
FROM detected WHERE flagged
""")
def txt21(spark, sf_dir):
    return agents.correction(agents.detect(fingerprinted(spark, sf_dir))).select("session_id", "step", "message")


@query("top9_step_tail", f"""
WITH {STEPS_SQL}, tail AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step DESC) AS back FROM steps)
SELECT session_id,
       string_agg('Step ' || step || ': ' || tool_name || '(' || tool_args || ') -> ' || observation, chr(10) ORDER BY step)
         FILTER (WHERE back <= 20) AS step_log,
       string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) FILTER (WHERE back <= 30) AS history_steps
FROM tail GROUP BY session_id
""")
def top9(spark, sf_dir):
    tail = agents.step_tail(steps(spark, sf_dir))
    return tail.select(
        "session_id", "step_log",
        F.array_join(F.transform("history", lambda h: h["step"].cast("string")), ",").alias("history_steps"),
    )


@query("agg14_tool_timeouts", """
WITH ranked AS (
  SELECT event_type AS tool_name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
         count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT tool_name, round(min(value) FILTER (WHERE rn >= ceil(0.95 * n)) * 3.0, 6) AS timeout_seconds FROM ranked GROUP BY 1
""")
def agg14(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool_name"), F.col("value").alias("seconds"))
    # Exact up to the accuracy: above the number of values it is the exact percentile.
    return agents.tool_timeouts(calls, accuracy=1_000_000).select(
        "tool_name", F.round("timeout_seconds", 6).alias("timeout_seconds")
    )


CALLS_SQL = """
calls AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS exec_id, event_type AS tool_name,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN 'start' ELSE 'finish' END AS event, ts,
         value * 3600 AS timeout_seconds
  FROM events)
"""


def calls(spark, sf_dir):
    """Tool calls from events: purchase and signup finish a call of the same user and key."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("exec_id"),
        F.col("event_type").alias("tool_name"),
        F.when(F.col("event_type").isin("click", "view", "error"), "start").otherwise("finish").alias("event"), "ts",
        (F.col("value") * 3600).alias("timeout_seconds"),
    )


@query("str7_stalled_calls", f"""
WITH {CALLS_SQL}
SELECT exec_id, tool_name, count(*) AS signals, round(max(epoch(TIMESTAMP '2024-01-31') - epoch(ts)), 3) AS elapsed_seconds
FROM calls c
WHERE event = 'start' AND epoch(TIMESTAMP '2024-01-31') - epoch(ts) > timeout_seconds
  AND NOT EXISTS (SELECT 1 FROM calls f WHERE f.event = 'finish' AND f.exec_id = c.exec_id)
GROUP BY 1, 2
""")
def str7(spark, sf_dir):
    found = agents.stalled(calls(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"))
    return found.groupBy("exec_id", "tool_name").agg(
        F.count(F.lit(1)).alias("signals"), F.round(F.max("elapsed_seconds"), 3).alias("elapsed_seconds")
    )


QUEUE_SQL = """
queue AS (
  SELECT event_id AS checkpoint_id, user_id AS session_id, ts AS created_at FROM events WHERE event_type = 'error'),
done AS (
  SELECT e.event_id AS checkpoint_id, max(p.ts) AS resolved_at, max_by('agent ' || p.event_id, p.ts) AS resolved_by
  FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts > e.ts
    AND p.props = e.props
  WHERE e.event_type = 'error' GROUP BY 1)
"""


def review_queue(spark, sf_dir):
    """Reviews are error events; a later purchase of the same user and props resolves one."""
    events = table(spark, sf_dir, "events")
    queue = events.where("event_type = 'error'").select(
        F.col("event_id").alias("checkpoint_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("note"),
    )
    paid = events.where("event_type = 'purchase'").select("user_id", "props", F.col("ts").alias("resolved_at"), "event_id")
    errors = events.where("event_type = 'error'").select("user_id", "props", "ts", F.col("event_id").alias("checkpoint_id"))
    updates = errors.join(paid, ["user_id", "props"]).where("resolved_at > ts").select(
        "checkpoint_id", "resolved_at", F.format_string("agent %s", F.col("event_id").cast("string")).alias("resolved_by"),
        F.lit("paid").alias("note"),
    )
    return queue, updates


@query("flt13_review_queue", f"""
WITH {QUEUE_SQL}
SELECT q.checkpoint_id, q.session_id, d.resolved_at IS NULL AS pending,
       coalesce(d.resolved_by, '') AS resolved_by
FROM queue q LEFT JOIN done d USING (checkpoint_id)
""")
def flt13(spark, sf_dir):
    queue, updates = review_queue(spark, sf_dir)
    return agents.resolve_checkpoints(queue, updates).select(
        "checkpoint_id", "session_id", F.col("resolved_at").isNull().alias("pending"),
        F.coalesce("resolved_by", F.lit("")).alias("resolved_by"),
    )


@query("flt13_pending_reviews", f"""
WITH {QUEUE_SQL}
SELECT q.checkpoint_id, q.session_id FROM queue q LEFT JOIN done d USING (checkpoint_id) WHERE d.resolved_at IS NULL
""")
def flt13_pending(spark, sf_dir):
    queue, updates = review_queue(spark, sf_dir)
    return agents.pending_checkpoints(agents.resolve_checkpoints(queue, updates)).select("checkpoint_id", "session_id")


@query("agg15_counters", """
SELECT event_type AS label, count(*) AS total FROM events GROUP BY 1
""")
def agg15(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events"), "event_type").withColumnRenamed("event_type", "label")


@query("agg16_histogram", """
WITH edges AS (SELECT unnest([1, 6, 12, 24, 48, 72]) AS le)
SELECT event_type AS label, 'le_' || le AS bucket, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS total
FROM events, edges GROUP BY 1, 2
UNION ALL SELECT event_type, 'le_inf', count(*) FROM events GROUP BY 1
UNION ALL SELECT event_type, 'sum', CAST(sum(CAST(value AS DECIMAL(18, 2))) * 100 AS BIGINT) FROM events GROUP BY 1
""")
def agg16(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    edges = (1, 6, 12, 24, 48, 72)
    wide = metrics.histogram(events, "value", edges, ["event_type"])
    parts = [f"'le_{e}', le_{e}" for e in edges] + ["'le_inf', count", "'sum', cast(sum * 100 as bigint)"]
    return wide.selectExpr("event_type as label", f"stack({len(parts)}, {', '.join(parts)}) as (bucket, total)")


@query("agg17_gauges", """
SELECT event_type AS label, count(*) AS count, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 2) AS sum,
       max_by(value, struct_pack(ts, event_id)) AS last_value
FROM events GROUP BY 1
""")
def agg17(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    gauges = metrics.gauges(events, ["event_type"], "value", [F.col("ts"), F.col("event_id")])
    return gauges.select(
        F.col("event_type").alias("label"), "count", F.round(F.col("sum").cast("double"), 2).alias("sum"),
        F.col("last_value").cast("double").alias("last_value"),
    )


@query("agg1_freshness", """
WITH h AS (SELECT event_type AS kind, (epoch(TIMESTAMP '2024-01-31') - epoch(max(ts))) / 3600 AS hours FROM events GROUP BY 1)
SELECT kind, round(hours, 2) AS hours, hours > 24 AS alert FROM h
""")
def agg1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return metrics.freshness(events, "event_type", "ts", F.lit("2024-01-31").cast("timestamp")).withColumnRenamed(
        "event_type", "kind"
    )


@query("txt12_call_fingerprint", """
SELECT event_id, sha256(event_type || ':{"k": ' || json_extract_string(props, '$.k') || '}') AS args_hash FROM events
""")
def txt12(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", keys.call_fingerprint(F.col("event_type"), F.col("props")).alias("args_hash")
    )


@query("txt12_deep_fingerprint", """
SELECT event_id, sha256(event_type || ':{"k": ' || json_extract_string(props, '$.k') || '}') AS args_hash FROM events
""")
def txt12_deep(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", keys.call_fingerprint(F.col("event_type"), F.col("props")).alias("args_hash")
    )
