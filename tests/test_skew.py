"""Bucketed helpers against plain windows and serial loops, with one key holding most rows."""

import random
from collections import deque

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import agents, skew


def skewed(spark, rows=900, seed=3):
    rng = random.Random(seed)
    data = [(1 if rng.random() < 0.6 else rng.randrange(2, 9), i, rng.randrange(6), rng.randrange(40)) for i in range(rows)]
    return spark.createDataFrame(data, "session_id long, at long, mark long, tokens_used long")


def plain_numbers(df):
    return df.withColumn("step", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("long"))


def test_number_rows_equals_row_number(spark):
    df = skewed(spark)
    got = skew.number_rows(df, ["session_id"], [F.col("at")], F.floor(F.col("at") / 17))
    assert sorted(got.select("at", "step").collect()) == sorted(plain_numbers(df).select("at", "step").collect())


def test_neighbours_equal_lag_and_lead(spark):
    df, w = skewed(spark), Window.partitionBy("session_id").orderBy("at")
    for helper, plain in ((skew.previous_row, F.lag), (skew.next_row, F.lead)):
        got = helper(df, ["session_id"], [F.col("at")], F.floor(F.col("at") / 13), ["mark"], "n").select("at", "n.mark")
        want = df.select("at", plain("mark").over(w).alias("mark"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_equals_window_for_small_blocks(spark):
    df = plain_numbers(skewed(spark))
    w = Window.partitionBy("session_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    got = skew.running(df, ["session_id"], "step", {"s": (F.sum, F.col("tokens_used")), "m": (F.max, F.col("mark"))}, 16)
    want = df.select("at", F.sum("tokens_used").over(w).alias("s"), F.max("mark").over(w).alias("m"))
    assert sorted(got.select("at", "s", "m").collect()) == sorted(want.collect())


def fifo(rows, size):
    kept, flags = {}, {}
    for session, step, mark in sorted(rows):
        recent = kept.setdefault(session, deque(maxlen=size))
        flags[session, step] = mark in recent
        if mark not in recent:
            recent.append(mark)
    return flags


def test_exact_repeat_in_blocks_equals_serial_fold(spark):
    df = plain_numbers(skewed(spark)).withColumn("args_hash", F.concat(F.col("tokens_used").cast("string"), F.lit("-"), F.col("mark") % 2))
    rows = [(r.session_id, r.step, r.args_hash) for r in df.collect()]
    want = fifo(rows, 10)
    for block in (7, 64, 10_000):
        got = {(r.session_id, r.step): r.exact_repeat for r in agents.exact_repeat(df, block_rows=block).collect()}
        assert got == want


def test_a_flagged_step_is_not_kept(spark):
    marks = ["a", "b", "a", *[f"x{i}" for i in range(9)], "a", "b"]
    df = spark.createDataFrame([(1, i + 1, m) for i, m in enumerate(marks)], "session_id long, step long, args_hash string")
    got = [r.exact_repeat for r in agents.exact_repeat(df).orderBy("step").collect()]
    # The print of step 1 is ten kept prints back at step 13: still in reach, and gone once another is kept.
    assert got == list(fifo([(1, i + 1, m) for i, m in enumerate(marks)], 10).values())
    assert got[2] and not any(got[3:12])


def test_detectors_do_not_depend_on_block_size(spark):
    df = plain_numbers(skewed(spark)).select(
        "session_id", "step", F.lit("tool").alias("tool_name"), F.lit("{}").alias("tool_args"), F.col("mark").cast("string").alias("observation"),
        (F.col("tokens_used") * 100).alias("tokens_used"), F.col("tokens_used").cast("string").alias("args_hash"), F.timestamp_seconds("at").alias("ts"),
    )
    columns = ["session_id", "step", "signals", "consecutive", "strategy", "tokens"]
    small = agents.detect(df, block_rows=11).select(*columns).collect()
    large = agents.detect(df).select(*columns).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))
    w = Window.partitionBy("session_id").orderBy("step")
    plain = df.withColumn("tokens", F.sum("tokens_used").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted((r.session_id, r.step, r.tokens) for r in small) == sorted((r.session_id, r.step, r.tokens) for r in plain.collect())


def test_budget_boundaries(spark):
    df = spark.createDataFrame([(1, i, 2_500) for i in range(1, 52)], "session_id long, step long, tokens_used long")
    got = {r.step: (r.exhausted, r.steps_left, r.tokens_left) for r in agents.budget(df, block_rows=8).collect()}
    assert got[39] == (None, 11, 2_500)
    assert got[40] == ("tokens", 10, 0)
    assert got[50] == ("steps", 0, 0)


def test_cycle_needs_a_distance_of_two(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "x")], "session_id long, step long, observation string")
    assert [r.causal_cycle for r in agents.causal_cycle(df).orderBy("step").collect()] == [False, False, True]


def test_small_side_hints_only_small_tables(spark):
    df = spark.range(50)
    assert "broadcast" in skew.small_side(df, 100)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in skew.small_side(df, 10)._jdf.queryExecution().analyzed().toString().lower()
