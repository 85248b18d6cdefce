"""Streams fed file by file give what their batch counterparts give on the whole table."""

import json
import pickle
import random
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracemill.functions import keys
from tracemill.operators import agents, articles, refunds
from tracemill.registry import streams
from tracemill.registry.articles import vector_articles
from tracemill.registry.tables import steps, table
from tracemill.streaming import flows, processors

SF_DIR = "/root/testdata/sf0.001"


def in_files(spark, df, order, folder, parts=3):
    """The table cut by ``order`` into files that arrive one per micro-batch."""
    edges = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    bounds = [float("-inf"), *edges, float("inf")]
    for i in range(parts):
        part = df.where((F.col(order) > bounds[i]) & (F.col(order) <= bounds[i + 1])).drop(order)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.drop(order).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_velocity_stream_equals_batch(spark):
    folder = flows.work_folder(spark)
    events = table(spark, SF_DIR, "events").select((F.col("user_id") % 4).alias("user_id"), "event_id", "ts", F.unix_timestamp("ts").cast("double").alias("o"))
    got = flows.drain(processors.velocity_stream(in_files(spark, events, "o", folder)), folder, by_clock=True)
    want = refunds.velocity_gate(events.drop("o"))
    assert not got.where("late").count()
    assert sorted(got.drop("late").collect()) == sorted(want.select("user_id", "event_id", "admitted").collect())


def test_loop_stream_equals_batch(spark):
    folder = flows.work_folder(spark)
    rows = steps(spark, SF_DIR).withColumn("args_hash", keys.call_fingerprint(F.col("tool_name"), F.col("tool_args")))
    rows = rows.withColumn("session_id", F.lit(1).cast("long")).withColumn("o", F.unix_timestamp("ts").cast("double"))
    feed = rows.select("session_id", "event_id", "ts", "args_hash", "observation", "tokens_used", "o")
    got = flows.drain(processors.loop_stream(in_files(spark, feed, "o", folder)), folder, by_clock=True)
    from tracemill.operators.skew import number_rows
    numbered = number_rows(rows.drop("step", "o"), ["session_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("day", "ts"))
    want = agents.detect(numbered, block_rows=64).select(
        "session_id", "step", F.array_join("signals", ",").alias("signals"), "consecutive", F.coalesce("strategy", F.lit("")).alias("strategy")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_seen_gate_expires_and_renews(spark):
    folder, day = flows.work_folder(spark), 86_400
    rows = [(1, "f", 0), (2, "f", 6 * day), (3, "f", 12 * day), (4, "f", 19 * day), (5, "", 20 * day), (6, "g", 20 * day), (7, "f", 20 * day)]
    df = spark.createDataFrame(rows, "article_id long, fingerprint string, s long").select(
        "article_id", "fingerprint", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("published_at"), F.col("s").cast("double").alias("o")
    )
    got = flows.drain(processors.seen_gate(in_files(spark, df, "o", folder)), folder, by_clock=True)
    assert {r.article_id: r.seen for r in got.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True}


def test_once_stream_replays_and_forgets(spark):
    folder, day = flows.work_folder(spark), 86_400
    rows = [(1, "k", 1.0, 0), (2, "k", 2.0, day), (3, "k", 3.0, 6 * day), (4, "k", 4.0, 7 * day), (5, "k", 5.0, 8 * day)]
    df = spark.createDataFrame(rows, "request_id long, idempotency_key string, amount double, s long").select(
        "request_id", "idempotency_key", "amount", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("requested_at"), F.col("s").cast("double").alias("o")
    )
    got = flows.drain(processors.once_stream(in_files(spark, df, "o", folder, 2)), folder, by_clock=True)
    assert {r.request_id: (r.result_request, r.replayed) for r in got.collect()} == {
        1: (1, False), 2: (1, True), 3: (1, True), 4: (4, False), 5: (4, True)}


def test_stall_stream_signals_once(spark):
    folder = flows.work_folder(spark)
    rows = [("a", "t", "start", 0, 10.0), ("b", "t", "start", 0, 10.0), ("b", "t", "finish", 5, 10.0), ("c", "t", "start", 0, 1e6), ("z", "t", "start", 500, 10.0)]
    df = spark.createDataFrame(rows, "exec_id string, tool_name string, event string, s long, timeout_seconds double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    df = df.withColumn("o", F.col("s").cast("double")).drop("s")
    got = flows.drain(processors.stall_stream(in_files(spark, df, "o", folder, 2)), folder)
    assert [r.exec_id for r in got.collect()] == ["a"]


def test_stall_stream_sees_a_finish_past_the_timeout_in_the_same_batch(spark):
    folder = flows.work_folder(spark)
    rows = [("a", "t", "start", 0, 10.0), ("a", "", "finish", 11, 0.0), ("b", "t", "start", 0, 10.0), ("b", "", "finish", 10, 0.0), ("c", "t", "start", 5, 10.0), ("c", "", "finish", 5, 0.0)]
    df = spark.createDataFrame(rows, "exec_id string, tool_name string, event string, s long, timeout_seconds double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    df = df.drop("s")
    df.coalesce(1).write.parquet(f"{folder}/in")
    got = flows.drain(processors.stall_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in")), folder)
    assert [(r.exec_id, r.tool_name) for r in got.collect()] == [("a", "t")]


def late_files(spark, rows, schema, at, folder):
    """One file a row, in the order given, whatever the times say."""
    df = spark.createDataFrame([(*row, float(i)) for i, row in enumerate(rows)], f"{schema}, o double")
    return in_files(spark, df.withColumn(at, F.timestamp_seconds(F.col(at) + 1_700_000_000)), "o", folder, len(rows))


def test_late_rows_are_judged_not_dropped(spark):
    day = 86_400
    folder = flows.work_folder(spark)
    feed = late_files(spark, [(1, "f", 30 * day), (2, "f", 2 * day), (3, None, 0), (4, "", 0), (5, "g", 0)], "article_id long, fingerprint string, published_at long", "published_at", folder)
    got = flows.drain(processors.seen_gate(feed), folder, by_clock=True)
    assert {r.article_id: (r.seen, r.late) for r in got.collect()} == {
        1: (False, False), 2: (True, True), 3: (True, False), 4: (True, False), 5: (False, False)}
    folder = flows.work_folder(spark)
    feed = late_files(spark, [(7, i, s) for i, s in enumerate([5 * day] * 4 + [0, 0, 6 * day])], "user_id long, event_id long, ts long", "ts", folder)
    got = flows.drain(processors.velocity_stream(feed), folder, by_clock=True)
    assert {r.event_id: (r.admitted, r.late) for r in got.collect()} == {
        **{i: (True, False) for i in range(4)}, 4: (True, True), 5: (False, True), 6: (True, False)}


def test_once_stream_keeps_decimals_and_late_requests(spark):
    folder = flows.work_folder(spark)
    feed = late_files(spark, [(1, "k", Decimal("0.10"), 900_000), (2, "k", Decimal("0.20"), 0), (3, "j", Decimal("0.30"), 0)], "request_id long, idempotency_key string, amount decimal(12,2), requested_at long", "requested_at", folder)
    got = flows.drain(processors.once_stream(feed), folder, by_clock=True)
    assert {r.request_id: (r.result_request, r.result_amount, r.replayed, r.late) for r in got.collect()} == {
        1: (1, Decimal("0.10"), False, False), 2: (1, Decimal("0.10"), True, True), 3: (3, Decimal("0.30"), False, False)}


def test_once_stream_takes_requests_without_time_in_any_batch(spark):
    folder = flows.work_folder(spark)
    feed = late_files(spark, [(1, "k", 1.0, None), (2, "k", 2.0, None), (3, "k", 3.0, 0), (4, "k", 4.0, 5)], "request_id long, idempotency_key string, amount double, requested_at long", "requested_at", folder)
    got = flows.drain(processors.once_stream(feed), folder, by_clock=True)
    assert {r.request_id: (r.result_request, r.replayed, r.late) for r in got.collect()} == {
        1: (1, False, False), 2: (2, False, False), 3: (3, False, False), 4: (3, True, False)}


class CountedState:
    """A map state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]


def test_first_steps_cost_few_state_calls(spark):
    state, want, at = CountedState(), {}, (1, 0)
    digests = [f"{i * 0x9E3779B97F4A7C15 % 2**64:016x}" for i in range(2_000)]
    for begin in range(0, 3_000, 500):
        firsts = processors._Firsts(state, *at)
        for step in range(begin, begin + 500):
            digest = digests[step * 7 % 2_000]
            assert firsts.step(digest, step) == want.get(digest)
            want.setdefault(digest, step)
        at = firsts.write()
    assert at[1] == len(want) == 2_000 and max(len(json.loads(v[0])) for v in state.rows.values()) < 3 * processors.PART_ROWS
    assert state.calls < 500
    before = state.calls
    firsts = processors._Firsts(state, *at)
    assert firsts.step(digests[7], 9_000) == 1 and firsts.step("f" * 16, 9_001) is None
    firsts.write()
    assert state.calls - before == 3


class CountedValue:
    """A value state that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


class Handle:
    """States of one group, timers and the two clocks, without a stream."""

    def __init__(self):
        self.states, self.timers, self.now, self.mark = {}, set(), 0, 0

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, CountedValue())

    def getMapState(self, name, key, schema, ttl=None):
        return self.states.setdefault(name, CountedState())

    def calls(self):
        return sum(s.calls for s in self.states.values())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_once_judges_many_keys_with_few_state_calls(spark):
    handle, once = Handle(), processors._Once(604_800_000_000)
    once.init(handle)

    def judged(first, keys, at):
        rows = [Row(request_id=first + i, idempotency_key=f"k{k}", amount=1.0, at=at) for i, k in enumerate(keys)]
        return {r.request_id: (r.result_request, r.replayed) for r in once.handleInputRows((0,), iter(rows), handle)}

    assert judged(0, range(5_000), 0) == {i: (i, False) for i in range(5_000)}
    assert handle.calls() < 500
    handle.now = 1_000_000
    assert judged(5_000, range(5_000), 1) == {5_000 + i: (i, True) for i in range(5_000)}
    assert handle.calls() < 1_500 and max(len(pickle.loads(v[0])) for v in handle.states["first"].rows.values()) < 3 * processors.PART_ROWS
    before = handle.calls()
    assert judged(10_000, [7], 2) == {10_000: (7, True)}
    assert handle.calls() - before == 4
    # A day after its lifetime a key is forgotten by the wall clock, whatever else lies in its part.
    handle.now += 604_800_000 + processors.SLACK_MS
    assert judged(10_001, [7, 8], 3) == {10_001: (10_001, False), 10_002: (10_002, False)}
    parts, count = handle.states["size"].value
    assert count < 5_000


def test_stall_judges_many_calls_with_few_state_calls_and_one_timer(spark):
    handle, stall = Handle(), processors._Stall()
    stall.init(handle)

    def judged(event, calls, at, timeout=None):
        rows = [Row(exec_id=f"c{c}", tool_name=f"t{c}", event=event, at=at, timeout_seconds=timeout) for c in calls]
        return [tuple(r) for r in stall.handleInputRows((0,), iter(rows), handle)]

    def expired(mark):
        handle.mark, found = mark, []
        for timer in sorted(t for t in handle.timers if t <= mark):
            found += [r.exec_id for r in stall.handleExpiredTimer((0,), handle, None)]
            handle.deleteTimer(timer)
        return sorted(found)

    assert judged("start", range(5_000), 0, 10.0) == []
    assert judged("start", range(5_000, 5_100), 0, 20.0) == []
    assert handle.calls() < 700 and handle.timers == {10_001}
    # In time, and too late before the watermark has come that far.
    assert judged("finish", range(2_400), 10_000_000) == []
    assert judged("finish", range(2_400, 2_500), 10_000_001) == [(f"c{c}", f"t{c}", "tool_timeout") for c in range(2_400, 2_500)]
    assert expired(10_000) == [] and expired(10_001) == sorted(f"c{c}" for c in range(2_500, 5_000))
    assert handle.timers == {20_001}
    # A row without time, a start without timeout and a finish of an unknown call change nothing.
    assert judged("finish", [5_001], None) == [] and judged("start", [9], None, 1.0) == [] and judged("start", [9], 5, None) == []
    assert judged("finish", [1], 99_000_000) == []
    assert expired(30_000) == sorted(f"c{c}" for c in range(5_000, 5_100))
    assert not handle.timers and not handle.states["open"].rows and handle.states["size"].value is None


def test_stall_stream_equals_a_serial_run_over_many_calls(spark):
    draw, rows = random.Random(3), []
    for i in range(300):
        start, wait = draw.randrange(1_000), draw.randrange(1, 60)
        rows.append((f"c{i}", f"t{i % 5}", "start", start, 30.0))
        if i % 3:
            rows.append((f"c{i}", "", "finish", start + wait, 0.0))
    mark = max(r[3] for r in rows) - 60
    times = {(r[0], r[2]): r[3] for r in rows}
    want = {c for c, e in times if e == "start" and (times[c, "finish"] - times[c, e] > 30 if (c, "finish") in times else mark > times[c, e] + 30)}
    folder = flows.work_folder(spark)
    df = spark.createDataFrame(rows, "exec_id string, tool_name string, event string, s long, timeout_seconds double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).withColumn("o", F.col("s").cast("double")).drop("s")
    got = flows.drain(processors.stall_stream(in_files(spark, df, "o", folder)), folder).collect()
    assert len(got) == len(want) and {r.exec_id for r in got} == want


def test_stalled_calls_begin_with_the_first_start_that_has_a_time(spark):
    folder = flows.work_folder(spark)
    rows = [(0, None, 1, "click", 0.001, '{"k": 1}'), (1, 0, 1, "view", 0.001, '{"k": 1}'), (2, 3_600, 2, "click", 0.001, '{"k": 1}'), (3, 0, 3, "view", None, '{"k": 1}')]
    df = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).write.parquet(f"{folder}/events.parquet")
    assert [(r.exec_id, r.tool_name) for r in streams.str7(spark, folder).collect()] == [("1:1", "view")]


def test_once_stream_equals_a_serial_run_over_many_keys(spark):
    day, draw = 86_400, random.Random(7)
    rows = [(i, draw.choice([None, "", *"abcdefgh"]), Decimal(i), i * day // 8) for i in range(400)]
    folder = flows.work_folder(spark)
    df = spark.createDataFrame(rows, "request_id long, idempotency_key string, amount decimal(12,2), s long").select(
        "request_id", "idempotency_key", "amount", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("requested_at"), F.col("s").cast("double").alias("o")
    )
    got = flows.drain(processors.once_stream(in_files(spark, df, "o", folder)), folder, by_clock=True)
    want, first = {}, {}
    for request, key, amount, at in rows:
        replayed = key in first and at - first[key][2] < 7 * day
        if not replayed:
            first[key] = (request, amount, at)
        want[request] = (*first[key][:2], replayed, False)
    assert {r.request_id: (r.result_request, r.result_amount, r.replayed, r.late) for r in got.collect()} == want


def test_a_stream_reads_a_table_in_several_files(spark):
    folder = flows.work_folder(spark)
    spark.range(50).repartition(3).write.parquet(f"{folder}/one/events.parquet")
    spark.range(5).write.parquet(f"{folder}/one/other.parquet")
    got = flows.drain(streams.stream(spark, f"{folder}/one", "events"), f"{folder}/run")
    assert sorted(r.id for r in got.collect()) == list(range(50))


def test_loop_stream_equals_batch_on_many_outputs(spark):
    folder = flows.work_folder(spark)
    rows = spark.range(900).select(
        F.lit("s").alias("session_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
        (F.col("id") % 31).cast("string").alias("args_hash"), (F.col("id") % 401).cast("string").alias("observation"), F.lit(1).cast("long").alias("tokens_used"),
    )
    feed = in_files(spark, rows.withColumn("o", F.col("event_id").cast("double")), "o", folder)
    got = flows.drain(processors.loop_stream(feed), folder, by_clock=True)
    want = agents.detect(rows.withColumn("step", F.col("event_id") + 1)).select(
        "session_id", "step", F.array_join("signals", ",").alias("signals"), "consecutive", F.coalesce("strategy", F.lit("")).alias("strategy")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_loop_stream_frees_quiet_sessions(spark):
    folder = flows.work_folder(spark)
    feed = late_files(spark, [(s, i, i, "a", "o", 1) for i, s in enumerate([1, 2, 1])], "session_id long, event_id long, ts long, args_hash string, observation string, tokens_used long", "ts", folder)
    got = flows.drain(processors.loop_stream(feed, idle_seconds=0), folder, by_clock=True)
    assert sorted((r.session_id, r.step) for r in got.collect()) == [(1, 1), (1, 1), (2, 1)]


def test_supersede_batches_equal_one_run(spark):
    folder = flows.work_folder(spark)
    rows = vector_articles(spark, SF_DIR).select("article_id", "fingerprint", "published_at", "tier", "stale", "embedding").where("not stale")
    rows = rows.withColumn("o", F.unix_timestamp("published_at").cast("double"))
    flows.each_batch(in_files(spark, rows, "o", folder), flows.supersede_batches(folder), folder)
    got = spark.read.parquet(f"{folder}/stale").select("article_id", "superseded_by")
    want = articles.supersede(rows.drop("o")).select("article_id", "superseded_by")
    assert sorted(got.collect()) == sorted(want.collect())


def test_run_once_survives_a_second_run_of_a_batch(spark):
    folder = flows.work_folder(spark)
    write = flows.run_once(folder, "k")
    first, second = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in ("ab", "bc"))
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert sorted(r.k for r in spark.read.parquet(folder).collect()) == ["a", "b", "c"]


def test_new_urls_across_files(spark):
    folder = flows.work_folder(spark)
    df = spark.createDataFrame([("u1", 0), ("u2", 1), ("u1", 2)], "url string, s long").select("url", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), F.col("s").cast("double").alias("o"))
    got = flows.drain(flows.new_urls(in_files(spark, df, "o", folder), "at"), folder)
    assert sorted(r.url for r in got.collect()) == ["u1", "u2"]
