"""Appends that take each batch once, and the tree over all heads of the audit chain."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import audit
from tracemill.sources import sinks
from tracemill.streaming import flows


def test_a_batch_is_appended_once_and_only_with_its_commit(spark):
    folder = flows.work_folder(spark)
    assert sinks.append_once(spark.range(3), folder, 0) and sinks.append_once(spark.range(3, 5), folder, "run.1-a")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        calls.add(1)
        return i

    assert not sinks.append_once(spark.range(9).select(counted("id").alias("id")), folder, 0) and calls.value == 0
    spark.range(50, 60).write.parquet(f"{folder}/rows/commit_batch=b-7/commit_attempt=a-lost")  # no commit: an attempt that died
    assert sorted(r.id for r in sinks.committed(spark, folder).collect()) == [0, 1, 2, 3, 4]
    assert sinks.append_once(spark.range(70, 71), folder, 7)
    assert sorted(r.id for r in sinks.committed(spark, folder).collect()) == [0, 1, 2, 3, 4, 70]
    # a second writer of the same batch commits too: one of both counts
    spark.range(70, 71).write.parquet(f"{folder}/rows/commit_batch=b-7/commit_attempt=a-0")
    spark.createDataFrame([("a-0",)], "commit_attempt string").write.mode("append").parquet(f"{folder}/commits/commit_batch=b-7")
    assert sinks.committed(spark, folder).where("id = 70").count() == 1
    assert sinks.append_once(spark.range(0), folder, 8) and sinks.committed(spark, folder).count() == 6
    with pytest.raises(ValueError):
        sinks.append_once(spark.range(1), folder, "a/b")


def test_rows_without_any_commit_are_not_read(spark):
    folder = flows.work_folder(spark)
    spark.range(3).write.parquet(f"{folder}/rows/commit_batch=b-0/commit_attempt=a-lost")
    assert sinks.committed(spark, folder).count() == 0


def test_a_failed_side_fails_the_batch_and_the_next_run_fills_it_in(spark, monkeypatch):
    folder = flows.work_folder(spark)
    batch = spark.createDataFrame([(1, "x"), (2, "y")], "session_id long, event string")
    write, real = sinks.two_sinks(f"{folder}/messages", f"{folder}/table"), sinks.append_once

    def broken(rows, target, number):
        if target.endswith("messages"):
            raise OSError("down")
        return real(rows, target, number)

    monkeypatch.setattr(sinks, "append_once", broken)
    with pytest.raises(OSError):
        write(batch, 4)
    assert sinks.committed(spark, f"{folder}/table").count() == 2  # the other side was tried
    monkeypatch.setattr(sinks, "append_once", real)
    write(batch, 4)
    write(batch, 4)
    assert sinks.committed(spark, f"{folder}/table").count() == 2 and sinks.committed(spark, f"{folder}/messages").count() == 2


def test_a_stream_that_loses_its_checkpoint_doubles_nothing(spark):
    folder = flows.work_folder(spark)
    spark.range(10).coalesce(1).write.parquet(f"{folder}/in")
    for attempt in range(2):
        feed = spark.readStream.schema("id long").parquet(f"{folder}/in")
        flows.each_batch(feed, sinks.append_batches(f"{folder}/out"), f"{folder}/{attempt}")
    assert sorted(r.id for r in sinks.committed(spark, f"{folder}/out").collect()) == list(range(10))


def heads(spark, changes=(), without=()):
    rows = [(i, 3, dict(changes).get(i, f"h{i}")) for i in range(300) if i not in without]
    return spark.createDataFrame(rows, "patient_id long, sequence long, head string")


def test_the_tree_finds_altered_deleted_and_new_patients(spark):
    old, now = heads(spark, without=[250]), heads(spark, {7: "forged"}, without=[12])
    trees = [audit.merkle_tree(h, 2) for h in (old, now)]
    assert {r.patient_id: r.kind for r in audit.changed_patients(trees[0], old, trees[1], now, 2).collect()} == {7: "changed", 12: "missing", 250: "new"}
    suspects = {r.patient_id for r in audit.changed_patients(trees[0], None, trees[1], now, 2).collect()}
    assert {7, 250} <= suspects and len(suspects) < 30
    again = audit.merkle_tree(old.repartition(5), 2)
    assert sorted(again.collect()) == sorted(trees[0].collect()) and again.where("level = 0").count() == 1
    assert audit.changed_patients(trees[0], old, again, old, 2).count() == 0
    assert audit.merkle_tree(old.limit(0), 2).count() == 0 and audit.merkle_depth(old) == 1 and audit.merkle_depth(old, 1) == 3
