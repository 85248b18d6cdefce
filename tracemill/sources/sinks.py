"""Writing: tiers, appended events and results, audit rows to two places, indexed vectors."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.keys import point_id
from tracemill.operators.relational import upsert

LOG = logging.getLogger(__name__)


def write_tiered(articles: DataFrame, folder: str) -> None:
    """One partition per tier; only the tiers present are overwritten."""
    (
        articles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("tier").parquet(folder)
    )


def append_once(rows: DataFrame, folder: str, batch: str | int) -> bool:
    """Append the rows of a batch exactly once; false, without computing a row, if the batch is there already.

    The rows of an attempt go to a folder of their own. The last step writes one commit row that names batch and
    attempt; :func:`committed` reads nothing else, so a lost or repeated attempt leaves no row behind. ``batch`` names
    the same rows whenever it comes again: a micro-batch number, a run id.
    """
    name = f"b-{batch}"
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"a batch name has letters, digits, '.', '_' and '-' only: {batch!r}")
    commit = f"{folder}/commits/commit_batch={name}"
    if _read(rows.sparkSession, commit).limit(1).count():
        return False
    attempt = f"a-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/rows/commit_batch={name}/commit_attempt={attempt}")
    rows.sparkSession.range(1).select(F.lit(attempt).alias("commit_attempt")).coalesce(1).write.mode("append").parquet(commit)
    return True


def _read(spark: SparkSession, commits: str) -> DataFrame:
    """Commit rows, none where nothing was committed yet."""
    try:
        return spark.read.schema("commit_attempt string").parquet(commits)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "commit_attempt string, commit_batch string")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of committed batches. Of two attempts that both committed a batch the first by name counts.

    Attempts are partitions, so the files of others are pruned at the scan. A folder without rows is an error, as for any table.
    """
    valid = _read(spark, f"{folder}/commits").groupBy("commit_batch").agg(F.min("commit_attempt").alias("commit_attempt"))
    keys = ["commit_batch", "commit_attempt"]
    return spark.read.parquet(f"{folder}/rows").join(valid, keys, "left_semi").drop(*keys)


def append_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that appends each micro-batch exactly once; its numbers belong to one checkpoint and folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, folder, batch_id)

    return write


def with_run(results: DataFrame, run_id: str) -> DataFrame:
    """Results tagged with their run, ready to append."""
    return results.withColumn("run_id", F.lit(run_id))


def audit_messages(entries: DataFrame) -> DataFrame:
    """(key, value) rows of audit entries, keyed by session."""
    return entries.select(
        F.col("session_id").cast("string").alias("key"), F.to_json(F.struct(*entries.columns)).alias("value")
    )


def two_sinks(stream_folder: str, table_folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of audit rows: messages to one folder, columns to another.

    Both sides are tried; a failure of one does not stop the other, but fails the batch afterwards, so that the stream
    runs it again. The side that was written then is left as it is. Read both with :func:`committed`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        failed = []
        for folder, rows in ((stream_folder, audit_messages(batch)), (table_folder, batch)):
            try:
                append_once(rows, folder, batch_id)
            except Exception as error:
                LOG.exception("audit batch %s not written to %s", batch_id, folder)
                failed.append(error)
        if failed:
            raise failed[0]

    return write


def index_points(index: DataFrame | None, rows: DataFrame, name: Column, version: Column) -> DataFrame:
    """Vector points with a 63-bit id of their name; the last write of a name wins.

    ``version`` orders the writes of one name.
    """
    points = rows.withColumn("point_id", point_id(name)).withColumn("version", version)
    target = index if index is not None else points.limit(0)
    return upsert(target, points, ["point_id"], [F.col("version")])
