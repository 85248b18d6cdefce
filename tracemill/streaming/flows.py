"""Streams built from plain operators, ``foreachBatch`` writers, and the timed tier jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import ARTICLES, Articles
from tracemill.operators import articles as article_steps
from tracemill.operators.skew import shared_folder
from tracemill.sources.readers import decode_articles


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, folder: str, by_clock: bool = False) -> DataFrame:
    """Run a stream over what is available now, resumable from its checkpoint, and read its output.

    ``by_clock`` is for streams whose state expires by the wall clock: Spark
    would go on with batches without rows for ever, since a timer may yet run.
    """
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA_BATCHES)
    conf.set(NO_DATA_BATCHES, str(not by_clock).lower())
    running = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    # The running stream keeps the settings it was started with.
    conf.set(NO_DATA_BATCHES, before)
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> None:
    """Run ``write`` on every micro-batch that is available now."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def article_stream(messages: DataFrame) -> DataFrame:
    """Articles of a stream of JSON messages; unreadable messages are left out (see ``rejected_stream``)."""
    return decode_articles(messages)[0]


def rejected_stream(messages: DataFrame) -> DataFrame:
    return decode_articles(messages)[1]


def new_urls(pages: DataFrame, ts: str, keep: str = "7 days") -> DataFrame:
    """First row per URL across polls, remembered for ``keep`` of event time."""
    return pages.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["url"])


def attempt_windows(requests: DataFrame, delay: str = "1 hour", size: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Requests per user in sliding windows of event time."""
    return (
        requests.withWatermark("ts", delay).groupBy("user_id", F.window("ts", size, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("attempts"))
        .select("user_id", F.col("w.start").alias("window_start"), "attempts")
    )


def overwrite_batch(rows: DataFrame, batch_id: int, folder: str) -> None:
    """Write one batch to its own partition: running it again replaces it."""
    (
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)
    )


def read_or_none(spark: SparkSession, folder: str) -> DataFrame | None:
    """A parquet folder, or nothing when no batch was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(folder) if files.exists(path) and len(files.listStatus(path)) else None


def run_once(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """Writer that does each key once, also after a crash: keys of other batches are left out."""
    def write(batch: DataFrame, batch_id: int) -> None:
        done = read_or_none(batch.sparkSession, folder)
        rows = batch.dropDuplicates([key])
        if done is not None:
            rows = rows.join(done.where(F.col("batch_id") != batch_id).select(key), key, "left_anti")
        overwrite_batch(rows, batch_id, folder)

    return write


def alerts(event_folder: str, alert_folder: str, levels: tuple[str, ...] = ("CRITICAL", "HIGH")) -> Callable[[DataFrame, int], None]:
    """Writer of security events: all to one folder, those of the given severities also to another."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        overwrite_batch(batch, batch_id, event_folder)
        overwrite_batch(batch.where(F.col("severity").isin(*levels)), batch_id, alert_folder)
        batch.unpersist()

    return write


def supersede_batches(folder: str, cfg: Articles = ARTICLES) -> Callable[[DataFrame, int], None]:
    """Writer of accepted articles: stores the batch and marks what it makes stale.

    ``folder/articles`` and ``folder/stale`` hold one partition per batch; an
    article already stale is not marked again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored, stale = read_or_none(spark, f"{folder}/articles"), read_or_none(spark, f"{folder}/stale")
        older = batch
        if stored is not None:
            older = stored.where(F.col("batch_id") != batch_id).drop("batch_id").unionByName(batch)
        older = older.where(F.col("tier").isin("hot", "warm"))
        if stale is not None:
            older = older.join(stale.where(F.col("batch_id") != batch_id).select("article_id"), "article_id", "left_anti")
        overwrite_batch(article_steps.supersede(older, cfg, newer=batch), batch_id, f"{folder}/stale")
        overwrite_batch(batch, batch_id, f"{folder}/articles")

    return write


def tier_jobs(articles: DataFrame, as_of: Column, cfg: Articles = ARTICLES) -> tuple[DataFrame, DataFrame]:
    """(sizes, archived): the tier check and the daily archive, called by any scheduler."""
    return article_steps.tier_sizes(articles), article_steps.archive_cold(articles, as_of, cfg.archive_after_days)
