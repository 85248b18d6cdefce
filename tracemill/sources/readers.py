"""Reading and decoding: message values, feeds, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import ARTICLES
from tracemill.functions.text import html_to_text
from tracemill.operators.skew import latest_per

ARTICLE_SCHEMA = (
    "url string, source string, title string, body string, published_at string, "
    "raw_tags array<string>, scraped_at string, _corrupt string"
)


def decode_articles(values: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(articles, rejects) from JSON message values, batch or stream.

    A value is rejected when it is not JSON of the article schema, or lacks a
    required field or a readable time; rejects keep the raw text.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    raw = F.col(value).cast("string")
    parsed = values.withColumn("_raw", raw).withColumn("_a", F.from_json("_raw", ARTICLE_SCHEMA, options))
    needed = [F.col(f"_a.{c}").isNotNull() for c in ("url", "source", "title", "body")]
    when = F.try_to_timestamp("_a.published_at")
    good = F.col("_a._corrupt").isNull() & when.isNotNull()
    for present in needed:
        good = good & present
    good = F.coalesce(good, F.lit(False))
    articles = parsed.where(good).select(
        "_a.url", "_a.source", "_a.title", "_a.body", when.alias("published_at"),
        F.coalesce("_a.raw_tags", F.array().cast("array<string>")).alias("raw_tags"),
    )
    return articles, parsed.where(~good).select(F.col("_raw").alias("value"))


def encode_articles(articles: DataFrame, scraped_at: Column) -> DataFrame:
    """(key, value) rows for a message topic: the URL is the key, so a URL stays in one partition."""
    body = F.to_json(F.struct(
        "url", "source", "title", "body", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        "raw_tags", F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"),
    ))
    return articles.select(F.col("url").alias("key"), body.alias("value"))


def kafka_articles(spark: SparkSession, servers: str, topic: str = "raw-articles",
                   max_offsets: int = ARTICLES.stream_batch) -> DataFrame:
    """Streaming message values from a topic, from the earliest offset (needs the Kafka connector on the class path)."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets).load()
    )


def file_messages(spark: SparkSession, folder: str, max_files: int = ARTICLES.stream_batch) -> DataFrame:
    """Streaming message values from text files, one JSON message per line."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)


def parse_published(published: Column, updated: Column, ingest_time: Column) -> Column:
    """Publication time from RFC 822 or ISO text: published, else updated, else the ingest time.

    The stated zone is dropped and the clock time is read as UTC.
    """
    def read(value: Column) -> Column:
        clock = F.regexp_extract(value, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1)
        return F.coalesce(
            F.try_to_timestamp(F.when(clock != "", clock), F.lit("d MMM yyyy HH:mm:ss")),
            F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-"), value)),
        )

    return F.coalesce(read(published), read(updated), ingest_time)


FEED_SCHEMA = (
    "link string, title string, content string, description string, pubDate string, updated string, "
    "category array<string>"
)


def read_feed_files(spark: SparkSession, paths: str) -> DataFrame:
    """Items of feed files (``<item>`` rows of XML) with their file and where in it their block begins."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED_SCHEMA).load(paths)
    return items.select("*", F.col("_metadata.file_path").alias("feed_file"), F.col("_metadata.file_block_start").alias("feed_block"))


def feed_articles(items: DataFrame, source: Column, ingest_time: Column, seen: DataFrame | None = None,
                  max_chars: int | None = None) -> DataFrame:
    """Articles from feed items: no link or no text is skipped, a URL counts once, seen URLs are skipped.

    Content comes before the description. The URL is used up by its first
    item even when that item has no text. Items of :func:`read_feed_files` are
    in the order of file name and place in the file, however the files are
    split over tasks; others are in the order of the rows.
    """
    place = [F.col(c).alias(f"_{c}") for c in ("feed_file", "feed_block") if c in items.columns]
    rows = items.where(F.coalesce("link", F.lit("")) != "").select(
        F.col("link").alias("url"), source.alias("source"), F.coalesce("title", F.lit("")).alias("title"),
        html_to_text(F.coalesce(F.when(F.col("content") != "", F.col("content")), "description", F.lit("")), max_chars).alias("body"),
        parse_published(F.col("pubDate"), F.col("updated"), ingest_time).alias("published_at"),
        F.coalesce("category", F.array().cast("array<string>")).alias("raw_tags"),
        *place, F.monotonically_increasing_id().alias("_position"),
    )
    order = [c for c in rows.columns if c in ("_feed_file", "_feed_block", "_position")]
    firsts = latest_per(rows, ["url"], [F.col(c) for c in order], newest=False).drop(*order)
    if seen is not None:
        firsts = firsts.join(seen.select("url"), "url", "left_anti")
    return firsts.where(F.col("body") != "")


LOG_SIGNALS = "copied boolean, re_asked_within_60s boolean, edit_distance_after_copy double, thumbs_up boolean"
LOG_CASES = "array<struct<input_data:string,expected_output:string,timeout_seconds:double>>"


def load_logs(logs: DataFrame, task_type: str | None = None, limit: int | None = None) -> DataFrame:
    """All log entries, or the newest ``limit``, with their JSON columns decoded; missing signals and cases get defaults."""
    rows = logs.where(F.col("task_type") == task_type) if task_type else logs
    if limit is not None:
        rows = rows.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)
    signals = F.from_json("implicit_signals", LOG_SIGNALS)
    return rows.withColumn("implicit_signals", F.struct(
        F.coalesce(signals["copied"], F.lit(False)).alias("copied"),
        F.coalesce(signals["re_asked_within_60s"], F.lit(False)).alias("re_asked_within_60s"),
        F.coalesce(signals["edit_distance_after_copy"], F.lit(1.0)).alias("edit_distance_after_copy"),
        signals["thumbs_up"].alias("thumbs_up"),
    )).withColumn("test_cases", F.coalesce(F.from_json("test_cases", LOG_CASES), F.array().cast(LOG_CASES))).withColumn(
        "language", F.coalesce("language", F.lit("python"))
    )
