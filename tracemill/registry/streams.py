"""Streams over the given tables, run to the end of what is available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import keys
from tracemill.operators.skew import previous_row
from tracemill.registry import query
from tracemill.registry.agents import CALLS_SQL, DETECT_SQL, calls
from tracemill.registry.articles import ARTICLES_SQL, SIMILAR_SQL, plain_articles, vector_articles
from tracemill.registry.guard import LAYERS_SQL, layered
from tracemill.registry.refunds import VELOCITY_SQL
from tracemill.registry.tables import table
from tracemill.sources import sinks
from tracemill.streaming import flows, processors


def stream(spark, sf_dir, name):
    """A given table as a stream, whether it is one file or a folder of files; times without zone become UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A stream takes a single file only by a pattern.
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def dealt(df):
    """Rows of a stream dealt out to all cores: for work on single rows that costs more than to move them, when a file is read in few pieces."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def replay(spark, df, folder):
    """A derived table written once and read back as a stream."""
    df.write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


@query("str1_article_stream", """
SELECT 'https://p.example/' || page_id AS url, length(html) AS chars FROM pages WHERE page_id % 5 > 0
""")
def str1(spark, sf_dir):
    folder = flows.work_folder(spark)
    pages = stream(spark, sf_dir, "pages")
    body = F.to_json(F.struct(
        F.concat(F.lit("https://p.example/"), "page_id").alias("url"), F.lit("p").alias("source"), F.lit("t").alias("title"),
        F.col("html").alias("body"), F.lit("2024-01-01T00:00:00").alias("published_at"),
    ))
    damaged = F.when(F.col("page_id") % 5 == 0, F.substring(body, 1, 30)).otherwise(body)
    found = flows.drain(flows.article_stream(pages.select(damaged.alias("value"))), folder)
    return found.select("url", F.length("body").cast("bigint").alias("chars"))


@query("str2_seen_gate", f"""
WITH {ARTICLES_SQL}, before AS (SELECT article_id, fingerprint, epoch(published_at) - epoch(lag(published_at) OVER (PARTITION BY fingerprint ORDER BY published_at, article_id)) AS gap FROM arts)
SELECT article_id, fingerprint = '' OR coalesce(gap < 604800, false) AS seen FROM before
""")
def str2(spark, sf_dir):
    folder = flows.work_folder(spark)
    rows = plain_articles(spark, sf_dir).select("article_id", "fingerprint", "published_at")
    found = flows.drain(processors.seen_gate(replay(spark, rows, f"{folder}/in")), folder, by_clock=True)
    return found.select("article_id", "seen")


@query("str2_seen_gate_batch", f"""
WITH {ARTICLES_SQL}, before AS (SELECT article_id, fingerprint, epoch(published_at) - epoch(lag(published_at) OVER (PARTITION BY fingerprint ORDER BY published_at, article_id)) AS gap FROM arts)
SELECT article_id, fingerprint = '' OR coalesce(gap < 604800, false) AS seen FROM before
""")
def str2_batch(spark, sf_dir):
    rows = plain_articles(spark, sf_dir).select("article_id", "fingerprint", "published_at")
    linked = previous_row(
        rows, ["fingerprint"], [F.col("published_at"), F.col("article_id")], F.date_trunc("minute", "published_at"), ["published_at"], "prev"
    )
    gap = F.unix_timestamp("published_at") - F.unix_timestamp("prev.published_at")
    return linked.select("article_id", ((F.col("fingerprint") == "") | F.coalesce(gap < 604_800, F.lit(False))).alias("seen"))


@query("str3_velocity_stream", f"WITH RECURSIVE {VELOCITY_SQL} SELECT user_id, event_id, admitted FROM gate")
def str3(spark, sf_dir):
    requests = stream(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return flows.drain(processors.velocity_stream(requests), flows.work_folder(spark), by_clock=True).select("user_id", "event_id", "admitted")


@query("str4_attempt_windows", """
WITH slots AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS window_start FROM events, (SELECT unnest(range(4)) AS i))
SELECT user_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS attempts FROM slots GROUP BY 1, 2
""")
def str4(spark, sf_dir):
    counted = flows.attempt_windows(table(spark, sf_dir, "events"))
    return counted.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "attempts")


@query("str4_closed_windows", """
WITH slots AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS window_start FROM events, (SELECT unnest(range(4)) AS i)),
mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events)
SELECT user_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS attempts FROM slots, mark WHERE window_start + INTERVAL 1 DAY <= w GROUP BY 1, 2
""")
def str4_stream(spark, sf_dir):
    counted = flows.drain(flows.attempt_windows(stream(spark, sf_dir, "events")), flows.work_folder(spark))
    return counted.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "attempts")


@query("str5_once_stream", """
WITH RECURSIVE req AS (
  SELECT event_id, user_id || ':' || event_type || ':' || props AS k, ts, value, row_number() OVER (PARTITION BY user_id || ':' || event_type || ':' || props ORDER BY ts, event_id) AS n FROM events),
run(k, n, event_id, first_id, first_amount, first_ts, replayed) AS (
  SELECT k, n, event_id, event_id, value, ts, false FROM req WHERE n = 1
  UNION ALL SELECT r.k, r.n, r.event_id, CASE WHEN r.ts - f.first_ts < INTERVAL 7 DAY THEN f.first_id ELSE r.event_id END, CASE WHEN r.ts - f.first_ts < INTERVAL 7 DAY THEN f.first_amount ELSE r.value END,
    CASE WHEN r.ts - f.first_ts < INTERVAL 7 DAY THEN f.first_ts ELSE r.ts END, r.ts - f.first_ts < INTERVAL 7 DAY FROM run f JOIN req r ON r.k = f.k AND r.n = f.n + 1)
SELECT event_id AS request_id, first_id AS result_request, first_amount AS result_amount, replayed FROM run
""")
def str5(spark, sf_dir):
    requests = stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", "props").alias("idempotency_key"),
        F.col("value").alias("amount"), F.col("ts").alias("requested_at"),
    )
    found = flows.drain(processors.once_stream(requests), flows.work_folder(spark), by_clock=True)
    return found.select("request_id", "result_request", "result_amount", "replayed")


@query("str6_resume", """
SELECT DISTINCT user_id || ':' || props AS work_key FROM events
""")
def str6(spark, sf_dir):
    folder = flows.work_folder(spark)
    work = stream(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "props").alias("work_key"))
    flows.each_batch(work, flows.run_once(f"{folder}/ledger", "work_key"), folder)
    return spark.read.parquet(f"{folder}/ledger").select("work_key")


@query("str7_stall_stream", f"""
WITH {CALLS_SQL}, starts AS (SELECT * FROM calls WHERE event = 'start' QUALIFY row_number() OVER (PARTITION BY exec_id ORDER BY ts, tool_name, timeout_seconds) = 1),
ends AS (SELECT exec_id, min(f.ts) AS done FROM calls f JOIN starts s USING (exec_id) WHERE f.event = 'finish' AND f.ts >= s.ts GROUP BY 1),
mark AS (SELECT greatest((SELECT max(ts) FROM starts), (SELECT max(done) FROM ends)) - INTERVAL 1 MINUTE AS w)
SELECT exec_id, tool_name FROM starts LEFT JOIN ends USING (exec_id), mark
WHERE CASE WHEN done IS NOT NULL THEN epoch_us(done) - epoch_us(ts) > timeout_seconds * 1000000
           ELSE epoch_us(w) // 1000 >= CAST(floor((epoch_us(ts) + timeout_seconds * 1000000) / 1000) AS BIGINT) + 1 END
""")
def str7(spark, sf_dir):
    folder = flows.work_folder(spark)
    # The first start of each call and the first finish after it.
    given = calls(spark, sf_dir)
    starts = given.where("event = 'start' and ts is not null").groupBy("exec_id").agg(F.min(F.struct("ts", "tool_name", "timeout_seconds")).alias("s")).select(
        "exec_id", "s.tool_name", F.lit("start").alias("event"), "s.ts", "s.timeout_seconds"
    )
    ends = given.where("event = 'finish'").join(starts.select("exec_id", F.col("ts").alias("since")), "exec_id").where("ts >= since")
    ends = ends.groupBy("exec_id").agg(F.min("ts").alias("ts")).select(
        "exec_id", F.lit("").alias("tool_name"), F.lit("finish").alias("event"), "ts", F.lit(0.0).alias("timeout_seconds")
    )
    found = flows.drain(processors.stall_stream(replay(spark, starts.unionByName(ends), f"{folder}/in")), folder)
    return found.select("exec_id", "tool_name")


@query("str8_loop_stream", f"""
WITH RECURSIVE {DETECT_SQL} SELECT session_id, step, signals, CAST(consecutive AS BIGINT) AS consecutive, strategy FROM detected
""")
def str8_stream(spark, sf_dir):
    steps = dealt(stream(spark, sf_dir, "events")).select(
        F.col("user_id").alias("session_id"), "event_id", "ts", keys.call_fingerprint(F.col("event_type"), F.col("props")).alias("args_hash"),
        F.col("props").alias("observation"), F.floor(F.col("value") * 50).cast("bigint").alias("tokens_used"),
    )
    return flows.drain(processors.loop_stream(steps), flows.work_folder(spark), by_clock=True)


@query("str9_supersede_stream", f"""
WITH {SIMILAR_SQL}, fits AS (
  SELECT base_id AS article_id, query_id AS superseded_by, qt FROM scored WHERE qf = bf AND qf <> '' AND score >= 0.85 AND NOT bs AND NOT qs AND epoch(qt) - epoch(bt) >= 300)
SELECT article_id, min_by(superseded_by, struct_pack(qt, superseded_by)) AS superseded_by FROM fits GROUP BY 1
""")
def str9(spark, sf_dir):
    folder = flows.work_folder(spark)
    rows = vector_articles(spark, sf_dir).select("article_id", "fingerprint", "published_at", "tier", "stale", "embedding").where("not stale")
    flows.each_batch(replay(spark, rows, f"{folder}/in"), flows.supersede_batches(folder), folder)
    return spark.read.parquet(f"{folder}/stale").select("article_id", "superseded_by")


@query("str10_tier_jobs", f"""
WITH {ARTICLES_SQL}
SELECT 'size' AS job, tier AS name, count(*) AS articles FROM arts GROUP BY 2
UNION ALL SELECT 'archived', 'cold', count(*) FROM arts WHERE tier = 'warm' AND published_at < TIMESTAMP '2024-01-24' AND NOT stale
""")
def str10(spark, sf_dir):
    sizes, archived = flows.tier_jobs(plain_articles(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"))
    moved = archived.where("tier = 'cold'").agg(F.count(F.lit(1)).alias("articles"))
    return sizes.select(F.lit("size").alias("job"), F.col("tier").alias("name"), "articles").unionByName(
        moved.select(F.lit("archived").alias("job"), F.lit("cold").alias("name"), "articles")
    )


@query("str11_new_urls", "SELECT DISTINCT 'https://p.example/' || page_id // 3 AS url FROM pages")
def str11(spark, sf_dir):
    pages = stream(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://p.example/"), F.floor(F.col("page_id") / 3)).alias("url"), F.lit("2024-01-01").cast("timestamp").alias("polled_at"),
    )
    return flows.drain(flows.new_urls(pages, "polled_at"), flows.work_folder(spark)).select("url")


@query("str12_alerts", f"""
WITH {LAYERS_SQL}
SELECT id, 'event' AS sink FROM layered WHERE blocked_by <> ''
UNION ALL SELECT id, 'alert' FROM layered WHERE blocked_by <> '' AND id % 2 = 0
""")
def str12(spark, sf_dir):
    folder = flows.work_folder(spark)
    raised = layered(spark, sf_dir).where("verdict = 'UNSAFE'").select(
        "id", "category", F.when(F.col("id") % 2 == 0, "HIGH").otherwise(F.col("severity")).alias("severity")
    )
    flows.each_batch(replay(spark, raised, f"{folder}/in"), flows.alerts(f"{folder}/events", f"{folder}/alerts"), folder)
    parts = [spark.read.parquet(f"{folder}/{name}s").select("id", F.lit(name).alias("sink")) for name in ("event", "alert")]
    return parts[0].unionByName(parts[1])


@query("snk4_write_tiered", f"""
WITH {ARTICLES_SQL} SELECT article_id, tier FROM arts
""")
def snk4(spark, sf_dir):
    folder = flows.work_folder(spark)
    sinks.write_tiered(plain_articles(spark, sf_dir).select("article_id", "tier"), f"{folder}/tiers")
    return spark.read.parquet(f"{folder}/tiers").select("article_id", "tier")


@query("snk5_audit_sinks", """
SELECT event_id, 'message' AS sink FROM events UNION ALL SELECT event_id, 'table' FROM events
""")
def snk5(spark, sf_dir):
    folder = flows.work_folder(spark)
    entries = stream(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type", "value")
    flows.each_batch(entries, sinks.two_sinks(f"{folder}/messages", f"{folder}/rows"), folder)
    sent = sinks.committed(spark, f"{folder}/messages").select(
        F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), F.lit("message").alias("sink")
    )
    return sent.unionByName(sinks.committed(spark, f"{folder}/rows").select("event_id", F.lit("table").alias("sink")))
