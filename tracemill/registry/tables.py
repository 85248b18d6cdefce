"""The given tables, seen as the tables the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.skew import number_rows, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; times without zone become UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    # Text costs far more to work on than to move: use all cores even when the file is one piece.
    return spread(df) if name in TEXT_TABLES else df


TEXT_TABLES = ("documents", "pages", "conversations")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent steps from events: one session per user, steps in time order."""
    named = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("tool_name"),
        F.col("props").alias("tool_args"), F.col("props").alias("observation"),
        F.floor(F.col("value") * 50).cast("bigint").alias("tokens_used"),
    )
    return number_rows(named, ["session_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"))


STEPS_SQL = """
steps AS (
  SELECT user_id AS session_id, event_id, ts, event_type AS tool_name, props AS tool_args, props AS observation,
         CAST(floor(value * 50) AS BIGINT) AS tokens_used,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
  FROM events)
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card transactions from orders: the customer is the user, status F is refunded, low priority is not eligible."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.col("o_orderpriority").alias("merchant"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "F").alias("refunded"),
        (F.col("o_orderpriority") != "5-LOW").alias("refund_eligible"),
    )


TRANSACTIONS_SQL = """
tx AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         o_orderpriority AS merchant, o_orderdate AS created_at,
         o_orderstatus = 'F' AS refunded, o_orderpriority <> '5-LOW' AS refund_eligible
  FROM orders)
"""


def hashed_vectors_sql(name: str, source: str, key: str, body: str) -> str:
    """CTEs ending in ``name(key, e)``: the model-free vectors of a text column, for SQL."""
    return f"""
{name}_words AS (SELECT {key}, list_filter(regexp_split_to_array(lower({body}), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM {source}),
{name}_pairs AS (
  SELECT {key}, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS pair
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w), 2))) AS i FROM {name}_words WHERE len(w) > 0)),
{name}_hashed AS (SELECT {key}, ('0x' || substr(md5(pair), 1, 4))::INT AS h FROM {name}_pairs),
{name}_cells AS (SELECT {key}, h % 64 AS i, sum(CASE WHEN h < 32768 THEN 1 ELSE -1 END) AS c FROM {name}_hashed GROUP BY 1, 2),
{name}_norms AS (SELECT {key}, sqrt(sum(c * c)) AS n FROM {name}_cells GROUP BY 1),
{name} AS (
  SELECT d.{key}, list(CASE WHEN n.n > 0 THEN CAST(coalesce(c.c, 0) / n.n AS FLOAT)::DOUBLE ELSE 0.0 END ORDER BY r.i) AS e
  FROM {source} d CROSS JOIN (SELECT unnest(range(64)) AS i) r
  LEFT JOIN {name}_norms n ON n.{key} = d.{key} LEFT JOIN {name}_cells c ON c.{key} = d.{key} AND c.i = r.i GROUP BY 1)
"""


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two list columns, 0 when one has no length."""
    return (
        f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
        f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)"
    )
