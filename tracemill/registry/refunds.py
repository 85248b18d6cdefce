"""Queries over refund transactions (orders) and refund requests (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import keys
from tracemill.functions.dates import age_days
from tracemill.operators import metrics, refunds, relational
from tracemill.registry import query
from tracemill.registry.tables import TRANSACTIONS_SQL, table, transactions

AS_OF = "1998-06-30"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("flt1_candidates", f"""
WITH {TRANSACTIONS_SQL}
SELECT transaction_id, user_id, CAST(amount AS DOUBLE) AS amount, merchant FROM tx
WHERE NOT refunded AND refund_eligible AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY AND merchant ILIKE '%medium%'
""")
def flt1(spark, sf_dir):
    found = refunds.candidates(transactions(spark, sf_dir), as_of(), days=900, merchant="medium")
    return found.select("transaction_id", "user_id", F.col("amount").cast("double").alias("amount"), "merchant")


CHECKED_SQL = f"""
{TRANSACTIONS_SQL}, checked AS (
  SELECT *, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) AS age,
         CASE WHEN user_id % 50 = 7 THEN 'not owned by this account' WHEN refunded THEN 'already refunded'
              WHEN NOT refund_eligible THEN 'product type not eligible for refund'
              WHEN floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400) > 30 THEN 'outside 30-day refund window' END AS reason
  FROM tx)
"""


def checked(spark, sf_dir):
    """Every transaction checked against an owner; one user in fifty asks for another account's money."""
    owner = F.when(F.col("user_id") % 50 == 7, F.lit(-1)).otherwise(F.col("user_id"))
    return transactions(spark, sf_dir).withColumn("reason", refunds.rejection(as_of(), owner))


@query("flt2_eligibility", f"""
WITH {CHECKED_SQL} SELECT transaction_id, coalesce(reason, '') AS reason FROM checked
""")
def flt2(spark, sf_dir):
    return checked(spark, sf_dir).select("transaction_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("flt3_split_eligible", f"""
WITH {CHECKED_SQL}
SELECT user_id AS session_id, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(*) FILTER (WHERE reason IS NOT NULL) AS ineligible,
       CASE WHEN count(*) FILTER (WHERE reason IS NULL) = 0 THEN 'ineligible' ELSE 'pending_evidence' END AS status
FROM checked GROUP BY 1
""")
def flt3(spark, sf_dir):
    return refunds.split_eligible(checked(spark, sf_dir).withColumn("session_id", F.col("user_id")))[0]


@query("flt3_reasons", f"""
WITH {CHECKED_SQL} SELECT user_id AS session_id, transaction_id, reason FROM checked WHERE reason IS NOT NULL
""")
def flt3_reasons(spark, sf_dir):
    return refunds.split_eligible(checked(spark, sf_dir).withColumn("session_id", F.col("user_id")))[1]


@query("flt4_selection", f"""
WITH {TRANSACTIONS_SQL}, cand AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, transaction_id) AS position
  FROM tx WHERE NOT refunded AND refund_eligible)
SELECT user_id AS session_id, position, transaction_id FROM cand
WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND position IN (1, 3)) OR (user_id % 3 = 2 AND position IN (2, 99))
""")
def flt4(spark, sf_dir):
    wish = F.element_at(F.array(F.lit("All"), F.lit("1, 3"), F.lit("2,99")), (F.col("user_id") % 3 + 1).cast("int"))
    cand = refunds.candidates(transactions(spark, sf_dir), as_of(), days=36_500).withColumn("session_id", F.col("user_id"))
    return refunds.select_by_index(cand.withColumn("selection", wish), "session_id", "selection").select(
        "session_id", "position", "transaction_id"
    )


@query("flt5_mark_refunded", f"""
WITH {TRANSACTIONS_SQL}
SELECT transaction_id, refunded OR r.k IS NOT NULL AS refunded, r.k IS NOT NULL AS now_refunded
FROM tx LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') r ON r.k = transaction_id
""")
def flt5(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("transaction_id"))
    marked = refunds.mark_refunded(transactions(spark, sf_dir), done, as_of())
    return marked.select("transaction_id", "refunded", F.col("refunded_at").isNotNull().alias("now_refunded"))


@query("joi14_recheck", f"""
WITH {TRANSACTIONS_SQL}, latest AS (
  SELECT l_orderkey AS transaction_id, bool_or(l_returnflag = 'R') AS refunded FROM lineitem GROUP BY 1)
SELECT t.transaction_id, coalesce(l.refunded, false) AS refunded_now FROM tx t LEFT JOIN latest l USING (transaction_id)
""")
def joi14(spark, sf_dir):
    latest = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("transaction_id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("refunded")
    )
    return refunds.recheck(transactions(spark, sf_dir), latest).select("transaction_id", "refunded_now")


WORK_SQL = f"""
{TRANSACTIONS_SQL}, lines AS (
  SELECT l_orderkey AS transaction_id, bool_or(l_returnflag = 'R') AS failed, bool_or(l_returnflag = 'A') AS done
  FROM lineitem GROUP BY 1),
work AS (
  SELECT t.user_id AS session_id, t.*, NOT t.refunded AND t.refund_eligible AS eligible,
         CASE WHEN l.failed THEN 'failed' WHEN l.done THEN 'success' END AS outcome
  FROM tx t LEFT JOIN lines l USING (transaction_id))
"""


def work(spark, sf_dir):
    """Refund work: one session per user; returned lines failed, accepted ones succeeded."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("transaction_id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("failed"), F.bool_or(F.col("l_returnflag") == "A").alias("done")
    )
    tx = transactions(spark, sf_dir).withColumn("session_id", F.col("user_id"))
    return tx.join(lines, "transaction_id", "left").withColumn(
        "eligible", ~F.col("refunded") & F.col("refund_eligible")
    ).withColumn("outcome", F.when(F.col("failed"), "failed").when(F.col("done"), "success")).drop("failed", "done")


@query("joi15_pending_work", f"""
WITH {WORK_SQL} SELECT transaction_id FROM work WHERE eligible AND outcome IS NULL
""")
def joi15(spark, sf_dir):
    every = work(spark, sf_dir)
    return refunds.pending_work(
        every.where("eligible"), every.where("outcome = 'success'"), every.where("outcome = 'failed'")
    ).select("transaction_id")


@query("set6_newly_done", f"""
WITH {WORK_SQL} SELECT count(*) AS newly_done FROM work WHERE outcome = 'success' AND NOT refunded
""")
def set6(spark, sf_dir):
    every = work(spark, sf_dir)
    fresh = refunds.newly_done(every.where("outcome = 'success'"), every.where("refunded"))
    return fresh.agg(F.count(F.lit(1)).alias("newly_done"))


@query("joi16_apply_once", """
WITH req AS (
  SELECT event_id AS request_id, user_id || ':' || event_type || ':' || props AS idempotency_key, ts AS requested_at, value AS amount
  FROM events),
ledger AS (SELECT idempotency_key, request_id, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY requested_at, request_id) AS rn FROM req
  WHERE requested_at < TIMESTAMP '2024-01-15') WHERE rn = 1),
later AS (SELECT * FROM req WHERE requested_at >= TIMESTAMP '2024-01-15'),
firsts AS (SELECT idempotency_key, min_by(request_id, struct_pack(requested_at, request_id)) AS first_id,
                  min_by(amount, struct_pack(requested_at, request_id)) AS first_amount FROM later GROUP BY 1)
SELECT l.request_id, coalesce(g.request_id, f.first_id) AS result_request, coalesce(g.amount, f.first_amount) AS result_amount,
       g.request_id IS NOT NULL OR l.request_id <> f.first_id AS replayed
FROM later l JOIN firsts f USING (idempotency_key) LEFT JOIN ledger g USING (idempotency_key)
""")
def joi16(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", "props").alias("idempotency_key"),
        F.col("ts").alias("requested_at"), F.col("value").alias("amount"),
    )
    split = F.lit("2024-01-15").cast("timestamp")
    ledger = relational.insert_absent(
        None, requests.where(F.col("requested_at") < split), ["idempotency_key"], [F.col("requested_at"), F.col("request_id")]
    )
    once = refunds.apply_once(requests.where(F.col("requested_at") >= split), ledger)
    return once.select("request_id", "result_request", "result_amount", "replayed")


@query("agg7_refund_totals", f"""
WITH {WORK_SQL}
SELECT session_id, count(*) AS candidates, CAST(sum(amount) AS DOUBLE) AS candidate_amount,
       CAST(coalesce(sum(amount) FILTER (WHERE eligible), 0) AS DOUBLE) AS eligible_amount,
       CAST(coalesce(sum(amount) FILTER (WHERE outcome = 'success'), 0) AS DOUBLE) AS refunded_amount,
       count(*) FILTER (WHERE outcome = 'success') AS succeeded, count(*) FILTER (WHERE outcome = 'failed') AS failed,
       CASE WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'partially_completed' ELSE 'completed' END AS status
FROM work GROUP BY 1
""")
def agg7(spark, sf_dir):
    totals = refunds.refund_totals(work(spark, sf_dir))
    for name in ("candidate_amount", "eligible_amount", "refunded_amount"):
        totals = totals.withColumn(name, F.col(name).cast("double"))
    return totals


@query("win11_attempts_24h", """
SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second,
       count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) - 1 AS attempts
FROM events
""")
def win11(spark, sf_dir):
    return refunds.attempts(table(spark, sf_dir, "events")).select("user_id", "second", "attempts")


VELOCITY_SQL = """
req AS (
  SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS second,
         row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS step FROM events),
gate(user_id, step, event_id, live, admitted) AS (
  SELECT user_id, step, event_id, [second], true FROM req WHERE step = 1
  UNION ALL
  SELECT r.user_id, r.step, r.event_id,
         CASE WHEN len(list_filter(g.live, lambda t: t > r.second - 86400)) >= 5 THEN list_filter(g.live, lambda t: t > r.second - 86400)
              ELSE list_concat(list_filter(g.live, lambda t: t > r.second - 86400), [r.second]) END,
         len(list_filter(g.live, lambda t: t > r.second - 86400)) < 5
  FROM gate g JOIN req r ON r.user_id = g.user_id AND r.step = g.step + 1)
"""


@query("win12_velocity_gate", f"WITH RECURSIVE {VELOCITY_SQL} SELECT user_id, event_id, admitted FROM gate")
def win12(spark, sf_dir):
    return refunds.velocity_gate(table(spark, sf_dir, "events")).select("user_id", "event_id", "admitted")


SESSIONS_SQL = f"""
{VELOCITY_SQL}, {WORK_SQL}, refused AS (SELECT user_id, bool_and(admitted) AS velocity_ok FROM gate GROUP BY 1),
grades AS (SELECT doc_id AS user_id, quality, toxic FROM labels),
sessions AS (
  SELECT w.session_id, w.session_id % 7 <> 0 AS confirmed, count(*) AS candidates, coalesce(any_value(r.velocity_ok), true) AS velocity_ok,
         count(*) FILTER (WHERE eligible) AS eligible, coalesce(sum(amount) FILTER (WHERE eligible), 0) AS total_amount,
         any_value(CASE WHEN g.quality IS NOT NULL THEN 0.55 + 0.35 * g.quality END) AS confidence_score,
         coalesce(any_value(g.toxic) = 1, false) AS requires_human
  FROM work w LEFT JOIN refused r ON r.user_id = w.session_id LEFT JOIN grades g ON g.user_id = w.session_id GROUP BY w.session_id),
triaged AS (
  SELECT *, CASE WHEN NOT confirmed THEN 'pending_confirmation' WHEN candidates = 0 THEN 'ineligible'
                 WHEN NOT velocity_ok THEN 'escalated' WHEN eligible = 0 THEN 'ineligible'
                 WHEN confidence_score IS NULL THEN 'pending_evidence'
                 WHEN requires_human OR confidence_score < 0.85 THEN 'escalated'
                 WHEN total_amount > 500.00 THEN 'escalated' ELSE 'executing' END AS outcome,
         CASE WHEN NOT velocity_ok THEN 'velocity_exceeded'
              WHEN requires_human OR confidence_score < 0.85 THEN 'low_confidence' ELSE 'high_amount' END AS cause
  FROM sessions)
"""


def triaged(spark, sf_dir):
    """Sessions (users of orders) with the gate columns; grades come from labels, velocity from events."""
    gate = refunds.velocity_gate(table(spark, sf_dir, "events")).groupBy(F.col("user_id").alias("session_id")).agg(
        F.bool_and("admitted").alias("velocity_ok")
    )
    grades = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("session_id"), (0.55 + 0.35 * F.col("quality")).alias("confidence_score"),
        (F.col("toxic") == 1).alias("requires_human"),
    )
    sums = work(spark, sf_dir).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"),
        F.coalesce(F.sum(F.when(F.col("eligible"), F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("total_amount"),
    )
    sessions = (
        sums.join(gate, "session_id", "left").join(grades, "session_id", "left")
        .withColumn("confirmed", F.col("session_id") % 7 != 0)
        .withColumn("velocity_ok", F.coalesce("velocity_ok", F.lit(True)))
        .withColumn("requires_human", F.coalesce("requires_human", F.lit(False)))
    )
    return refunds.triage(sessions)


@query("dec4_triage", f"""
WITH RECURSIVE {SESSIONS_SQL}
SELECT session_id, outcome, CASE WHEN outcome = 'escalated' THEN cause ELSE '' END AS escalation_reason FROM triaged
""")
def dec4(spark, sf_dir):
    return triaged(spark, sf_dir).select(
        "session_id", "outcome", F.coalesce("escalation_reason", F.lit("")).alias("escalation_reason")
    )


TICKETS_SQL = f"""
{SESSIONS_SQL}, sums AS (SELECT session_id, sum(amount) AS amount, count(*) AS n FROM work WHERE eligible GROUP BY 1),
made AS (
  SELECT t.session_id, 'TKT-' || upper(substr(sha256(t.session_id || ':' || t.cause), 1, 8)) AS ticket_id,
         CAST(coalesce(s.amount, 0) AS DOUBLE) AS ticket_amount, coalesce(s.n, 0) AS transactions, 'escalated:' || t.cause AS decision
  FROM triaged t LEFT JOIN sums s ON s.session_id = t.session_id WHERE t.outcome = 'escalated')
"""


@query("dec5_tickets", f"WITH RECURSIVE {TICKETS_SQL} SELECT * FROM made")
def dec5(spark, sf_dir):
    made, _ = refunds.tickets(triaged(spark, sf_dir), work(spark, sf_dir))
    return made.select(
        "session_id", "ticket_id", F.col("ticket_amount").cast("double").alias("ticket_amount"), "transactions", "decision"
    )


@query("dec5_ticket_lines", f"""
WITH RECURSIVE {TICKETS_SQL}
SELECT m.ticket_id, w.transaction_id FROM work w JOIN made m ON m.session_id = w.session_id WHERE w.eligible
""")
def dec5_lines(spark, sf_dir):
    return refunds.tickets(triaged(spark, sf_dir), work(spark, sf_dir))[1]


@query("agg15_refund_outcomes", f"""
WITH RECURSIVE {SESSIONS_SQL} SELECT outcome AS label, count(*) AS total FROM triaged GROUP BY 1
""")
def agg15_refunds(spark, sf_dir):
    return metrics.counters(triaged(spark, sf_dir), "outcome").withColumnRenamed("outcome", "label")


@query("dat3_age_days", f"""
WITH {TRANSACTIONS_SQL}
SELECT transaction_id, CAST(floor((epoch(TIMESTAMP '2002-01-01') - epoch(created_at)) / 86400) AS BIGINT) AS age_days FROM tx
""")
def dat3(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        "transaction_id", age_days(F.col("created_at"), F.lit("2002-01-01")).alias("age_days")
    )


@query("txt13_stable_keys", """
SELECT o_orderkey, sha256(o_custkey || ':' || o_orderkey || ':' || o_custkey) AS idempotency_key,
       substr(sha256(o_custkey || ':drug:' || lower(o_orderpriority)), 1, 16) AS node_id,
       CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16))::UHUGEINT % 9223372036854775808 AS BIGINT) AS point_id,
       sha256('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS content_hash
FROM orders
""")
def txt13(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", keys.idempotency_key(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey")).alias("idempotency_key"),
        keys.graph_node_id(F.col("o_custkey"), F.lit("drug"), F.col("o_orderpriority")).alias("node_id"),
        keys.point_id(F.col("o_orderkey").cast("string")).alias("point_id"),
        keys.content_hash(status=F.col("o_orderstatus"), key=F.col("o_orderkey")).alias("content_hash"),
    )


@query("txt14_anonymous_id", """
SELECT c_custkey, '[ID:' || substr(sha256(c_name || 'salt'), 1, 12) || ']' AS anonymous_id FROM customer
""")
def txt14(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", keys.anonymous_id(F.col("c_name"), "salt").alias("anonymous_id"))


@query("top7_page", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100
""")
def top7(spark, sf_dir):
    listed = relational.page(table(spark, sf_dir, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 100)
    return listed.select("o_orderkey", "o_custkey")


@query("top8_trail", """
SELECT event_id, event_type, value FROM events WHERE user_id = 42 ORDER BY ts, event_id
""")
def top8(spark, sf_dir):
    return relational.trail(table(spark, sf_dir, "events"), "user_id", 42, [F.col("ts"), F.col("event_id")]).select(
        "event_id", "event_type", "value"
    )


@query("top10_by_id", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')
""")
def top10(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return relational.by_id(table(spark, sf_dir, "orders"), wanted, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("snk2_upsert", """
WITH merged AS (
  SELECT o_orderkey, o_orderstatus AS status, 0 AS version FROM orders
  UNION ALL SELECT l_orderkey, max(l_linestatus), l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT o_orderkey, max_by(status, version) AS status, max(version) AS version FROM merged GROUP BY 1
""")
def snk2(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("version"))
    # Line numbers repeat within an order, so the newest line of a number is settled by its status.
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("version")).agg(
        F.max("l_linestatus").alias("status")
    )
    return relational.upsert(target, new, ["o_orderkey"], [F.col("version")]).select("o_orderkey", "status", "version")
