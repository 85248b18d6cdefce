"""Refund gates: candidates, eligibility, velocity, evidence, magnitude, idempotent execution.

Transactions have (transaction_id, user_id, amount decimal, merchant,
created_at, refunded, refund_eligible).
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.config import REFUNDS, Refunds
from tracemill.functions.dates import age_days
from tracemill.operators.skew import BLOCK_ROWS, number_rows, ordered_fold

def candidates(
    tx: DataFrame, as_of: Column, days: int = REFUNDS.refund_days, user: int | str | None = None,
    merchant: str | None = None, min_amount: Decimal | None = None, max_amount: Decimal | None = None,
) -> DataFrame:
    """Recent transactions that are not refunded and may be refunded; filters reach the scan."""
    kept = tx.where(~F.col("refunded") & F.col("refund_eligible"))
    kept = kept.where(F.col("created_at") >= as_of - F.make_interval(days=F.lit(days)))
    if user is not None:
        kept = kept.where(F.col("user_id") == user)
    if merchant:
        kept = kept.where(F.col("merchant").ilike(f"%{merchant}%"))
    if min_amount is not None:
        kept = kept.where(F.col("amount") >= min_amount)
    if max_amount is not None:
        kept = kept.where(F.col("amount") <= max_amount)
    return kept


def rejection(as_of: Column, owner: Column, days: int = REFUNDS.refund_days) -> Column:
    """First failing rule of a transaction, null when it is eligible."""
    # The texts of the reasons.
    return (
        F.when(F.col("user_id") != owner, "not owned by this account")
        .when(F.col("refunded"), "already refunded")
        .when(~F.col("refund_eligible"), "product type not eligible for refund")
        .when(age_days(F.col("created_at"), as_of) > days, f"outside {days}-day refund window")
    )


def recheck(tx: DataFrame, latest: DataFrame) -> DataFrame:
    """Refunded flag of the authoritative table; a transaction it does not know is not refunded there."""
    newest = latest.select("transaction_id", F.col("refunded").alias("_latest"))
    return (
        tx.join(newest, "transaction_id", "left")
        .withColumn("refunded_now", F.coalesce("_latest", F.lit(False))).drop("_latest")
    )


def split_eligible(checked: DataFrame, session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(sessions, reasons): counts and status per session, and one row per refused transaction.

    Reasons stay rows, so a session of any size is never gathered into one value.
    """
    ok = F.col("reason").isNull()
    sessions = checked.groupBy(session).agg(
        F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("ineligible"),
    ).withColumn("status", F.when(F.col("eligible") == 0, "ineligible").otherwise("pending_evidence"))
    return sessions, checked.where(~ok).select(session, "transaction_id", "reason")


def select_by_index(cand: DataFrame, session: str, selection: str) -> DataFrame:
    """Candidates picked by ``all`` or a 1-based list over newest first.

    ``selection`` is a column of the candidates. Numbers out of range pick
    nothing; a selection with a part that is not a number raises.
    """
    numbered = number_rows(
        cand.withColumn("_newest", -F.unix_micros("created_at")), [session],
        [F.col("_newest"), F.col("transaction_id")],
        F.floor(F.col("_newest") / 60_000_000), "position",
    ).drop("_newest")
    wanted = F.transform(F.split(selection, ","), lambda part: F.trim(part).cast("int"))
    everything = F.lower(F.col(selection)) == "all"
    picked = F.when(everything, F.lit(True)).otherwise(F.array_contains(wanted, F.col("position").cast("int")))
    return numbered.where(picked)


def mark_refunded(tx: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """Set the refunded flag and time of finished transactions."""
    marks = done.select("transaction_id").distinct().withColumn("_done", F.lit(True))
    hit = F.coalesce("_done", F.lit(False))
    return (
        tx.join(marks, "transaction_id", "left")
        .withColumn("refunded", F.col("refunded") | hit)
        .withColumn("refunded_at", F.when(hit, as_of))
        .drop("_done")
    )


def pending_work(every: DataFrame, done: DataFrame, failed: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Eligible work that neither finished nor failed."""
    return every.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def newly_done(now: DataFrame, before: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Work finished now that was not finished in an earlier attempt."""
    return now.select(key).distinct().join(before.select(key), key, "left_anti")


def apply_once(requests: DataFrame, ledger: DataFrame, key: str = "idempotency_key",
               order: tuple[str, ...] = ("requested_at", "request_id")) -> DataFrame:
    """Result per request: the stored result for a known key, else that of the key's first request.

    ``replayed`` is true for every request but the one that really runs.
    """
    firsts = requests.groupBy(key).agg(
        F.min_by(F.struct("request_id", "amount"), F.struct(*order)).alias("_first")
    )
    known = ledger.select(key, F.col("request_id").alias("_known_id"), F.col("amount").alias("_known_amount"))
    settled = firsts.join(known, key, "left").select(
        key,
        F.coalesce("_known_id", "_first.request_id").alias("result_request"),
        F.coalesce("_known_amount", "_first.amount").alias("result_amount"),
        F.col("_known_id").isNotNull().alias("_stored"),
    )
    return requests.join(settled, key).withColumn(
        "replayed", F.col("_stored") | (F.col("request_id") != F.col("result_request"))
    ).drop("_stored")


def per_second(requests: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Requests per user and second: at most one row per second, however hot a user is."""
    return requests.groupBy(user, F.unix_timestamp(ts).alias("second")).agg(F.count(F.lit(1)).alias("requests"))


def attempts(requests: DataFrame, cfg: Refunds = REFUNDS, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Other attempts of the same user in the trailing window, per user and second.

    Requests of one second are peers. The second exactly one window ago is
    outside. Days are cut apart and each second also visits the next day, so
    no task holds more than two days of seconds of one user.
    """
    seconds = per_second(requests, user, ts)
    day = F.floor(F.col("second") / cfg.window_seconds)
    spread = (
        seconds.withColumn("_day", day)
        .withColumn("_slice", F.explode(F.array(F.col("_day"), F.col("_day") + 1)))
    )
    frame = Window.partitionBy(user, "_slice").orderBy("second").rangeBetween(1 - cfg.window_seconds, 0)
    return (
        spread.withColumn("attempts", F.sum("requests").over(frame) - 1)
        .where(F.col("_slice") == F.col("_day"))
        .drop("_day", "_slice")
    )


def admit(state: list, seconds: Iterable[int], requests: Iterable[int], limit: int, window: int) -> tuple[list, list]:
    """Admitted requests per second; ``state`` holds the admitted (second, count) pairs still in the window."""
    live, admitted = [list(p) for p in state], []
    for second, asked in zip(seconds, requests):
        live = [p for p in live if p[0] > second - window]
        room = max(0, limit - sum(p[1] for p in live))
        granted = min(room, asked)
        if granted:
            live.append([second, granted])
        admitted.append(granted)
    return admitted, live


def velocity_gate(requests: DataFrame, cfg: Refunds = REFUNDS, user: str = "user_id", ts: str = "ts",
                  request: str = "event_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Requests with ``admitted``: refused while the limit of admitted ones is used up in the trailing window.

    Refused requests do not count. Within one second requests are served by id.
    """
    seconds = number_rows(
        per_second(requests, user, ts), [user], [F.col("second")], F.floor(F.col("second") / cfg.window_seconds)
    )
    limit, window = cfg.max_per_window, cfg.window_seconds

    def advance(state: list, rows: dict[str, list]) -> tuple[list, list]:
        return admit(state, rows["second"], rows["requests"], limit, window)

    granted = ordered_fold(seconds, user, "step", ["second", "requests"], [], advance, "granted", "long", block_rows)
    slots = seconds.join(granted, [user, "step"]).select(user, "second", "granted")
    turn = F.row_number().over(Window.partitionBy(user, "second").orderBy(request))
    return (
        requests.withColumn("second", F.unix_timestamp(ts)).join(slots, [user, "second"])
        .withColumn("admitted", turn <= F.col("granted")).drop("granted", "second")
    )


def refund_totals(work: DataFrame, session: str = "session_id") -> DataFrame:
    """Candidates, eligible and refunded amounts, outcomes and final status per session.

    ``work`` has (session_id, transaction_id, amount, eligible, outcome) with outcome success, failed or null.
    """
    money = "decimal(18,2)"
    done, failed = F.col("outcome") == "success", F.col("outcome") == "failed"
    return work.groupBy(session).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum("amount").cast(money).alias("candidate_amount"),
        F.coalesce(F.sum(F.when(F.col("eligible"), F.col("amount"))), F.lit(0)).cast(money).alias("eligible_amount"),
        F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0)).cast(money).alias("refunded_amount"),
        F.count_if(done).alias("succeeded"), F.count_if(failed).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") > 0, "partially_completed").otherwise("completed"))


def triage(sessions: DataFrame, cfg: Refunds = REFUNDS) -> DataFrame:
    """Outcome and reason of each session through the gates in order.

    ``sessions`` has (confirmed, candidates, velocity_ok, eligible, confidence_score, requires_human, total_amount);
    a null confidence means that no evidence was graded yet.
    """
    waiting = ~F.col("confirmed")
    low = F.col("requires_human") | (F.col("confidence_score") < cfg.confidence_threshold)
    outcome = (
        F.when(waiting, "pending_confirmation")
        .when(F.col("candidates") == 0, "ineligible")
        .when(~F.col("velocity_ok"), "escalated")
        .when(F.col("eligible") == 0, "ineligible")
        .when(F.col("confidence_score").isNull(), "pending_evidence")
        .when(low, "escalated")
        .when(F.col("total_amount") > F.lit(cfg.max_auto_amount), "escalated")
        .otherwise("executing")
    )
    reason = (
        F.when(outcome != "escalated", F.lit(None).cast("string"))
        .when(~F.col("velocity_ok"), "velocity_exceeded")
        .when(low, "low_confidence").otherwise("high_amount")
    )
    return sessions.withColumn("outcome", outcome).withColumn("escalation_reason", reason)


def tickets(triaged: DataFrame, work: DataFrame, session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(tickets, lines): ticket and audit decision per escalated session, and its eligible transactions as rows."""
    escalated = triaged.where(F.col("outcome") == "escalated")
    number = F.upper(F.substring(F.sha2(F.concat_ws(":", F.col(session).cast("string"), "escalation_reason"), 256), 1, 8))
    totals = work.where("eligible").groupBy(session).agg(
        F.sum("amount").cast("decimal(18,2)").alias("ticket_amount"), F.count(F.lit(1)).alias("transactions"),
    )
    made = (
        escalated.join(totals, session, "left")
        .withColumn("ticket_id", F.concat(F.lit("TKT-"), number))
        .withColumn("ticket_amount", F.coalesce("ticket_amount", F.lit(0).cast("decimal(18,2)")))
        .withColumn("transactions", F.coalesce("transactions", F.lit(0)))
        .withColumn("decision", F.concat(F.lit("escalated:"), "escalation_reason"))
        .withColumn("action", F.lit("escalated_to_human"))
    )
    lines = work.where("eligible").join(made.select(session, "ticket_id"), session).select("ticket_id", "transaction_id")
    return made, lines
