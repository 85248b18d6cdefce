"""Layered scans of inputs, tool calls, content and outputs, and the security events they raise."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import GUARD, Guard
from tracemill.functions import paths, rules
from tracemill.operators.embedding import embed, hashed_pairs
from tracemill.operators.vectors import cosine

# Categories of a supplied judge verdict.
POLICY_CATEGORIES = {
    "INSTRUCTION_OVERRIDE": rules.JAILBREAK,
    "UNAUTHORIZED_ACCESS": rules.PATH,
    "DATA_EXFILTRATION": rules.PII,
    "PERSONA_JAILBREAK": rules.JAILBREAK,
    "SOCIAL_ENGINEERING": rules.SOCIAL,
}
# End of fixed values.


@lru_cache(maxsize=4)
def attack_vectors(load_model=hashed_pairs) -> tuple[tuple[str, ...], np.ndarray]:
    """Category per phrase and the phrase vectors as a matrix."""
    pairs = [(category, phrase) for category, phrases in rules.ATTACK_LIBRARY.items() for phrase in phrases]
    vectors = np.asarray(load_model()(pd.Series([p for _, p in pairs])), dtype=np.float32)
    return tuple(c for c, _ in pairs), vectors


def classify(df: DataFrame, vec: str, library: tuple[tuple[str, ...], np.ndarray] | None = None,
             cfg: Guard = GUARD) -> DataFrame:
    """Best cosine with the attack library: ``best_score``, ``best_category``, ``classifier_verdict``.

    The library is a small fixed matrix that travels with the task; each Arrow
    batch is one matrix product. Scores are rounded to six decimals, ties go to
    the earlier phrase, and only positive scores count.
    """
    categories, phrases = library or attack_vectors()
    matrix = phrases.astype(np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    names = np.array(categories, dtype=object)

    @F.pandas_udf("score double, category string")
    def best(vectors: pd.Series) -> pd.DataFrame:
        rows = np.vstack(vectors.to_numpy()).astype(np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
        scores = np.round(rows @ matrix.T, 6)
        place = scores.argmax(axis=1)
        top = scores[np.arange(len(rows)), place]
        return pd.DataFrame({
            "score": np.maximum(top, 0.0) + 0.0, "category": np.where(top > 0, names[place], "safe"),
        })

    scored = df.withColumn("_best", best(F.col(vec)))
    score = F.col("_best.score")
    return (
        scored.withColumn("best_score", score).withColumn("best_category", F.col("_best.category"))
        .withColumn("classifier_verdict", F.when(score >= cfg.unsafe_threshold, "UNSAFE")
                    .when(score >= cfg.uncertain_threshold, "UNCERTAIN").otherwise("SAFE"))
        .drop("_best")
    )


def scan_layers(df: DataFrame, key: str, text: str, vec: str, judge: DataFrame | None = None,
                library=None, cfg: Guard = GUARD) -> DataFrame:
    """Rules first, then the classifier, then a supplied judge verdict for uncertain rows.

    ``judge`` has (key, judge_verdict, violated_policy, judge_confidence). The
    classifier runs only on rows that no rule caught.
    """
    ruled = df.withColumn("_rule", rules.first_hit(F.col(text)))
    caught = ruled.where(F.col("_rule").isNotNull()).select(
        key, F.lit("UNSAFE").alias("verdict"), F.lit("layer1_regex").alias("blocked_by"),
        F.col("_rule.category").alias("category"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("Matched: "), F.col("_rule.description")).alias("reason"),
        F.col("_rule.matched").alias("matched"),
    )
    rest = classify(ruled.where(F.col("_rule").isNull()), vec, library, cfg)
    none = F.lit(None).cast("string")
    if judge is None:
        rest = rest.withColumn("judge_verdict", none).withColumn("violated_policy", none).withColumn(
            "judge_confidence", F.lit(None).cast("double"))
    else:
        rest = rest.join(judge.select(key, "judge_verdict", "violated_policy", "judge_confidence"), key, "left")
    policy = F.create_map(*[F.lit(v) for pair in POLICY_CATEGORIES.items() for v in pair])
    by_classifier = F.col("classifier_verdict") == "UNSAFE"
    by_judge = (F.col("classifier_verdict") == "UNCERTAIN") & F.coalesce(F.upper("judge_verdict") == "UNSAFE", F.lit(False))
    passed = rest.select(
        key,
        F.when(by_classifier | by_judge, "UNSAFE").otherwise("SAFE").alias("verdict"),
        F.when(by_classifier, "layer2_classifier").when(by_judge, "layer3_llm_guard").alias("blocked_by"),
        F.when(by_classifier, F.col("best_category"))
        .when(by_judge, F.coalesce(policy[F.col("violated_policy")], F.lit("safe"))).otherwise("safe").alias("category"),
        F.when(by_classifier, F.col("best_score"))
        .when(by_judge, F.coalesce("judge_confidence", F.lit(0.9))).otherwise(1.0).alias("confidence"),
        F.when(by_classifier, "Close to a known attack").when(by_judge, "Judge verdict")
        .otherwise("Passed all active layers").alias("reason"),
        none.alias("matched"),
    )
    both = caught.unionByName(passed)
    return both.withColumn("severity", F.when(F.col("verdict") == "UNSAFE", "MEDIUM").otherwise("LOW"))


def intent_gap(df: DataFrame, request_vec: str, action_vec: str, request: str, cfg: Guard = GUARD) -> DataFrame:
    """Cosine of the request and the described action; too low is a gap, a blank request passes."""
    blank = F.coalesce(F.col(request), F.lit("")) == ""
    similarity = F.when(blank, 1.0).otherwise(cosine(F.col(request_vec), F.col(action_vec)))
    return (
        df.withColumn("intent_similarity", similarity)
        .withColumn("intent_gap", F.col("intent_similarity") < cfg.intent_threshold)
    )


def describe_call(tool: Column, args: Column, longest: int | None = None) -> Column:
    """``tool(key=value, ...)`` with whole values, or cut at ``longest`` characters."""
    value = (lambda e: F.substring(e["value"], 1, longest)) if longest else lambda e: e["value"]
    parts = F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), value(e)))
    return F.concat(tool, F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def _argument(args: Column, names: tuple[str, ...]) -> Column:
    """First non-empty argument among ``names``."""
    return F.coalesce(*[F.when(F.try_element_at(args, F.lit(n)) != "", F.try_element_at(args, F.lit(n))) for n in names])


def validate_calls(calls: DataFrame, load_model=hashed_pairs, cfg: Guard = GUARD, strict_paths: bool = False) -> DataFrame:
    """Add ``violated_rule`` (null when allowed) and ``severity``: scope, path, network, provenance, intent.

    ``calls`` has (tool_name, args map, origin, user_request).
    """
    path = _argument(F.col("args"), ("path", "file", "filename", "filepath"))
    url = _argument(F.col("args"), ("url", "endpoint", "to", "domain"))
    out_of_scope = ~F.col("tool_name").isin(*cfg.allowed_tools)
    bad_path = path.isNotNull() & (paths.path_verdict(path, cfg, strict_paths) != "ok")
    bad_host = url.isNotNull() & F.col("tool_name").isin(*cfg.network_tools) & (paths.host_verdict(url, cfg) != "ok")
    untraced = ~paths.traceable(F.col("tool_name"), F.col("origin"), F.col("user_request"))
    early = (
        F.when(out_of_scope, "tool_scope").when(bad_path, "sandbox_filesystem")
        .when(bad_host, "sandbox_network").when(untraced, "provenance_check")
    )
    ruled = calls.withColumn("_early", early)
    # The Python model sees only calls that passed the native checks and have a request.
    asks = F.col("_early").isNull() & (F.coalesce("user_request", F.lit("")) != "")
    open_calls = embed(
        embed(ruled.where(asks), F.col("user_request"), "_request", load_model),
        describe_call(F.col("tool_name"), F.col("args")), "_action", load_model,
    )
    gapped = intent_gap(open_calls, "_request", "_action", "user_request", cfg).withColumn(
        "violated_rule", F.when(F.col("intent_gap"), "intent_gap")
    )
    settled = ruled.where(~asks).withColumn("violated_rule", F.col("_early"))
    columns = [*calls.columns, "violated_rule"]
    return settled.select(*columns).unionByName(gapped.select(*columns)).withColumn(
        "severity", F.when(F.col("violated_rule").isNull(), "LOW")
        .when(F.col("violated_rule") == "provenance_check", "CRITICAL").otherwise("HIGH")
    )


def output_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """Event per unsafe output; secrets when an issue names a key or secret, else malware."""
    scanned = df.withColumn("_scan", rules.output_verdict(F.col(text))).where(F.col("_scan.verdict") == "UNSAFE")
    secret = F.exists("_scan.issues", lambda i: F.lower(i).rlike("key|secret"))
    return scanned.select(
        key, F.when(secret, "secrets_in_output").otherwise("malware_in_output").alias("attack_type"),
        F.lit("egress_scanner").alias("layer"), F.lit("redacted").alias("action_taken"),
        F.col("_scan.severity").alias("severity"), F.col("_scan.issues").alias("issues"),
    )


def content_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """Event per content with injected instructions."""
    scanned = df.withColumn("_scan", rules.sanitize(F.col(text))).where(F.col("_scan.injected"))
    return scanned.select(
        key, F.lit("indirect_injection").alias("attack_type"), F.lit("content_sanitizer").alias("layer"),
        F.lit("sanitized").alias("action_taken"), F.lit("HIGH").alias("severity"), F.col("_scan.snippets").alias("issues"),
    )


def event_rows(events: DataFrame, input_chars: int = 2_000, action_chars: int = 500) -> DataFrame:
    """Events as stored: input and action cut to their storage limits, details as JSON."""
    return events.withColumn("original_input", F.substring("original_input", 1, input_chars)).withColumn(
        "attempted_action", F.substring("attempted_action", 1, action_chars)
    ).withColumn("metadata_json", F.to_json("metadata")).drop("metadata")


def list_events(events: DataFrame, severity: str | None = None, attack_type: str | None = None,
                limit: int | None = None) -> DataFrame:
    """Events newest first with a 100-character preview; both filters are optional."""
    if severity:
        events = events.where(F.col("severity") == severity.upper())
    if attack_type:
        events = events.where(F.col("attack_type") == attack_type)
    preview = F.when(
        F.length("original_input") > 100, F.concat(F.substring("original_input", 1, 100), F.lit("..."))
    ).otherwise(F.col("original_input"))
    listed = events.withColumn("preview", preview).orderBy(F.col("timestamp").desc(), "event_id")
    return listed.limit(limit) if limit else listed
