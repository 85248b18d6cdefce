"""Scores and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.config import CLINICAL, EVALUATION, Clinical, Evaluation

# Source weights of evidence, critical ECG findings, body-part specialists.
SOURCE_WEIGHTS = {
    "rxnorm_rules": 1.0, "kg_traversal": 0.95, "lab_parser": 0.98, "vector_search": 0.85, "cbr": 0.80,
}
DEFAULT_SOURCE_WEIGHT = 0.80
ECG_CRITICAL = (
    "stemi", "vfib", "vtach", "complete_heart_block", "third_degree_av_block",
    "brugada_pattern", "long_qt_syndrome",
)
BODY_PARTS = {"neurology": ("brain", "head"), "cardiology": ("heart", "cardiac"), "pulmonology": ("lung", "chest")}
LAB_SPECIALISTS = {
    "nephrology": ("egfr", "creatinine", "bun"),
    "cardiology": ("total_cholesterol", "ldl"),
    "endocrinology": ("hba1c",),
}
SEVERITIES = ("normal", "low", "moderate", "high", "critical")


def quality_weight(copied: Column, re_asked: Column, edit_distance: Column, thumbs_up: Column) -> Column:
    """How good the logged answer was for its user: 1.0, 0.9, 0.3 or 0.6."""
    return (
        F.when(copied & (edit_distance < 0.1) & ~re_asked, 1.0)
        .when(thumbs_up.eqNullSafe(F.lit(True)), 0.9)
        .when(re_asked | (~copied & thumbs_up.isNull()), 0.3)
        .otherwise(0.6)
    )


def change_flags(old_rate: Column, new_rate: Column, old_judge: Column, new_judge: Column,
                 cfg: Evaluation = EVALUATION) -> tuple[Column, Column]:
    """(regressed, improved): pass rates decide when both exist, else judge scores, else neither."""
    rates = old_rate.isNotNull() & new_rate.isNotNull()
    judges = old_judge.isNotNull() & new_judge.isNotNull()
    regressed = (
        F.when(rates, new_rate < old_rate - cfg.pass_rate_margin)
        .when(judges, new_judge < old_judge - cfg.judge_margin).otherwise(False)
    )
    improved = (
        F.when(rates, new_rate > old_rate + cfg.pass_rate_margin)
        .when(judges, new_judge > old_judge + cfg.judge_margin).otherwise(False)
    )
    return regressed, improved


def priority(regressed: Column, improved: Column, weight: Column) -> Column:
    """Label of a changed answer by the weight of the old one."""
    return (
        F.when(regressed & (weight >= 0.8), "critical_regression")
        .when(regressed & (weight >= 0.5), "regression")
        .when(regressed, "low_priority_regression")
        .when(improved & (weight <= 0.4), "likely_improvement")
        .when(improved, "improvement")
        .otherwise("neutral")
    )


def lab_severity(value: Column, low: Column, high: Column) -> Column:
    """Severity by relative distance from the range; unknown ranges count as normal."""
    below = F.when(low > 0, (low - value) / low).otherwise(0.0)
    above = F.when(high > 0, (value - high) / high).otherwise(0.0)
    distance = F.greatest(below, above)
    return (
        F.when(low.isNull() | high.isNull() | value.between(low, high), "normal")
        .when(distance > 0.5, "critical").when(distance > 0.3, "high")
        .when(distance > 0.1, "moderate").otherwise("low")
    )


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(v) for i, s in enumerate(SEVERITIES) for v in (s, i)])
    return table[severity]


def recency(days: Column, half_life: int = CLINICAL.half_life_days) -> Column:
    """1.5 for today falling to 0.5; 1.0 when there is no date."""
    decay = F.greatest(F.lit(0.5), F.pow(F.lit(0.5), days / half_life) + 0.5)
    return F.when(days.isNull(), 1.0).otherwise(decay)


def evidence_confidence(confidence: Column, source: Column, days: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in SOURCE_WEIGHTS.items() for v in pair])
    weight = F.coalesce(table[source], F.lit(DEFAULT_SOURCE_WEIGHT))
    return F.least(F.lit(1.0), confidence * weight * recency(days))


def confidence_tier(confidence: Column, cfg: Clinical = CLINICAL) -> Column:
    return (
        F.when(confidence >= cfg.high_confidence, "HIGH")
        .when(confidence >= cfg.medium_confidence, "MEDIUM").otherwise("LOW")
    )


def ecg_finding(rate: Column, qtc: Column, findings: Column) -> Column:
    """Struct (abnormal, severity, specialists) of an ECG record."""
    names = F.transform(findings, lambda f: F.replace(F.lower(f), F.lit(" "), F.lit("_")))
    critical = F.arrays_overlap(names, F.array(*[F.lit(c) for c in ECG_CRITICAL]))
    abnormal = critical | (rate < 50) | (rate > 100) | F.coalesce(qtc > 450, F.lit(False)) | (F.size(findings) > 0)
    return F.struct(
        abnormal.alias("abnormal"),
        F.when(critical, "critical").when(abnormal, "high").otherwise("normal").alias("severity"),
        F.when(abnormal, F.array(F.lit("cardiology"))).otherwise(F.array().cast("array<string>")).alias("specialists"),
    )


def imaging_finding(body_part: Column, findings: Column, severity: Column, abnormal: Column) -> Column:
    """Struct (abnormal, severity, specialists) of an imaging report."""
    part = F.lower(body_part)
    flags = [F.when(part.rlike("|".join(words)), F.lit(name)) for name, words in BODY_PARTS.items()]
    named = F.lower(severity)
    return F.struct(
        F.coalesce(abnormal, F.size(findings) > 0).alias("abnormal"),
        F.when(named.isin(*SEVERITIES), named).otherwise("normal").alias("severity"),
        F.array_compact(F.array(*flags)).alias("specialists"),
    )


def lab_specialists(test: Column, abnormal: Column) -> Column:
    """Array of specialists for an abnormal test."""
    flags = [F.when(abnormal & test.isin(*tests), F.lit(name)) for name, tests in LAB_SPECIALISTS.items()]
    return F.array_compact(F.array(*flags))
