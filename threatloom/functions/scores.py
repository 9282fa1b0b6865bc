"""Severity, urgency, priority and band expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity ranks.
SEVERITY_RANK = {"critical": 10, "high": 7, "medium": 5, "low": 3, "info": 1}


def pick(column: Column, table: dict, default) -> Column:
    """Small fixed choice as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return pick(severity, SEVERITY_RANK, 0)


def severity_from_rank(rank: Column) -> Column:
    return pick(rank, {v: k for k, v in SEVERITY_RANK.items()}, "")


def urgency(exploitation: Column, known_asset: Column, exposure: Column, complexity: Column) -> Column:
    total = (
        pick(exploitation, {"active": 0.4, "weaponized": 0.3, "poc_public": 0.2, "theoretical": 0.05}, 0.1)
        + F.when(known_asset, 0.25).otherwise(0.0)
        + pick(exposure, {"internet": 0.2, "internal": 0.1, "isolated": 0.05}, 0.1)
        + pick(complexity, {"low": 0.15, "medium": 0.08, "high": 0.03}, 0.05)
    )
    return F.least(F.lit(1.0), total)


def mean_confidence(scores: Column) -> Column:
    """Mean of a category-to-score map, 0.5 without any score."""
    values = F.map_values(scores)
    total = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.5))


def age_days(discovered_at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(discovered_at)) / F.lit(86_400_000_000.0)


def priority(severity: Column, urgency_score: Column, confidence: Column, age: Column) -> Column:
    recency = F.greatest(F.lit(0.0), F.lit(1.0) - age / 30.0)
    total = 0.3 * (severity_rank(severity) / 10.0) + 0.4 * urgency_score + 0.2 * confidence + 0.1 * recency
    return F.least(F.lit(1.0), total)


def threat_priority(as_of: Column, severity: Column | None = None) -> Column:
    """Priority of a row of the threats table."""
    c = F.col
    return priority(
        c("severity") if severity is None else severity,
        urgency(c("exploitation_status"), c("affects_known_assets"), c("exposure_level"), c("attack_complexity")),
        mean_confidence(c("stride_scores")),
        age_days(c("discovered_at"), as_of),
    )


def path_risk_level(score: Column) -> Column:
    return F.when(score >= 8, "CRITICAL").when(score >= 6, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def difficulty_level(score: Column) -> Column:
    return (
        F.when(score < 0.1, "TRIVIAL").when(score < 0.3, "LOW").when(score < 0.6, "MEDIUM")
        .when(score < 0.8, "HIGH").otherwise("VERY HIGH")
    )


def attacker_type(score: Column) -> Column:
    return (
        F.when(score < 0.1, "A script kiddie").when(score < 0.3, "An opportunistic attacker")
        .when(score < 0.6, "A skilled attacker").otherwise("An advanced persistent threat (APT)")
    )


def mitigation_priority(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high", "medium", "low"), severity).otherwise("low")
