"""Vulnerability feed records as threats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.catalogs import stride
from threatloom.functions import scores
from threatloom.functions.scores import pick
from threatloom.functions.text import lookup, strings, truncated
from threatloom.operators.classify import classify_stride
from threatloom.operators.triage import moment


def vector_part(vector: Column, metric: str) -> Column:
    """Value of a vector metric; the last one when repeated, empty when absent."""
    return F.regexp_extract(vector, rf"(?:.*/|^){metric}:([^/]*)", 1)


def vector_context(vector: Column) -> dict[str, Column]:
    reach, effort = vector_part(vector, "AV"), vector_part(vector, "AC")
    return {
        "exposure_level": pick(reach, {"N": "internet", "A": "internal", "L": "isolated", "P": "isolated"}, ""),
        "affects_known_assets": reach == "N",
        "attack_complexity": F.when(effort == "L", "low").when(effort != "", "high").otherwise(""),
        "privileges_required": pick(vector_part(vector, "PR"), {"N": "none", "L": "low", "H": "high"}, ""),
        "user_interaction_required": vector_part(vector, "UI") == "R",
        "exploitation_status": F.lit("unknown"),
    }


def severity_of(word: Column) -> Column:
    return pick(F.lower(word), {"critical": "critical", "high": "high", "medium": "medium", "low": "low",
                                "none": "info"}, "medium")


def weakness_ids(weaknesses: Column) -> Column:
    texts = F.flatten(F.transform(weaknesses, lambda w: F.transform(
        w["description"], lambda d: F.regexp_extract(d["value"], r"CWE-(\d+)", 1))))
    return F.transform(F.filter(texts, lambda t: t != ""), lambda t: t.cast("int"))


def recommendations(severity: Column, category: Column, cve_id: Column) -> Column:
    urgent = strings([
        "URGENT: Prioritize patching immediately. This is a critical vulnerability.",
        "Check for indicators of compromise in logs from the last 90 days.",
    ])
    general = F.array(
        F.concat(F.lit("Review NVD advisory for "), cve_id, F.lit(" for full details.")),
        F.lit("Validate patches in staging before production deployment."))
    strategies = lookup({k: strings(v[:2]) for k, v in stride.MITIGATION.items()}, category)
    return F.concat(F.when(severity.isin("critical", "high"), urgent).otherwise(strings([])),
                    F.coalesce(strategies, strings([])), general)


def cve_threats(records: DataFrame, as_of) -> DataFrame:
    """One threat per feed record, classified from its English text and weaknesses."""
    now = moment(as_of)
    english = F.filter("cve.descriptions", lambda d: d["lang"] == "en")
    cvss = F.try_element_at("metrics.cvssMetricV31", F.lit(1))["cvssData"]
    rows = records.select(
        "ord", F.col("cve.id").alias("cve_id"),
        F.coalesce(F.try_element_at(english, F.lit(1))["value"], F.lit("")).alias("description"),
        severity_of(F.coalesce(cvss["baseSeverity"], F.lit(""))).alias("severity"),
        F.coalesce(cvss["vectorString"], F.lit("")).alias("vector"),
        weakness_ids(F.col("cve.weaknesses")).alias("cwe_ids"),
        F.transform("cve.references", lambda r: r["url"]).alias("references"),
        F.coalesce(F.try_to_timestamp(F.col("cve.published")), now).alias("published_at"))
    rows = classify_stride(rows, F.concat("cve_id", F.lit(" "), "description"), F.col("cwe_ids"))
    rows = rows.withColumns(vector_context(F.col("vector"))).withColumns({
        "id": F.concat(F.lit("threat-"), "cve_id"),
        "title": F.concat("cve_id", F.lit(": "), truncated(F.col("description"), 100)),
        "discovered_at": now, "cve_ids": F.array("cve_id"),
        "tags": F.array(F.col("severity"), F.lit("cve"), F.lit("nvd")), "source_feeds": strings(["NVD"]),
        "indicators": F.array(F.struct(F.lit("cve").alias("type"), F.col("cve_id").alias("value"),
                                       F.lit(1.0).alias("confidence"))),
        "recommended": recommendations(F.col("severity"), F.col("stride_primary"), F.col("cve_id")),
        "false_positive": F.lit(False), "instance_count": F.lit(0).cast("bigint"),
    })
    return rows.withColumn("priority", scores.threat_priority(now))


def published_within(threats: DataFrame, as_of, days: int) -> DataFrame:
    return threats.where(F.col("published_at") >= moment(as_of) - F.make_dt_interval(F.lit(days)))
