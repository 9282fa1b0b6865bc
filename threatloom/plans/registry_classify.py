"""Registered queries: classification, findings, vulnerability feed."""

from pyspark.sql import functions as F

from threatloom.catalogs import maestro, stride
from threatloom.operators import classify as c
from threatloom.operators import cves as cv
from threatloom.operators import findings as fi
from threatloom.plans import AS_OF
from threatloom.plans.registry_triage import text
from threatloom.sources import sample_views as v


def profile(rows, keys, prefix, codes, separator=""):
    score = lambda code: F.round(F.element_at(f"{prefix}_scores", F.lit(code)), 9)
    return rows.select(
        *keys, F.col(f"{prefix}_primary").alias("primary_code"),
        c.profile_text(F.col(f"{prefix}_primary"), F.col(f"{prefix}_secondary"), separator).alias("profile"),
        *[score(code).alias("score_" + code[0].lower()) for code in codes])


def _documents(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return profile(c.classify_stride(rows, F.col("text")), ["doc_id"], "stride", stride.CODES)


def _threats(spark, d):
    rows = v.threats(spark, d)
    context = {
        "requires_authentication": F.col("affects_known_assets"),
        "network_accessible": F.col("exposure_level") == "internet", "data_exposure": F.col("severity") == "high",
        "affects_availability": F.col("severity") == "low", "privilege_escalation": F.col("false_positive"),
    }
    tactics = F.when(F.col("instance_count") == 1, F.array(F.lit("TA0006"), F.lit("T1059"))).when(
        F.col("instance_count") == 2, F.array(F.lit("TA0008"), F.lit("TA0040"))).otherwise(F.array(F.lit("TA9999")))
    both = F.concat("title", F.lit(" "), "description")
    return profile(c.classify_stride(rows, both, None, tactics, context), ["repo_id", "ord"], "stride", stride.CODES)


def maestro_repositories(spark, d):
    flags = {"has_agents": F.col("description").contains("agent"), "has_rag": F.col("has_rag"),
             "has_tool_calling": F.col("has_tool_calling"), "has_multi_agent": F.col("has_multi_agent")}
    context = {"uses_llm": F.col("has_rag"), "has_external_integrations": F.col("has_tool_calling"),
               "has_data_pipeline": F.col("has_multi_agent"), "compliance_required": F.col("has_rag")}
    return c.classify_maestro(v.repositories(spark, d), F.col("description"), F.col("technologies"), flags,
                              F.col("deployment_model"), F.col("cwe_ids"), context)


def _scans(spark, d):
    rows = c.scan_inputs(v.repositories(spark, d))
    rows = c.classify_maestro(rows, F.col("description"), F.col("technologies"), {"has_agents": F.col("has_agents")})
    return rows.select("repo_id", "maestro_primary", text("maestro_secondary").alias("maestro_secondary"),
                       text("maestro_threats", "; ").alias("maestro_threats"))


def mapped_findings(spark, d):
    return fi.map_findings(v.findings(spark, d))


def cve_threats(spark, d):
    return cv.cve_threats(v.cves(spark, d), AS_OF)


QUERIES = {
    "stride_of_documents": _documents,
    "stride_of_threats": _threats,
    "stride_of_cves": lambda s, d: profile(cve_threats(s, d), ["cve_id"], "stride", stride.CODES),
    "maestro_of_repositories": lambda s, d: profile(
        maestro_repositories(s, d), ["repo_id"], "maestro", maestro.CODES, ","),
    "maestro_named_threats": lambda s, d: maestro_repositories(s, d).select(
        "repo_id", text("maestro_threats", "; ").alias("maestro_threats")),
    "maestro_of_scans": _scans,
    "findings_from_warning": lambda s, d: fi.from_severity(v.findings(s, d), "WARNING").select("repo_id", "ord"),
    "findings_from_medium_confidence": lambda s, d: fi.from_confidence(v.findings(s, d), "MEDIUM").select("repo_id", "ord"),
    "finding_mappings": lambda s, d: mapped_findings(s, d).select(
        "repo_id", "ord", "stride_primary", "layer", F.round("mapping_confidence", 6).alias("mapping_confidence"),
        text("cwe_ids").alias("cwe_ids"), "reason"),
    "finding_mappings_confident": lambda s, d: fi.confident(mapped_findings(s, d), 0.85).select("repo_id", "ord"),
    "finding_groups": lambda s, d: fi.grouped(mapped_findings(s, d)),
    "finding_summary": lambda s, d: fi.summary(v.findings(s, d)),
    "finding_threats": lambda s, d: fi.finding_threats(mapped_findings(s, d), AS_OF).select(
        "repo_id", "id", "title", "description", "severity", text("cwes").alias("cwes")),
    "scanner_error_types": lambda s, d: v.findings(s, d).select(
        "repo_id", "ord", fi.error_type(F.col("error_type")).alias("type")),
    "cve_threats": lambda s, d: cve_threats(s, d).select(
        "cve_id", "title", "severity", "exposure_level", "affects_known_assets", "attack_complexity",
        "privileges_required", "user_interaction_required", text("cwe_ids").alias("cwe_ids"),
        text("recommended", ";").alias("recommended"), F.date_format("published_at", "yyyy-MM-dd").alias("published"),
        text("references").alias("references"), F.round("priority", 6).alias("priority")),
    "cves_in_window": lambda s, d: cv.published_within(cve_threats(s, d), AS_OF, 14).select("cve_id"),
}
