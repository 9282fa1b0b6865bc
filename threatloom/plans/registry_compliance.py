"""Registered queries: ATT&CK techniques and PCI DSS compliance."""

from pyspark.sql import functions as F

from threatloom.operators import classify as c
from threatloom.operators import compliance as pc
from threatloom.operators import findings as fi
from threatloom.operators import techniques as te
from threatloom.plans import AS_OF
from threatloom.plans.registry_classify import maestro_repositories, mapped_findings
from threatloom.plans.registry_triage import text
from threatloom.sources import sample_views as v


def r9(column):
    return F.round(column, 9).alias(column)


def _profiles(spark, d):
    """Repositories with both profiles."""
    rows = maestro_repositories(spark, d)
    return c.classify_stride(rows, F.col("description"), F.col("cwe_ids"))


def requirement_mappings(spark, d, minimum=""):
    threats = fi.finding_threats(fi.map_findings(fi.from_severity(v.findings(spark, d), minimum)), AS_OF)
    return pc.map_requirements(threats)


def _threat_mappings(spark, d):
    """Feed-and-code threats mapped with their CVE ids left out: weaknesses are not CVE ids."""
    rows = v.threats(spark, d).withColumn("cwes", F.array().cast("array<string>")).withColumn(
        "rule_ids", F.array().cast("array<string>"))
    return pc.map_requirements(rows)


def looked_at(spark, d):
    """Every repository, with findings or not."""
    return v.findings(spark, d).select("repo_id").union(v.repositories(spark, d).select("repo_id"))


def subs(spark, d):
    return pc.sub_requirement_results(requirement_mappings(spark, d), looked_at(spark, d))


QUERIES = {
    "category_techniques": lambda s, d: te.map_category(v.threats(s, d)).select(
        "repo_id", "ord", "technique_id", r9("technique_confidence"), "reason"),
    "layer_techniques": lambda s, d: te.map_layer(maestro_repositories(s, d)).select(
        "repo_id", "technique_id", r9("technique_confidence"), "reason"),
    "threat_technique_ids": lambda s, d: te.with_technique_ids(v.threats(s, d)).select(
        "repo_id", "ord", text("mitre_ids").alias("mitre_ids")),
    "best_techniques": lambda s, d: te.best_techniques(_profiles(s, d), ["repo_id"]).select(
        "repo_id", "technique_id", r9("technique_confidence"), "reason"),
    "technique_details": lambda s, d: te.with_details(te.map_category(v.threats(s, d))).select(
        "repo_id", "ord", "technique_id", "name", "tactic", "tactic_name", text("platforms").alias("platforms"),
        text("mitigation").alias("mitigation")),
    "techniques_of_credential_access": lambda s, d: te.of_tactic(te.map_category(v.threats(s, d)), "TA0006").select(
        "repo_id", "ord", "technique_id"),
    "requirement_mappings": lambda s, d: requirement_mappings(s, d).select(
        "repo_id", "id", "req_id", "sub_id", F.round("confidence", 6).alias("confidence"), "reason"),
    "requirement_mappings_of_threats": lambda s, d: _threat_mappings(s, d).select(
        "repo_id", "ord", "sub_id", F.round("confidence", 6).alias("confidence"), "reason"),
    "requirement_details": lambda s, d: pc.with_requirement(requirement_mappings(s, d)).groupBy(
        "req_id", "requirement", "sub_id", "sub_description").agg(F.count("*").alias("n")),
    "sub_requirement_results": subs,
    "requirement_results": lambda s, d: pc.requirement_results(subs(s, d)),
    "compliance_breakdown": lambda s, d: pc.status_breakdown(pc.requirement_results(subs(s, d))).withColumn(
        "percent", F.round("percent", 6)),
    "compliance_gaps": lambda s, d: pc.gaps(subs(s, d)),
    "compliance_recommendations": lambda s, d: pc.recommendations(subs(s, d), 20).select(
        "repo_id", "sub_id", F.col("priority").cast("bigint").alias("priority"), "n_findings", "highest_severity",
        "action", F.col("rank").cast("bigint").alias("rank")),
    "top_requirements": lambda s, d: pc.top_requirements(requirement_mappings(s, d, "WARNING")).select(
        "repo_id", "key", "n", F.col("rank").cast("bigint").alias("rank")),
}
