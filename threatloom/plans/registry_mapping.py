"""Registered queries: mapping, risk, mitigations, reports."""

from pyspark.sql import functions as F

from threatloom.functions import text as tx
from threatloom.operators import mapping as m
from threatloom.operators import reports as rp
from threatloom.operators import triage as t
from threatloom.plans.registry_assets import flow_rows
from threatloom.plans.registry_triage import appearances, triaged
from threatloom.session import checkpointed
from threatloom.sources import sample_views as v


def head_dependencies(spark, d):
    return v.dependencies(spark, d).where(F.col("scan_id") == "head")


def stage(spark, d):
    """Triaged threats and their affected dependencies as stage tables."""
    values = appearances(spark, d)
    threats = checkpointed(triaged(spark, d, values))
    return threats, checkpointed(affected(spark, d, threats, values))


def affected(spark, d, threats=None, values=None):
    values = appearances(spark, d) if values is None else values
    threats = triaged(spark, d, values) if threats is None else threats
    return m.affected_dependencies(threats, t.indicator_rows(values), head_dependencies(spark, d))


def languages(spark, d):
    return v.repositories(spark, d).select("repo_id", "language")


def mapped(spark, d, staged=None, flows=None):
    threats, hit = stage(spark, d) if staged is None else staged
    counts = m.repository_counts(v.assets(spark, d), flow_rows(spark, d) if flows is None else flows)
    return m.map_threats(threats, counts, hit)


def mitigations(spark, d):
    staged = stage(spark, d)
    rows = checkpointed(mapped(spark, d, staged))
    return m.code_mitigations(rows, languages(spark, d)).unionByName(
        m.patch_mitigations(staged[1], rows, languages(spark, d)))


def r6(column):
    return F.round(column, 6).alias(column)


def _overview(spark, d):
    flows = checkpointed(flow_rows(spark, d))
    return rp.repository_overview(
        v.repositories(spark, d), v.assets(spark, d), flows, mapped(spark, d, flows=flows),
    ).withColumn("average_risk", F.round("average_risk", 6))


def _report_texts(spark, d):
    a = v.assets(spark, d)
    return rp.exposed_assets(a).select(
        "repo_id", F.col("rank").cast("bigint").alias("rank"), tx.truncated(F.col("name"), 12, 9).alias("name"),
        tx.file_location(F.col("file"), F.col("line")).alias("location"))


QUERIES = {
    "affected_dependencies": lambda s, d: affected(s, d).select(
        "repo_id", "threat_id", "cve_id", "name", "version", "asset_name"),
    "mapped_threats": lambda s, d: mapped(s, d).select(
        "repo_id", "id", "title", "n_assets", "n_exposed", "n_flows", "n_patchable", r6("risk")),
    "mitigations": lambda s, d: mitigations(s, d).select(
        "repo_id", "threat_id", "kind", "description", "asset_type", "n", "priority", "effort", "code"),
    "mitigation_rollup": lambda s, d: m.ordered_controls(m.mitigation_rollup(mitigations(s, d))).select(
        "repo_id", "description", "priority", "kind", "applies_to"),
    "mitigations_by_kind": lambda s, d: mitigations(s, d).groupBy("repo_id", "kind").agg(F.sum("n").alias("n")),
    "threat_top_locations": lambda s, d: m.top_locations(v.assets(s, d), mapped(s, d)).select(
        "repo_id", "threat_id", "file", "line", F.col("rank").cast("bigint").alias("rank")),
    "severity_breakdown": lambda s, d: rp.severity_breakdown(triaged(s, d)),
    "category_distribution": lambda s, d: rp.category_distribution(triaged(s, d)),
    "main_category": lambda s, d: rp.main_category(triaged(s, d)),
    "asset_counts": lambda s, d: rp.asset_counts(v.assets(s, d)),
    "repository_overview": _overview,
    "top_threat_per_category": lambda s, d: rp.top_threat_per_category(mapped(s, d)).select(
        "repo_id", "stride_primary", "id", r6("risk")),
    "top_threats_by_severity": lambda s, d: rp.top_by_severity(triaged(s, d)).select(
        "repo_id", "id", "severity", F.col("rank").cast("bigint").alias("rank")),
    "top_threats_by_priority": lambda s, d: rp.top_by_priority(triaged(s, d)).select(
        "repo_id", "id", F.col("rank").cast("bigint").alias("rank")),
    "threats_high_priority": lambda s, d: rp.in_priority_band(triaged(s, d), 0.5, 0.7).select("repo_id", "id"),
    "threats_critical_priority": lambda s, d: rp.in_priority_band(triaged(s, d), 0.7).select("repo_id", "id"),
    "exposed_assets_listed": _report_texts,
    "dependencies_listed": lambda s, d: rp.listed_dependencies(head_dependencies(s, d)).select(
        "repo_id", "name", "version", F.col("rank").cast("bigint").alias("rank")),
    "recommended_actions": lambda s, d: rp.recommended_actions(triaged(s, d)).select(
        "repo_id", "action", F.col("rank").cast("bigint").alias("rank")),
    "priority_actions": lambda s, d: rp.priority_actions(mitigations(s, d)).select(
        "repo_id", "description", F.col("rank").cast("bigint").alias("rank")),
}
