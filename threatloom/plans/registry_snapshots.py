"""Registered queries: comparison of two scans."""

from pyspark.sql import functions as F

from threatloom.operators import snapshots as sn
from threatloom.operators import triage as t
from threatloom.plans import AS_OF, jobs
from threatloom.plans.registry_triage import text
from threatloom.session import checkpointed
from threatloom.sources import sample_views as v


def threat_scans(spark, d):
    half = F.when(F.col("discovered_at") < F.lit("2024-01-16").cast("timestamp"), "base").otherwise("head")
    rows = jobs.join_scan(v.threats(spark, d).withColumn("scan_id", half))
    return jobs.split_scan(t.triage(rows, AS_OF, min_priority=0.3))


def asset_scans(spark, d):
    return v.asset_snapshots(spark, d)


def compared(spark, d):
    everywhere = v.threats(spark, d).select("repo_id").union(asset_scans(spark, d).select("repo_id")).union(
        v.dependencies(spark, d).select("repo_id"))
    return jobs.compare(asset_scans(spark, d), threat_scans(spark, d), v.dependencies(spark, d), everywhere)


def paths(spark, d):
    assets = asset_scans(spark, d)
    return jobs.path_pairs(assets, checkpointed(threat_scans(spark, d)), jobs.scan_sites(assets))


def daily_scans(spark, d):
    rows = v.threats(spark, d).withColumn("priority", F.when(F.col("severity") == "critical", 0.9).when(
        F.col("severity") == "high", 0.7).otherwise(0.4))
    return rows.groupBy("repo_id", F.date_trunc("day", "discovered_at").alias("scan_ts")).agg(
        F.max("priority").alias("max_risk"), F.count("*").alias("total_threats"))


QUERIES = {
    "diff_assets": lambda s, d: sn.diff_assets(asset_scans(s, d)).select(
        "repo_id", "key", "change", text("changes", "; ").alias("changes")),
    "diff_critical_modifications": lambda s, d: sn.critical_modifications(sn.diff_assets(asset_scans(s, d))).select(
        "repo_id", "key"),
    "diff_threats": lambda s, d: sn.diff_threats(threat_scans(s, d)).select("repo_id", "key", "severity", "change"),
    "diff_flows": lambda s, d: jobs.flow_diff(jobs.scan_sites(asset_scans(s, d))),
    "diff_paths": lambda s, d: sn.diff_paths(paths(s, d)),
    "diff_dependencies": lambda s, d: sn.diff_dependencies(v.dependencies(s, d)),
    "diff_change_table": lambda s, d: compared(s, d)["change_table"],
    "diff_risk_delta": lambda s, d: sn.risk_delta(jobs.risk_stats(threat_scans(s, d))),
    "diff_summary": lambda s, d: compared(s, d)["summary"],
    "diff_verdicts": lambda s, d: compared(s, d)["verdicts"].select(
        "repo_id", "preset", "verdict", "reason", F.col("exit_code").cast("bigint").alias("exit_code"), "line"),
    "diff_drift": lambda s, d: compared(s, d)["drift"].select(
        "repo_id", F.round("drift", 4).alias("drift"), F.col("drift_level").cast("bigint").alias("drift_level")),
    "diff_json": lambda s, d: sn.as_json(sn.diff_assets(asset_scans(s, d))),
    "content_ids": lambda s, d: sn.with_content_ids(v.assets(s, d)).groupBy("repo_id", "id").agg(F.count("*").alias("n")),
    "risk_trend": lambda s, d: sn.trend(daily_scans(s, d)).withColumn("percent_change", F.round("percent_change", 6)),
    "risk_windows": lambda s, d: sn.trend_windows(daily_scans(s, d)).select(
        "repo_id", F.date_format("scan_ts", "yyyy-MM-dd").alias("day"), "days", "n_scans", F.round("mean_risk", 6).alias("mean_risk"),
        "highest_risk", (F.round(F.round("slope", 10), 6) + F.lit(0.0)).alias("slope"), "direction"),
    "risk_steps": lambda s, d: sn.scan_steps(daily_scans(s, d)).select(
        "repo_id", F.date_format("scan_ts", "yyyy-MM-dd").alias("day"), F.round("risk_step", 6).alias("risk_step")),
}
