"""Registered queries: code rules."""

from pyspark.sql import functions as F

from threatloom.operators import rules as r
from threatloom.operators import triage as t
from threatloom.plans import AS_OF
from threatloom.plans.registry_assets import sites
from threatloom.plans.registry_triage import text
from threatloom.session import checkpointed
from threatloom.sources import sample_views as v


def _asset_threats(spark, d):
    return r.asset_threats(r.asset_rule_hits(v.assets(spark, d)), AS_OF).select(
        "repo_id", "id", F.col("rule").cast("bigint").alias("rule"), "title", "description", "severity",
        "stride_primary", text("stride_secondary").alias("stride_secondary"), "exposure_level",
        text("tags").alias("tags"), F.round(F.element_at("stride_scores", F.col("stride_primary")), 6).alias("confidence"))


def code_threats_triaged(spark, d):
    raw = checkpointed(r.code_threats(v.assets(spark, d), sites(spark, d), AS_OF))
    return t.triage(raw, AS_OF, min_priority=0.3)


QUERIES = {
    "unguarded_apis": lambda s, d: r.unguarded_apis(v.assets(s, d)).select("repo_id", F.col("ord").cast("string").alias("ord"), "id"),
    "asset_rule_threats": _asset_threats,
    "agentic_rule_threats": lambda s, d: r.asset_threats(r.agentic_hits(v.assets(s, d)), AS_OF).select(
        "repo_id", "title", "description", "severity", text("tags").alias("tags")),
    "flow_rule_hits": lambda s, d: r.flow_rule_counts(sites(s, d)).select(
        "repo_id", "kind", F.col("rule").cast("bigint").alias("rule"), "n_flows",
        "src_file", "src_line", "dst_file", "dst_line"),
    "flow_rule_threats": lambda s, d: r.flow_threats(r.flow_rule_counts(sites(s, d)), AS_OF).select(
        "repo_id", "id", "title", "description", "severity", "stride_primary", "instance_count"),
    "code_threats_triaged": lambda s, d: code_threats_triaged(s, d).select(
        "repo_id", "dedup_key", "title", "severity", "description", "instance_count", "n_indicators",
        F.round("priority", 6).alias("priority")),
}
