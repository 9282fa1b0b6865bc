"""Registered queries: triage of threats."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from threatloom.functions import scores
from threatloom.operators import triage as t
from threatloom.plans import AS_OF
from threatloom.session import checkpointed
from threatloom.sources import sample_views as v


def text(column, separator=","):
    return F.array_join(column, separator)


def _scores(spark, d):
    c = F.col
    return v.threats(spark, d).select(
        "repo_id", "ord", scores.severity_rank(c("severity")).cast("bigint").alias("severity_rank"),
        F.round(scores.urgency(c("exploitation_status"), c("affects_known_assets"), c("exposure_level"),
                               c("attack_complexity")), 6).alias("urgency"),
        F.round(scores.threat_priority(t.moment(AS_OF)), 6).alias("priority"),
    )


def _merged(spark, d):
    return t.merge_duplicates(t.enrich(t.normalize(v.threats(spark, d), AS_OF)), AS_OF).select(
        "repo_id", "dedup_key", "ord", "title", "description", "severity", "instance_count", "n_indicators",
        text("tags").alias("tags"), text("source_feeds").alias("source_feeds"),
        F.round("priority", 6).alias("priority"),
    )


def appearances(spark, d):
    """Stage table of the list values of merged threats, by their key, for jobs that merge threats and list their indicators."""
    return checkpointed(t.first_appearances(t.with_key(t.normalize(v.threats(spark, d), AS_OF))), by=t.KEY)


def triaged(spark, d, values=None):
    """Threats as later stages use them."""
    return t.triage(v.threats(spark, d), AS_OF, min_priority=0.3, max_age_days=25, values=values)


def observed(spark, d):
    """Rows after each stage of one triage, counted while its result is written."""
    seen = Observation()
    checkpointed(t.triage(v.threats(spark, d), AS_OF, min_priority=0.3, max_age_days=25, seen=seen))
    return spark.createDataFrame(list(t.stage_rows(seen).items()), "stage string, n bigint")


QUERIES = {
    "threat_scores": _scores,
    "threats_normalized": lambda s, d: t.normalize(v.threats(s, d), AS_OF).select(
        "repo_id", "ord", "title", text("tags").alias("tags")),
    "threats_enriched": lambda s, d: t.enrich(v.threats(s, d)).select(
        "repo_id", "ord", "affects_known_assets", text("detection_rules", "; ").alias("detection_rules")),
    "threat_dedup_keys": lambda s, d: t.with_key(t.normalize(v.threats(s, d), AS_OF)).select(
        "repo_id", "ord", "dedup_key"),
    "threats_merged": _merged,
    "merged_indicators": lambda s, d: t.merged_indicators(t.normalize(v.threats(s, d), AS_OF)).select(
        "repo_id", "dedup_key", "value", "ord"),
    "threats_triaged": lambda s, d: t.prioritized(triaged(s, d)).select(
        "repo_id", "dedup_key", "title", "severity", "instance_count", F.round("priority", 6).alias("priority")),
    "triage_stage_counts": lambda s, d: t.stage_counts(
        v.threats(s, d), AS_OF, min_priority=0.3, max_age_days=25),
    "triage_observed": observed,
}
