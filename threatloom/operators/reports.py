"""Aggregates and top lists behind the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.catalogs import stride
from threatloom.functions import scores
from threatloom.functions.text import lookup, repo_name, repo_short_id

SEVERITIES = list(scores.SEVERITY_RANK)


def category_name(category: Column) -> Column:
    return F.coalesce(lookup(stride.FULL_NAMES, category), F.lit("Unknown"))


def severity_columns(prefix: str = "n_") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s}") for s in SEVERITIES]


def severity_breakdown(threats: DataFrame) -> DataFrame:
    """Threats per severity in rank order; absent severities show as zero."""
    counted = threats.groupBy("repo_id").agg(*severity_columns(""))
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])
    return counted.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")


def category_distribution(threats: DataFrame) -> DataFrame:
    """Threats, and instances, per STRIDE-LM category."""
    return (
        threats.where(F.col("stride_primary").isNotNull()).groupBy("repo_id", "stride_primary")
        .agg(F.count("*").alias("n_threats"), F.sum(F.greatest("instance_count", F.lit(1))).alias("n_instances"))
        .select("repo_id", F.col("stride_primary").alias("category"),
                category_name(F.col("stride_primary")).alias("category_name"),
                lookup(stride.QUESTIONS, F.col("stride_primary")).alias("question"), "n_threats", "n_instances")
    )


def main_category(threats: DataFrame) -> DataFrame:
    """Most common category per repository; ties go to the earlier category."""
    order = F.array_position(F.array(*[F.lit(c) for c in stride.CODES]), F.col("category"))
    return (
        category_distribution(threats).groupBy("repo_id")
        .agg(F.min(F.struct((-F.col("n_threats")).alias("minus"), order.alias("order"), "category_name")).alias("m"))
        .select("repo_id", "m.category_name", (-F.col("m.minus")).alias("n_threats"))
    )


def asset_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("repo_id", "type").agg(
        F.count("*").alias("n_assets"), F.count_if("exposed").alias("n_exposed"),
        F.count_if("sensitive").alias("n_sensitive"))


def scan_stats(assets: DataFrame, flow_summary: DataFrame, threats: DataFrame, mapped: DataFrame,
               paths: DataFrame) -> DataFrame:
    """One row per repository: totals, severe threats, highest and mean risk of threats and paths."""
    zero = F.lit(0).cast("bigint")
    # The listing of paths is read once, for their number as for their risks.
    risks = mapped.select("repo_id", "risk", F.lit(False).alias("path")).unionByName(
        paths.select("repo_id", (F.col("composite_risk") / 10).alias("risk"), F.lit(True).alias("path")))
    parts = [
        assets.groupBy("repo_id").agg(F.count("*").alias("total_assets")),
        flow_summary.groupBy("repo_id").agg(F.sum("n_flows").alias("total_flows")),
        threats.groupBy("repo_id").agg(
            F.count("*").alias("total_threats"), F.count_if(F.col("severity") == "critical").alias("critical_threats"),
            F.count_if(F.col("severity") == "high").alias("high_threats")),
        risks.groupBy("repo_id").agg(
            F.count_if("path").alias("total_paths"), F.greatest(F.max("risk"), F.lit(0.0)).alias("max_risk"), F.avg("risk").alias("avg_risk")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "repo_id", "full_outer")
    totals = ["total_assets", "total_flows", "total_threats", "critical_threats", "high_threats", "total_paths"]
    return out.select("repo_id", *[F.coalesce(c, zero).alias(c) for c in totals],
                      *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("max_risk", "avg_risk")])


def badge(stats: DataFrame) -> DataFrame:
    critical, total = F.col("critical_threats"), F.col("total_threats")
    status = (
        F.when(critical > 0, F.format_string("%d threats (%d critical)", total, critical))
        .when(total > 0, F.format_string("%d threats", total)).otherwise("clean")
    )
    color = (
        F.when(critical > 0, "critical").when(total > 10, "orange").when(total > 0, "yellow").otherwise("brightgreen")
    )
    return stats.select("repo_id", status.alias("status"), color.alias("color"))


def repository_overview(repositories: DataFrame, assets: DataFrame, flow_summary: DataFrame,
                        mapped: DataFrame) -> DataFrame:
    """Dashboard row per repository."""
    per_asset = assets.groupBy("repo_id").agg(F.count("*").alias("total_assets"))
    per_flow = flow_summary.groupBy("repo_id").agg(
        F.sum("n_flows").alias("total_flows"), F.sum("n_sensitive").alias("sensitive_flows"))
    per_threat = mapped.groupBy("repo_id").agg(
        F.count("*").alias("total_threats"), *severity_columns(), F.avg("risk").alias("average_risk"))
    base = repositories.select("repo_id", repo_name(F.col("url")).alias("name"), repo_short_id(F.col("url")).alias("short_id"))
    out = base.join(per_asset, "repo_id", "left").join(per_flow, "repo_id", "left").join(per_threat, "repo_id", "left")
    return out.fillna(0)


def first_per(rows: DataFrame, keys: list[str], order: list, limit: int = 1) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def top_threat_per_category(mapped: DataFrame) -> DataFrame:
    rows = mapped.where(F.col("stride_primary").isNotNull())
    return first_per(rows, ["repo_id", "stride_primary"], [F.desc("risk"), "ord", "id"])


def top_by_priority(threats: DataFrame, limit: int = 5) -> DataFrame:
    return first_per(threats, ["repo_id"], [F.desc("priority"), "ord", "id"], limit)


def by_severity(threats: DataFrame) -> DataFrame:
    """All threats, worst severity first within each repository; a range sort, so no repository lies in one task."""
    return threats.orderBy("repo_id", F.desc(scores.severity_rank(F.col("severity"))), "ord", "id")


def top_by_severity(threats: DataFrame, limit: int = 20) -> DataFrame:
    """The first threats of each repository in that order, with their rank."""
    return first_per(threats, ["repo_id"], [F.desc(scores.severity_rank(F.col("severity"))), "ord", "id"], limit)


def in_priority_band(threats: DataFrame, low: float, high: float | None = None) -> DataFrame:
    kept = threats.where(F.col("priority") >= low)
    return kept if high is None else kept.where(F.col("priority") < high)


def exposed_assets(assets: DataFrame, limit: int = 20) -> DataFrame:
    return first_per(assets.where("exposed"), ["repo_id"], ["ord", "id"], limit)


def listed_dependencies(dependencies: DataFrame, limit: int = 30) -> DataFrame:
    return first_per(dependencies, ["repo_id"], ["ord"], limit)


def recommended_actions(threats: DataFrame, from_threats: int = 20, limit: int = 10) -> DataFrame:
    """Distinct actions of the first threats of a repository, in order of first mention."""
    firsts = first_per(threats, ["repo_id"], [F.desc("priority"), "ord", "id"], from_threats)
    actions = firsts.select("repo_id", F.col("rank").alias("threat_rank"), F.posexplode("recommended").alias("pos", "action"))
    named = actions.groupBy("repo_id", "action").agg(F.min(F.struct("threat_rank", "pos")).alias("first"))
    return first_per(named, ["repo_id"], ["first"], limit)


def priority_actions(mitigations: DataFrame, limit: int = 5) -> DataFrame:
    """Distinct controls of a repository: those ever asked at critical or high first, then the rest."""
    urgent = F.col("priority").isin("critical", "high")
    place = F.struct("ord", "threat_id", "strategy")
    named = mitigations.groupBy("repo_id", "description").agg(
        F.min(F.when(urgent, place)).alias("urgent_first"), F.min(place).alias("any_first"))
    return first_per(
        named, ["repo_id"],
        [F.col("urgent_first").isNull(), F.coalesce("urgent_first", "any_first"), "description"], limit)
