"""Registered queries: languages, manifests, architecture."""

from pyspark.sql import functions as F

from threatloom.functions import text as tx
from threatloom.operators import archetypes as at
from threatloom.operators import manifests as mf
from threatloom.plans.registry_triage import text
from threatloom.sources import sample_views as v


def languages(spark, d):
    return mf.languages(v.files(spark, d))


def signals(spark, d):
    return at.signals(v.files(spark, d), languages(spark, d))


def profiles(spark, d):
    return at.profiles(signals(spark, d), mf.frameworks(v.files(spark, d), languages(spark, d)))


QUERIES = {
    "repository_names": lambda s, d: v.repositories(s, d).select(
        "repo_id", tx.repo_name(F.col("url")).alias("name"), tx.repo_short_id(F.col("url")).alias("short_id")),
    "repository_languages": languages,
    "repository_frameworks": lambda s, d: mf.frameworks(v.files(s, d), languages(s, d)),
    "dependencies_parsed": lambda s, d: mf.dependencies(v.files(s, d), languages(s, d)).select("repo_id", "name", "version"),
    "architecture_signals": lambda s, d: signals(s, d).select("repo_id", "type", "evidence", "weight", "arch_type"),
    "architecture_profiles": lambda s, d: profiles(s, d).select(
        "repo_id", "primary", text("secondary").alias("secondary"), F.round("confidence", 6).alias("confidence"), "description"),
    "architecture_adjustments": lambda s, d: at.adjustments(profiles(s, d)).select(
        "repo_id", F.size("extra_threats").cast("bigint").alias("n_threats"), text("controls", ";").alias("controls"),
        text("recommendations", ";").alias("recommendations"),
        F.round(F.aggregate(F.map_values("risk_multipliers"), F.lit(0.0), lambda a, x: a + x), 6).alias("multiplier_sum")),
}
