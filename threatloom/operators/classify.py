"""STRIDE-LM and MAESTRO classification as narrow column work: no join, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.catalogs import maestro, stride
from threatloom.functions.text import any_of, count_words, lookup, strings

SECONDARY_FROM = 0.3


def keyword_score(lowered: Column, keywords: list[str]) -> Column:
    """Distinct keywords that hit, three of them make a full score."""
    return F.least(F.lit(1.0), count_words(lowered, keywords) / F.lit(3.0))


def cwe_score(cwe_ids: Column | None, wanted: list[int]) -> Column:
    if cwe_ids is None:
        return F.lit(0.0)
    hit = F.arrays_overlap(cwe_ids, F.array(*[F.lit(c) for c in wanted]))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def flag(column: Column | None, weight: float, wanted: bool = True) -> Column:
    """Weight if the flag is known and as wanted."""
    if column is None:
        return F.lit(0.0)
    return F.when(column if wanted else ~column, weight).otherwise(0.0)


def stride_raw(lowered: Column, cwe_ids: Column | None = None, tactics: Column | None = None,
               context: dict[str, Column] | None = None) -> Column:
    """Unscaled category scores in catalogue order."""
    context = context or {}
    signals = {
        "S": flag(context.get("requires_authentication"), 0.5, wanted=False),
        "L": flag(context.get("network_accessible"), 0.3),
        "I": flag(context.get("data_exposure"), 0.7),
        "D": flag(context.get("affects_availability"), 0.6),
        "E": flag(context.get("privilege_escalation"), 0.8),
    }
    out = []
    for code in stride.CODES:
        tactic = F.lit(0.0)
        if tactics is not None:
            ids = [t for t, c in stride.TACTICS.items() if c == code]
            if ids:
                tactic = F.when(F.coalesce(F.arrays_overlap(tactics, strings(ids)), F.lit(False)), 0.8).otherwise(0.0)
        out.append(
            0.4 * keyword_score(lowered, stride.KEYWORDS[code]) + 0.3 * cwe_score(cwe_ids, stride.CWE_IDS[code])
            + 0.2 * tactic + 0.1 * signals.get(code, F.lit(0.0))
        )
    return F.array(*out)


def technology_score(technologies: Column, layer: str) -> Column:
    if layer not in maestro.TECHNOLOGY_WORDS:
        return F.lit(0.0)
    step, words = maestro.TECHNOLOGY_WORDS[layer]
    hits = F.size(F.filter(technologies, lambda t: any_of(F.lower(t), words)))
    return F.least(F.lit(1.0), F.greatest(hits, F.lit(0)) * step)


def architecture_score(flags: dict[str, Column], deployment: Column | None, layer: str) -> Column:
    total = F.lit(0.0)
    for name, weights in maestro.ARCHITECTURE_FLAGS.items():
        if layer in weights and name in flags:
            total = total + flag(flags[name], weights[layer])
    if deployment is not None:
        table = {model: weights[layer] for model, weights in maestro.DEPLOYMENT_MODELS.items() if layer in weights}
        if table:
            total = total + F.coalesce(lookup(table, F.lower(deployment)), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def maestro_raw(lowered: Column, technologies: Column, flags: dict[str, Column], deployment: Column | None = None,
                cwe_ids: Column | None = None, context: dict[str, Column] | None = None) -> Column:
    """Unscaled layer scores in catalogue order."""
    context = context or {}
    out = []
    for code in maestro.CODES:
        marks = F.lit(0.0)
        for name, (layer, weight) in maestro.CONTEXT_FLAGS.items():
            if layer == code:
                marks = marks + flag(context.get(name), weight)
        out.append(
            0.3 * keyword_score(lowered, maestro.KEYWORDS[code]) + 0.25 * technology_score(technologies, code)
            + 0.25 * architecture_score(flags, deployment, code) + 0.15 * cwe_score(cwe_ids, maestro.CWE_IDS[code])
            + 0.05 * marks
        )
    return F.array(*out)


def with_profile(rows: DataFrame, raw: Column, codes: list[str], default: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_primary``, ``_secondary`` and ``_scores`` from unscaled scores.

    Scores are divided by the highest; without any, the default code gets 0.5.  Primary is the
    highest score, secondary all others from 0.3 on, in falling order; ties keep catalogue order.
    """
    names = strings(codes)
    fallback = F.array(*[F.lit(0.5 if c == default else 0.0) for c in codes])
    ranked = lambda scaled: F.array_sort(F.transform(
        scaled, lambda score, i: F.struct((-score).alias("minus"), i.alias("order"), F.get(names, i).alias("code"))))
    scaled = rows.withColumn("_raw", raw).withColumn("_top", F.array_max("_raw")).withColumn(
        "_scaled", F.when(F.col("_top") > 0, F.transform("_raw", lambda s: s / F.col("_top"))).otherwise(fallback))
    ordered = scaled.withColumn("_ranked", ranked(F.col("_scaled")))
    others = F.filter(F.slice("_ranked", 2, len(codes) - 1), lambda e: -e["minus"] >= SECONDARY_FROM)
    return ordered.withColumns({
        f"{prefix}_primary": F.get("_ranked", 0)["code"],
        f"{prefix}_secondary": F.transform(others, lambda e: e["code"]),
        f"{prefix}_scores": F.map_from_arrays(names, F.col("_scaled")),
    }).drop("_raw", "_top", "_scaled", "_ranked")


def classify_stride(rows: DataFrame, text: Column, cwe_ids: Column | None = None, tactics: Column | None = None,
                    context: dict[str, Column] | None = None) -> DataFrame:
    # The lowered text is a column of its own: a hundred keyword tests read it.
    rows = rows.withColumn("_low", F.lower(text))
    raw = stride_raw(F.col("_low"), cwe_ids, tactics, context)
    return with_profile(rows, raw, stride.CODES, "I", "stride").drop("_low")


def classify_maestro(rows: DataFrame, text: Column, technologies: Column, flags: dict[str, Column],
                     deployment: Column | None = None, cwe_ids: Column | None = None,
                     context: dict[str, Column] | None = None) -> DataFrame:
    rows = rows.withColumn("_low", F.lower(text))
    raw = maestro_raw(F.col("_low"), technologies, flags, deployment, cwe_ids, context)
    profiled = with_profile(rows, raw, maestro.CODES, "1-Foundation", "maestro").drop("_low")
    return profiled.withColumn("maestro_threats", identified_threats(
        text, F.col("maestro_primary"), F.col("maestro_secondary")))


def identified_threats(text: Column, primary: Column, secondary: Column) -> Column:
    """Catalogue threats named in the text, else the first three of the primary layer."""
    table = {layer: strings(names) for layer, names in maestro.THREATS.items()}
    of_layers = F.flatten(F.transform(F.concat(F.array(primary), secondary), lambda layer: lookup(table, layer)))
    named = F.array_distinct(F.filter(of_layers, lambda t: F.lower(text).contains(F.lower(t))))
    return F.when(F.size(named) > 0, named).otherwise(F.slice(lookup(table, primary), 1, 3))


def profile_text(primary: Column, secondary: Column, separator: str = "") -> Column:
    inner = F.concat(F.lit("("), F.array_join(secondary, separator), F.lit(")"))
    return F.concat(primary, F.when(F.size(secondary) > 0, inner).otherwise(""))


def scan_inputs(repositories: DataFrame) -> DataFrame:
    """Classification inputs of a scanned repository, from its language and framework."""
    return repositories.select(
        "repo_id", F.concat("language", F.lit(" "), "framework", F.lit(" application")).alias("description"),
        F.array("language", "framework").alias("technologies"),
        F.lower("framework").contains("agent").alias("has_agents"))
