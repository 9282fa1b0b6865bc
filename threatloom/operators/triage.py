"""Threat triage: normalise, enrich, merge duplicates, prioritise, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threatloom.catalogs import stride
from threatloom.functions import scores
from threatloom.functions.text import ascii_lower, lookup, strings, strip_count_suffix

KEY = ["repo_id", "dedup_key"]


def moment(as_of) -> Column:
    """Every score and filter takes the clock as an argument."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def union_sources(*tables: DataFrame) -> DataFrame:
    """One threats table from several sources; absent columns become null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


KEY_CHARS = 100


def leading(text: str, chars: int | None) -> Column:
    """The first ``chars`` characters, or the whole text for None."""
    return F.col(text) if chars is None else F.substring(text, 1, chars)


def normalize(threats: DataFrame, as_of, title_chars: int | None = KEY_CHARS) -> DataFrame:
    """Default titles, times and lower-case tags; a missing title is the start of the description."""
    title = (
        F.when(F.col("title") != "", F.col("title"))
        .when(F.col("description") != "", leading("description", title_chars))
        .otherwise("Untitled Threat")
    )
    return threats.withColumns({
        "title": title,
        "discovered_at": F.coalesce("discovered_at", moment(as_of)),
        "tags": F.transform("tags", ascii_lower),
    })


def affects_known_assets() -> Column:
    return scores.severity_rank(F.col("severity")) >= 7


def detection_rules() -> Column:
    rules = lookup({k: strings(v) for k, v in stride.ENRICHMENT_RULES.items()}, F.col("stride_primary"))
    return F.coalesce(rules, strings([]))


def enrich(threats: DataFrame) -> DataFrame:
    return threats.withColumns({"affects_known_assets": affects_known_assets(), "detection_rules": detection_rules()})


def dedup_key(key_chars: int | None = KEY_CHARS) -> Column:
    """Key under which rows are merged.  Titles count with their first ``key_chars`` characters, so longer titles that differ
    later are one threat; None compares whole titles."""
    title = leading("title", key_chars)
    from_code = F.exists("tags", lambda tag: ascii_lower(tag) == "code-analysis")
    indicator = F.try_element_at("indicators", F.lit(1))
    return (
        F.when(from_code, F.concat(F.lit("code:"), title))
        .when(F.size("cve_ids") > 0, F.concat(F.lit("cve:"), F.try_element_at("cve_ids", F.lit(1))))
        .when(F.size("indicators") > 0,
              F.concat(F.lit("ioc:"), indicator["type"], F.lit(":"), indicator["value"]))
        .otherwise(F.concat(F.lit("title:"), title))
    )


def _row_values(kind: str, values: Column) -> Column:
    """Distinct values of one row with their first position and how often they occur."""
    return F.transform(
        F.array_distinct(values),
        lambda value: F.struct(
            F.lit(kind).alias("kind"),
            value.alias("value"),
            F.array_position(values, value).alias("pos"),
            F.size(F.filter(values, lambda other: other == value)).alias("copies"),
        ),
    )


def list_values() -> Column:
    """Distinct tags, feeds and indicators of a row, as ``kind, value, pos, copies``."""
    return F.concat(
        _row_values("tag", F.col("tags")),
        _row_values("feed", F.col("source_feeds")),
        _row_values("indicator", F.transform("indicators", lambda i: i["value"])),
    )


def carried(keyed: DataFrame) -> list[str]:
    """Columns that the first row of a key gives."""
    return [c for c in keyed.columns if c not in KEY + ["tags", "source_feeds", "indicators"]]


def first_appearances(keyed: DataFrame) -> DataFrame:
    """Per merged threat and list value: the row and position it first appears at.

    One row per (repo, key, kind, value), so a hot key spreads over its values.
    """
    return (
        keyed.select(*KEY, "ord", F.explode(list_values()).alias("item"))
        .groupBy(*KEY, F.col("item.kind").alias("kind"), F.col("item.value").alias("value"))
        .agg(F.min(F.struct("ord", "item.pos", "item.copies")).alias("first"))
    )


def with_key(threats: DataFrame, key_chars: int | None = KEY_CHARS) -> DataFrame:
    return threats.withColumn("dedup_key", dedup_key(key_chars))


def merge_duplicates(threats: DataFrame, as_of, key_chars: int | None = KEY_CHARS, values: DataFrame | None = None) -> DataFrame:
    """Merge threats that share a key; the first row (by ``ord``) gives the fields.

    The wide row is reduced on the map side, the lists travel as distinct values only, and the
    number of merged indicators is counted, not collected: a key that holds a third of all rows
    costs no more per task than any other.  ``merged_indicators`` lists the indicators.

    ``values`` are the ``first_appearances`` of the same rows and key, for a job that has them already.
    """
    keyed = with_key(threats, key_chars)
    heads = keyed.groupBy(*KEY).agg(
        F.min_by(F.struct(*carried(keyed)), "ord").alias("first"),
        F.count("*").alias("n_rows"),
        F.max(scores.severity_rank(F.col("severity"))).alias("top_rank"),
    )
    return assembled(heads, first_appearances(keyed) if values is None else values, as_of)


def assembled(heads: DataFrame, values: DataFrame, as_of) -> DataFrame:
    """Merged threats from the head of each key (``first, n_rows, top_rank``) and its ``first_appearances``."""
    entry = F.struct(F.col("first.ord").alias("ord"), F.col("first.pos").alias("pos"), "value")
    ordered = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))), lambda e: e["value"]
    )
    # Tags and feeds are vocabularies: what is collected here is one entry per distinct word.
    lists = values.groupBy(*KEY).agg(
        ordered("tag").alias("tags"),
        ordered("feed").alias("source_feeds"),
        F.coalesce(
            F.sum(F.when(F.col("kind") == "indicator", F.col("first.copies"))), F.lit(0)
        ).cast("bigint").alias("n_indicators"),
    )
    instances = (F.greatest(F.col("instance_count"), F.lit(1)) + F.col("n_rows") - 1).cast("bigint")
    counted = F.concat(
        strip_count_suffix(F.col("description")), F.lit(" ("), F.col("instance_count").cast("string"),
        F.lit(" instances across "), F.col("n_indicators").cast("string"), F.lit(" files)"),
    )
    merged = (
        heads.join(lists, KEY, "left")
        .select(*KEY, "first.*", "n_rows", "top_rank", "n_indicators",
                F.coalesce("tags", strings([])).alias("tags"),
                F.coalesce("source_feeds", strings([])).alias("source_feeds"))
        .withColumns({
            "severity": scores.severity_from_rank(F.col("top_rank")),
            "instance_count": instances,
            "n_indicators": F.coalesce("n_indicators", F.lit(0).cast("bigint")),
        })
        .withColumn("description", F.when(
            F.col("dedup_key").startswith("code:") & (F.col("n_rows") > 1), counted
        ).otherwise(F.col("description")))
    )
    return merged.withColumn("priority", scores.threat_priority(moment(as_of))).drop("top_rank")


def merged_indicators(threats: DataFrame, key_chars: int | None = KEY_CHARS) -> DataFrame:
    """The indicators of each merged threat, one row per value, in order of first appearance."""
    return indicator_rows(first_appearances(with_key(threats, key_chars)))


def indicator_rows(values: DataFrame) -> DataFrame:
    return (
        values.where(F.col("kind") == "indicator")
        .select(*KEY, "value", F.col("first.ord").alias("ord"), F.col("first.copies").cast("bigint").alias("copies"))
    )


def worth_keeping(as_of, min_priority: float, max_age_days: int) -> Column:
    return (
        ~F.col("false_positive")
        & (F.col("priority") >= min_priority)
        & (scores.age_days(F.col("discovered_at"), moment(as_of)) <= max_age_days)
    )


def keep(threats: DataFrame, as_of, min_priority: float = 0.0, max_age_days: int = 90) -> DataFrame:
    return threats.where(worth_keeping(as_of, min_priority, max_age_days))


def prioritized(threats: DataFrame) -> DataFrame:
    return threats.orderBy(F.desc("priority"), "repo_id", "ord")


STAGES = ["normalized", "enriched", "deduplicated", "prioritized", "filtered"]


def _stage_sums(as_of, min_priority: float, max_age_days: int) -> list[Column]:
    """Rows after each stage, summed over merged threats."""
    read, merged = F.sum("n_rows"), F.count(F.lit(1))
    last = F.count_if(worth_keeping(as_of, min_priority, max_age_days))
    return [count.alias(name) for count, name in zip((read, read, merged, merged, last), STAGES, strict=True)]


def triage(threats: DataFrame, as_of, min_priority: float = 0.0, max_age_days: int = 90, key_chars: int | None = KEY_CHARS,
           seen: Observation | None = None, values: DataFrame | None = None) -> DataFrame:
    """Triaged threats; ``key_chars=None`` takes whole titles, in merging and where a description stands in.

    ``seen`` holds the rows after each stage once the result has been written, see ``stage_rows``.  ``values`` are the
    ``first_appearances`` of the normalised rows, if the job has them already.

    Known assets are told by the severity of a row before it is merged.  The detection rules follow from a field that the first row
    gives, so they are added behind the merge and do not travel.
    """
    told = normalize(threats, as_of, key_chars).withColumn("affects_known_assets", affects_known_assets()).drop("detection_rules")
    merged = merge_duplicates(told, as_of, key_chars, values).withColumn("detection_rules", detection_rules())
    if seen is not None:
        merged = merged.observe(seen, *_stage_sums(as_of, min_priority, max_age_days))
    return keep(merged, as_of, min_priority, max_age_days)


def stage_rows(seen: Observation) -> dict[str, int]:
    """Rows after each triage stage, in all repositories; waits for the action that makes the result of ``triage``."""
    found = seen.get
    return {name: found.get(name) or 0 for name in STAGES}


def stage_counts(threats: DataFrame, as_of, min_priority: float = 0.0, max_age_days: int = 90) -> DataFrame:
    """Rows after each triage stage per repository, from one run of the merge."""
    merged = merge_duplicates(enrich(normalize(threats, as_of)), as_of)
    return merged.groupBy("repo_id").agg(*_stage_sums(as_of, min_priority, max_age_days))
