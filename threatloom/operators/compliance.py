"""PCI DSS mapping of threats and the compliance report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.catalogs import pci
from threatloom.functions import scores
from threatloom.functions.scores import pick
from threatloom.functions.text import any_of, lookup, strings
from threatloom.operators.reports import first_per

NO_MATCH = "array<struct<sub_id:string,confidence:double,reason:string>>"


def _row(sub_id: str, confidence: float, reason: Column) -> Column:
    return F.struct(F.lit(sub_id).alias("sub_id"), F.lit(confidence).alias("confidence"), reason.alias("reason"))


def _rows(entries) -> Column:
    return F.array(*[_row(s, c, F.lit(r)) for s, c, r in entries])


def _when(test: Column, rows: Column) -> Column:
    return F.when(test, rows).otherwise(F.array().cast(NO_MATCH))


def by_category(category: Column) -> Column:
    return F.coalesce(lookup({k: _rows(v) for k, v in pci.BY_STRIDE.items()}, category), F.array().cast(NO_MATCH))


def by_weakness(cwes: Column, strict: bool = False) -> Column:
    """Weakness texts by substring, as the catalogue is defined; ``strict`` compares whole numbers."""
    def of_one(cwe: Column) -> Column:
        parts = []
        for ids, entries in pci.BY_CWE:
            if strict:
                test = F.regexp_extract(cwe, r"(\d+)", 1).isin(*ids)
            else:
                test = any_of(F.lower(cwe), ids)
            parts.append(_when(test, F.array(*[
                _row(s, c, F.concat(F.lit("CWE "), cwe, F.lit(": "), F.lit(r))) for s, c, r in entries])))
        return F.concat(*parts)
    return F.flatten(F.transform(cwes, of_one))


def by_keyword(low: Column) -> Column:
    """Phrases in lower-case text."""
    return F.concat(*[_when(any_of(low, words), _rows(entries)) for words, entries in pci.BY_KEYWORD])


def by_rule_id(rule_ids: Column) -> Column:
    def of_one(rule: Column) -> Column:
        return F.concat(*[
            _when(any_of(F.lower(rule), words), F.array(_row(sub, confidence, F.concat(F.lit(head), rule))))
            for words, sub, confidence, head in pci.BY_RULE_ID])
    return F.flatten(F.transform(rule_ids, of_one))


def merged(candidates: Column) -> Column:
    """One entry per sub-requirement: highest confidence; reasons joined unless already contained."""
    subs = F.array_distinct(F.transform(candidates, lambda m: m["sub_id"]))
    start = F.struct(F.lit(0.0).cast("double").alias("confidence"), F.lit("").alias("reason"))
    fold = lambda acc, m: F.struct(
        F.greatest(acc["confidence"], m["confidence"]).alias("confidence"),
        F.when(acc["reason"] == "", m["reason"]).when(acc["reason"].contains(m["reason"]), acc["reason"])
        .otherwise(F.concat(acc["reason"], F.lit(" | "), m["reason"])).alias("reason"))
    return F.transform(subs, lambda sub: F.struct(
        sub.alias("sub_id"),
        F.aggregate(F.filter(candidates, lambda m: m["sub_id"] == sub), start, fold).alias("m")))


def map_requirements(threats: DataFrame, strict: bool = False) -> DataFrame:
    """Threats (title, description, stride_primary, cwes, rule_ids) to PCI DSS sub-requirements.

    All four signals are weighed inside the row, so the whole mapping is one narrow stage.
    """
    all_rows = F.concat(by_category(F.col("stride_primary")), by_weakness(F.col("cwes"), strict),
                        by_keyword(F.col("_low")), by_rule_id(F.col("rule_ids")))
    lowered = threats.withColumn("_low", F.lower(F.concat("title", F.lit(" "), "description")))
    listed = lowered.withColumn("_all", all_rows)
    return (
        listed.withColumn("_m", F.explode(merged(F.col("_all")))).drop("_all")
        .select(*threats.columns, F.split_part("_m.sub_id", F.lit("."), F.lit(1)).alias("req_id"), "_m.sub_id",
                "_m.m.confidence", "_m.m.reason")
    )


def with_requirement(rows: DataFrame) -> DataFrame:
    titles = lookup({r[0]: r[1] for r in pci.REQUIREMENTS}, F.col("req_id"))
    texts = lookup({s["sub_id"]: s["description"] for s in pci.sub_requirements()}, F.col("sub_id"))
    return rows.withColumns({"requirement": titles, "sub_description": texts})


def status_of(rank: Column, n: Column) -> Column:
    return (
        F.when(n == 0, "Not Tested").when(rank >= 7, "Fail").when(rank == 5, "Partial")
        .when(n > 5, "Partial").otherwise("Pass")
    )


def sub_requirement_results(mappings: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """Per repository and relevant sub-requirement: findings, highest severity, status.

    ``repositories`` (repo_id) are all that were looked at: one without a finding is "Not Tested" throughout.  Without it
    only repositories with a mapped finding show.  Mappings are counted first; each repository then carries at most one entry per
    sub-requirement, and the fixed list of relevant ones is laid over it.
    """
    counted = mappings.groupBy("repo_id", "sub_id").agg(
        F.count("*").alias("n"), F.max(scores.severity_rank(F.col("severity"))).alias("rank"))
    packed = counted.groupBy("repo_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sub_id", F.struct("n", "rank")))).alias("found"))
    if repositories is not None:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<n:bigint,rank:int>>"))
        packed = repositories.select("repo_id").distinct().join(packed, "repo_id", "left").withColumn("found", F.coalesce("found", none))
    relevant = strings([s["sub_id"] for s in pci.sub_requirements() if s["relevant"]])
    laid = packed.select("repo_id", F.explode(relevant).alias("sub_id"), "found").withColumn(
        "f", F.try_element_at("found", F.col("sub_id")))
    n = F.coalesce("f.n", F.lit(0).cast("bigint"))
    rank = F.greatest(F.coalesce("f.rank", F.lit(1)), F.lit(1))
    return laid.select(
        "repo_id", F.split_part("sub_id", F.lit("."), F.lit(1)).alias("req_id"), "sub_id", n.alias("n_findings"),
        scores.severity_from_rank(rank).alias("highest_severity"), status_of(rank, n).alias("status"))


def requirement_results(subs: DataFrame) -> DataFrame:
    """Requirement status is the worst of its sub-requirements; all twelve requirements show."""
    any_status = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    found = subs.groupBy("repo_id", "req_id").agg(
        F.sum("n_findings").alias("n_findings"), any_status("Fail").alias("fail"),
        any_status("Partial").alias("partial"), any_status("Pass").alias("ok"))
    packed = found.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "req_id", F.struct("n_findings", "fail", "partial", "ok")))).alias("found"))
    laid = packed.select("repo_id", F.explode(strings([r[0] for r in pci.REQUIREMENTS])).alias("req_id"), "found")
    laid = laid.withColumn("f", F.try_element_at("found", F.col("req_id")))
    status = F.when(F.col("f.fail"), "Fail").when(F.col("f.partial"), "Partial").when(F.col("f.ok"), "Pass").otherwise("Not Tested")
    return laid.select("repo_id", "req_id", F.coalesce("f.n_findings", F.lit(0).cast("bigint")).alias("n_findings"),
                       status.alias("status"))


def status_breakdown(requirements: DataFrame) -> DataFrame:
    total = F.lit(float(len(pci.REQUIREMENTS)))
    return requirements.groupBy("repo_id", "status").agg(
        F.count("*").alias("n_requirements"), (F.count("*") / total * 100).alias("percent"))


def gaps(subs: DataFrame) -> DataFrame:
    """Relevant sub-requirements without a finding."""
    return subs.where(F.col("n_findings") == 0).select("repo_id", "req_id", "sub_id")


def recommendations(subs: DataFrame, limit: int | None = None) -> DataFrame:
    """Remediation of sub-requirements with findings by priority, 1 first."""
    base = pick(F.col("highest_severity"), {"critical": 10, "high": 30, "medium": 50, "low": 70, "info": 90}, 100)
    less = F.when(F.col("n_findings") > 10, 10).when(F.col("n_findings") > 5, 5).otherwise(0)
    described = with_requirement(subs.where(F.col("n_findings") > 0))
    action = F.coalesce(lookup(pci.ACTIONS, F.col("sub_id")), F.concat(
        F.lit("Review and remediate findings for "), "sub_id", F.lit(": "), "sub_description"))
    rows = described.withColumns({"priority": F.greatest(F.lit(1), base - less), "action": action})
    if limit is None:
        return rows
    return first_per(rows, ["repo_id"], ["priority", "sub_id"], limit)


def top_requirements(mappings: DataFrame, limit: int = 5) -> DataFrame:
    """Most frequent requirement keys of a repository, keyed "<requirement>.<sub-requirement>"."""
    keyed = mappings.groupBy("repo_id", F.concat("req_id", F.lit("."), "sub_id").alias("key")).agg(F.count("*").alias("n"))
    return first_per(keyed, ["repo_id"], [F.desc("n"), "key"], limit)
