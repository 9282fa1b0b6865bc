"""Comparison of two scans of each repository, verdict, drift and trend.

Both scans stand in one table with ``scan_id`` "base" or "head".  A comparison is one grouping by
key with a conditional pick per side -- one shuffle instead of a full outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.catalogs import code
from threatloom.operators import flows
from threatloom.operators.reports import SEVERITIES

BASE, HEAD = "base", "head"

# Verdict presets: fail on critical, fail on high, fail on risk increase, warn on high,
# warn on risk increase, highest risk allowed (0 = none), risk increase allowed (0 = none).
PRESETS = {
    "default": (True, False, False, True, True, 0.8, 0.2),
    "critical": (True, False, False, True, True, 0.0, 0.0),
    "high": (True, True, False, False, False, 0.0, 0.0),
    "any": (True, True, True, False, False, 0.0, 0.0),
    "never": (False, False, False, False, False, 0.0, 0.0),
}
PRESET_FIELDS = ["fail_critical", "fail_high", "fail_increase", "warn_high", "warn_increase", "max_risk_allowed",
                 "increase_allowed"]


def asset_key() -> Column:
    return F.concat("type", F.lit(":"), "name", F.lit("@"), "file")


def threat_key() -> Column:
    return F.concat("title", F.lit(":"), "severity")


def with_content_ids(assets: DataFrame) -> DataFrame:
    """Ids rebuilt from content, so that two scans of the same code compare equal."""
    return assets.withColumn("id", asset_key())


def _side(scan: str, value: Column, order: Column) -> Column:
    """Value of the last row of one scan."""
    here = F.col("scan_id") == scan
    return F.max_by(F.when(here, value), F.when(here, order))


def _change(base: str, head: str) -> Column:
    return F.when(F.col(base).isNull(), "added").when(F.col(head).isNull(), "removed")


def diff_assets(rows: DataFrame) -> DataFrame:
    """Assets added, removed or modified, by type, name and file; the last row of a key counts."""
    held = F.struct("sensitive", "exposed", "description", F.sort_array("tags").alias("tags"))
    sides = rows.groupBy("repo_id", asset_key().alias("key")).agg(
        _side(BASE, held, F.col("ord")).alias("b"), _side(HEAD, held, F.col("ord")).alias("h"))
    moved = lambda name, field: F.when(F.col(f"b.{field}") != F.col(f"h.{field}"), F.concat(
        F.lit(f"{name} changed: "), F.col(f"b.{field}").cast("string"), F.lit(" → "), F.col(f"h.{field}").cast("string")))
    changes = F.array_compact(F.array(
        moved("sensitivity", "sensitive"), moved("exposure", "exposed"),
        F.when(F.col("b.description") != F.col("h.description"), "description changed"),
        F.when(F.col("b.tags") != F.col("h.tags"), "tags changed")))
    both = F.col("b").isNotNull() & F.col("h").isNotNull()
    none = F.array().cast("array<string>")
    return (
        sides.select("repo_id", "key", F.when(both, changes).otherwise(none).alias("changes"),
                     F.coalesce(_change("b", "h"), F.lit("modified")).alias("change"))
        .where((F.col("change") != "modified") | (F.size("changes") > 0))
    )


def critical_modifications(asset_changes: DataFrame) -> DataFrame:
    """Modified assets whose change text names "exposed" or "sensitivity"."""
    hit = F.exists("changes", lambda c: c.contains("exposed") | c.contains("sensitivity"))
    return asset_changes.where((F.col("change") == "modified") & hit)


def diff_keys(rows: DataFrame, key: Column, *carried: str) -> DataFrame:
    """Keys that stand in one scan only."""
    seen = lambda scan: F.bool_or(F.col("scan_id") == scan)
    return (
        rows.groupBy("repo_id", key.alias("key"), *carried).agg(seen(BASE).alias("b"), seen(HEAD).alias("h"))
        .where(F.col("b") != F.col("h"))
        .select("repo_id", "key", *carried, F.when(F.col("h"), "added").otherwise("removed").alias("change"))
    )


def diff_threats(rows: DataFrame) -> DataFrame:
    return diff_keys(rows, threat_key(), "title", "severity")


def diff_paths(rows: DataFrame) -> DataFrame:
    return diff_keys(rows, F.concat("entry", F.lit(":"), "target"))


def diff_dependencies(rows: DataFrame) -> DataFrame:
    """Dependencies added, removed, or with another version."""
    sides = rows.groupBy("repo_id", "name").agg(
        _side(BASE, F.col("version"), F.col("ord")).alias("old_version"),
        _side(HEAD, F.col("version"), F.col("ord")).alias("new_version"))
    updated = F.when(F.col("old_version") != F.col("new_version"), "updated")
    return sides.withColumn("change", F.coalesce(_change("old_version", "new_version"), updated)).where(
        F.col("change").isNotNull())


def diff_flows(per_file: DataFrame, banded: DataFrame) -> DataFrame:
    """Flow keys (source file, destination file, data type) added and removed, counted per kind.

    ``per_file`` holds the flow file counts with ``scan_id``, ``banded`` the files with flows of the
    banded kind.  Any other key inside one file is there when the file has both ends.  Keys from secrets to config files are the product of two file sets, so
    what is new is |head product| - |common product|; no pair is listed.
    """
    cells = []
    for kind, *_ in code.FLOW_KINDS:
        if kind == "auth-api":
            continue
        c = lambda role: F.col(f"{kind.replace('-', '_')}_{role}") > 0
        present = c("src") & c("dst")
        if kind == "env-svc":
            present = present & ~flows.is_config_file(F.col("file"))
        cells.append(F.when(present, F.lit(kind)))
    same_file = per_file.select("repo_id", "scan_id", "file", F.explode(F.array_compact(F.array(*cells))).alias("kind"))
    same_file = same_file.unionByName(banded.select("repo_id", "scan_id", "file", F.lit("auth-api").alias("kind")))
    inside = diff_keys(same_file, F.col("file"), "kind").groupBy("repo_id", "kind").agg(
        F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"))
    has = lambda scan, test: F.bool_or((F.col("scan_id") == scan) & test)
    secret, config = F.col("env_svc_src") > 0, (F.col("env_svc_dst") > 0) & flows.is_config_file(F.col("file"))
    files = per_file.groupBy("repo_id", "file").agg(
        has(BASE, secret).alias("sb"), has(HEAD, secret).alias("sh"), has(BASE, config).alias("cb"), has(HEAD, config).alias("ch"))
    n = lambda test: F.count_if(test)
    sets = files.groupBy("repo_id").agg(
        n(F.col("sb")).alias("sb"), n(F.col("sh")).alias("sh"), n(F.col("sb") & F.col("sh")).alias("sx"),
        n(F.col("cb")).alias("cb"), n(F.col("ch")).alias("ch"), n(F.col("cb") & F.col("ch")).alias("cx"))
    common = F.col("sx") * F.col("cx")
    product = sets.select("repo_id", F.lit("env-svc").alias("kind"), (F.col("sh") * F.col("ch") - common).alias("n_added"),
                          (F.col("sb") * F.col("cb") - common).alias("n_removed"))
    return (
        inside.unionByName(product).groupBy("repo_id", "kind")
        .agg(F.sum("n_added").alias("n_added"), F.sum("n_removed").alias("n_removed"))
        .where((F.col("n_added") > 0) | (F.col("n_removed") > 0))
    )


def change_counts(assets: DataFrame, threats: DataFrame, flow_changes: DataFrame, paths: DataFrame,
                  dependencies: DataFrame) -> DataFrame:
    """Changes per (repo, entity, change)."""
    count = lambda rows, entity: rows.groupBy("repo_id", F.lit(entity).alias("entity"), "change").agg(F.count("*").alias("n"))
    of_flows = flow_changes.select("repo_id", F.explode(F.array(
        F.struct(F.lit("added").alias("change"), F.col("n_added").alias("n")),
        F.struct(F.lit("removed").alias("change"), F.col("n_removed").alias("n")))).alias("c")).groupBy(
        "repo_id", F.lit("flow").alias("entity"), F.col("c.change").alias("change")).agg(F.sum("c.n").alias("n")).where("n > 0")
    return (
        count(assets, "asset").unionByName(count(threats, "threat")).unionByName(of_flows)
        .unionByName(count(paths, "path")).unionByName(count(dependencies, "dependency"))
    )


def change_table(counts: DataFrame) -> DataFrame:
    """One row per repository and entity: added, removed, modified."""
    n = lambda *changes: F.sum(F.when(F.col("change").isin(*changes), F.col("n")).otherwise(0))
    return counts.groupBy("repo_id", "entity").agg(
        n("added").alias("added"), n("removed").alias("removed"), n("modified", "updated").alias("modified"))


def risk_delta(stats: DataFrame) -> DataFrame:
    """Risk of base and head side by side; ``stats`` has max_risk, avg_risk, total_threats per scan."""
    pick = lambda scan, column, default: F.coalesce(F.max(F.when(F.col("scan_id") == scan, F.col(column))), F.lit(default))
    rows = stats.groupBy("repo_id").agg(
        pick(BASE, "max_risk", 0.0).alias("base_max"), pick(HEAD, "max_risk", 0.0).alias("head_max"),
        pick(BASE, "avg_risk", 0.0).alias("base_avg"), pick(HEAD, "avg_risk", 0.0).alias("head_avg"),
        (pick(HEAD, "total_threats", 0) - pick(BASE, "total_threats", 0)).cast("bigint").alias("threat_delta"))
    direction = F.when(F.col("head_max") > F.col("base_max"), "increased").when(
        F.col("head_max") < F.col("base_max"), "decreased").otherwise("unchanged")
    return rows.withColumn("direction", direction)


def diff_summary(counts: DataFrame, threats: DataFrame, deltas: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per repository: all changes, new threats by severity, resolved threats, new paths, risk delta.

    ``repositories`` (repo_id) are those of either scan; one without any threat or change has zeros and gets a verdict too.
    """
    n = lambda entity, change: F.sum(F.when((F.col("entity") == entity) & (F.col("change") == change), F.col("n")).otherwise(0))
    totals = counts.groupBy("repo_id").agg(
        F.sum("n").alias("total_changes"), n("threat", "added").alias("new_threats"),
        n("threat", "removed").alias("resolved_threats"), n("path", "added").alias("new_paths"))
    severe = threats.where(F.col("change") == "added").groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"new_{s}") for s in SEVERITIES])
    rows = repositories.select("repo_id").distinct().join(deltas, "repo_id", "left")
    rows = rows.join(totals, "repo_id", "left").join(severe, "repo_id", "left")
    rows = rows.fillna(0.0, ["base_max", "head_max", "base_avg", "head_avg"]).fillna("unchanged", ["direction"])
    filled = rows.fillna(0, ["threat_delta", "total_changes", "new_threats", "resolved_threats", "new_paths", *[f"new_{s}" for s in SEVERITIES]])
    return filled.withColumn("new_high_severity", F.col("new_critical") + F.col("new_high"))


def verdicts(summary: DataFrame, presets: dict = PRESETS) -> DataFrame:
    """PASS, WARN or FAIL with its reason, per repository and preset: the first rule that applies."""
    options = F.array(*[
        F.struct(F.lit(name).alias("preset"), *[F.lit(v).alias(f) for f, v in zip(PRESET_FIELDS, values)])
        for name, values in presets.items()])
    rows = summary.withColumn("_p", F.explode(options)).select(*summary.columns, "_p.*")
    c = F.col
    ten = lambda column: c(column) * 10
    up = c("head_max") > c("base_max")
    growth = (c("head_max") - c("base_max")) / F.nullif(c("base_max"), F.lit(0.0))
    says = lambda verdict, template, *args: F.struct(
        F.lit(verdict).alias("verdict"), (F.format_string(template, *args) if args else F.lit(template)).alias("reason"))
    risen = ("Risk increased from %.2f to %.2f", ten("base_max"), ten("head_max"))
    outcome = (
        F.when((c("new_critical") > 0) & c("fail_critical"), says("FAIL", "%d new critical threat(s) detected", c("new_critical")))
        .when((c("new_high") > 0) & c("fail_high"), says("FAIL", "%d new high-severity threat(s) detected", c("new_high")))
        .when(up & c("fail_increase"), says("FAIL", *risen))
        .when((c("max_risk_allowed") > 0) & (c("head_max") > c("max_risk_allowed")), says(
            "FAIL", "Risk score %.2f exceeds threshold %.2f", ten("head_max"), ten("max_risk_allowed")))
        .when((c("increase_allowed") > 0) & (growth > c("increase_allowed")), says(
            "FAIL", "Risk increased by %.1f%% (threshold: %.1f%%)", growth * 100, c("increase_allowed") * 100))
        .when((c("new_high") > 0) & c("warn_high"), says("WARN", "%d new high-severity threat(s) detected", c("new_high")))
        .when(up & c("warn_increase"), says("WARN", *risen))
        .when(c("new_threats") > 0, says("WARN", "%d new threat(s) detected", c("new_threats")))
        .when(c("new_paths") > 0, says("WARN", "%d new attack path(s) detected", c("new_paths")))
        .when((c("resolved_threats") > 0) & ~up, says(
            "PASS", "%d threat(s) resolved, risk stable at %.2f", c("resolved_threats"), ten("head_max")))
        .when(c("direction") == "decreased", says("PASS", "Risk decreased from %.2f to %.2f", ten("base_max"), ten("head_max")))
        .when(c("total_changes") == 0, says("PASS", "No changes detected"))
        .otherwise(says("PASS", "No new threats detected. Risk stable at %.2f", ten("head_max")))
    )
    told = rows.withColumn("_o", outcome).select(*rows.columns, "_o.*").drop(*PRESET_FIELDS)
    exit_code = F.when(c("verdict") == "PASS", 0).when(c("verdict") == "FAIL", 2).otherwise(1)
    return told.withColumns({"exit_code": exit_code, "line": summary_line()})


def summary_line() -> Column:
    """One-line result for build logs."""
    c = F.col
    risk = lambda column: F.format_string("%.1f", c(column) * 10)
    moved = F.concat(risk("base_max"), F.lit(" → "), risk("head_max"))
    passed = (
        F.when(c("resolved_threats") > 0, F.concat(c("resolved_threats").cast("string"), F.lit(" threat(s) resolved. Risk stable at "), risk("head_max")))
        .when(c("direction") == "decreased", F.concat(F.lit("Risk decreased "), moved))
        .otherwise(F.concat(F.lit("No new threats. Risk stable at "), risk("head_max")))
    )
    warned = (
        F.when(c("new_high_severity") > 0, F.concat(F.lit("+"), c("new_high_severity").cast("string"), F.lit(" new high-severity threat(s). Risk: "), moved))
        .when(c("direction") == "increased", F.concat(F.lit("Risk increased. Risk: "), moved))
        .otherwise(F.concat(F.lit("+"), c("new_threats").cast("string"), F.lit(" new threat(s). Risk: "), risk("head_max")))
    )
    return (
        F.when(c("verdict") == "PASS", F.concat(F.lit("✅ PASS: "), passed))
        .when(c("verdict") == "WARN", F.concat(F.lit("⚠️ WARN: "), warned))
        .otherwise(F.concat(F.lit("❌ FAIL: "), c("reason")))
    )


def drift_score(summary: DataFrame, lost_mitigations: Column | None = None, new_violations: Column | None = None,
                new_sensitive_flows: Column | None = None) -> DataFrame:
    """Drift from 0 to 100: weighted new threats, resolved ones, lost controls, and risk increase."""
    zero = F.lit(0)
    some = lambda column: zero if column is None else column
    total = (
        20 * F.col("new_critical") + 10 * F.col("new_high") + 5 * F.col("new_medium") - 5 * F.col("resolved_threats")
        + 15 * some(lost_mitigations) + 25 * some(new_violations) + 20 * some(new_sensitive_flows)
        + 10 * F.greatest(F.lit(0.0), F.col("head_max") - F.col("base_max")) / 0.1
    )
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total.cast("double")))
    level = F.when(F.col("drift") >= 70, 2).when(F.col("drift") >= 50, 1).otherwise(0)
    return summary.withColumn("drift", score).withColumn("drift_level", level)


def trend(scans: DataFrame) -> DataFrame:
    """Change of risk and threats from the oldest to the newest scan of a repository."""
    ends = F.struct("max_risk", "total_threats")
    rows = scans.groupBy("repo_id").agg(
        F.count("*").alias("n_scans"), F.min_by(ends, "scan_ts").alias("old"), F.max_by(ends, "scan_ts").alias("new"))
    change = (F.col("new.max_risk") - F.col("old.max_risk")) / F.nullif(F.col("old.max_risk"), F.lit(0.0)) * 100
    direction = F.when(F.col("new.max_risk") > F.col("old.max_risk"), "degrading").when(
        F.col("new.max_risk") < F.col("old.max_risk"), "improving").otherwise("stable")
    return rows.select(
        "repo_id", "n_scans", F.col("old.max_risk").alias("old_risk"), F.col("new.max_risk").alias("new_risk"),
        change.alias("percent_change"), direction.alias("direction"),
        (F.col("new.total_threats") - F.col("old.total_threats")).alias("threat_change"))


WINDOWS = (7, 30, 90)


def trend_windows(scans: DataFrame, days: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Each scan over the last ``days`` days of its repository, itself and scans of the same time included: scans, mean and highest
    risk, and the least-squares slope of risk per day (null where all scans are of one time).

    A window reaches back over at most one border of a period of its own length, so rows stand in their period and, as context, in the next.
    A repository scanned for years is thus many small tasks, not one.  Scans without a time or a risk take no part.
    """
    out = None
    for length in days:
        seconds = length * 86400
        at = F.unix_micros("scan_ts") / 1e6
        period = F.floor(at / seconds)
        rows = scans.where("scan_ts IS NOT NULL AND max_risk IS NOT NULL").select("repo_id", "scan_ts", "max_risk", F.explode(
            F.array(F.struct(period.alias("period"), F.lit(True).alias("own")), F.struct((period + 1).alias("period"), F.lit(False).alias("own")))).alias("p"))
        rows = rows.select("repo_id", "scan_ts", "max_risk", "p.*").withColumns({
            # Days since the start of the period: small numbers lose no digits in the sums.
            "day": (at - F.col("period") * seconds) / 86400, "micros": F.unix_micros("scan_ts")})
        last = Window.partitionBy("repo_id", "period").orderBy("micros").rangeBetween(-seconds * 1_000_000, Window.currentRow)
        slope = F.when(F.min("micros").over(last) < F.max("micros").over(last), F.regr_slope("max_risk", "day").over(last))
        found = rows.select(
            "repo_id", "scan_ts", "own", F.lit(length).cast("bigint").alias("days"), F.count("*").over(last).alias("n_scans"),
            F.avg("max_risk").over(last).alias("mean_risk"), F.max("max_risk").over(last).alias("highest_risk"), slope.alias("slope")).where("own").drop("own")
        out = found if out is None else out.unionByName(found)
    steep = F.round("slope", 9)
    return out.withColumn("direction", F.when(steep > 0, "degrading").when(steep < 0, "improving").otherwise("stable"))


def scan_steps(scans: DataFrame) -> DataFrame:
    """Each scan against the one before it in its repository."""
    before = Window.partitionBy("repo_id").orderBy("scan_ts")
    return scans.withColumn("risk_step", F.col("max_risk") - F.lag("max_risk").over(before))


def as_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """Rows as JSON text, ready for a text sink."""
    fields = F.struct(*[c for c in rows.columns if c != "repo_id"])
    return rows.select("repo_id", F.to_json(fields, {"pretty": "true"} if pretty else {}).alias("value"))
