"""Whole jobs over many repositories: scan, compliance, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threatloom.operators import (
    archetypes, assets, best_paths, classify, compliance, diagram, findings, flows, incremental, manifests, mapping, paths, reports, rules, snapshots,
    techniques, triage)
from threatloom.session import checkpointed
from threatloom.sources import files as trees


def detected(files: DataFrame) -> DataFrame:
    """Assets of code files (repo_id, path, content), file by file."""
    lines = assets.split_lines(assets.code_files(files)).select(
        "repo_id", F.col("path").alias("file"), "line_no", "line",
        # Files in the order of their paths, lines in order; a text key never runs out of room.
        F.concat("path", F.lit("\x00"), F.lpad(F.col("line_no").cast("string"), 10, "0")).alias("ord"))
    return assets.detect_assets(lines)


def rescan(files: DataFrame, last_index: DataFrame, last_assets: DataFrame) -> dict[str, DataFrame]:
    """``index``, ``assets`` and ``changes`` of a scan after an earlier one, told by the hash of each file's text.  Keep index and
    assets for the next time, and pass ``assets`` to ``scan`` as ``found``.  For a first scan pass empty tables."""
    index, found, changed = incremental.rescan(files, last_index, last_assets, detected)
    return {"index": index, "assets": checkpointed(found), "changes": changed}


def rescan_trees(spark: SparkSession, root: str, last_index: DataFrame, last_assets: DataFrame) -> dict[str, DataFrame]:
    """``rescan`` of the trees below ``root``; only files whose size or time of change differs, or that are new, are opened.

    The index carries ``size`` and ``modified`` too.  A file that was touched and has its old text keeps its assets.  A text replaced
    by another of its size that carries the old time is not seen; ``rescan`` sees it.
    """
    listed = checkpointed(trees.list_trees(spark, root))
    stamp = {name: name for name in ("repo_id", "path", "size", "modified")}
    opened = checkpointed(incremental.without(listed, last_index, stamp).select("repo_id", "path", "size", "modified"))
    files = checkpointed(trees.read_listed(spark, root, opened))
    fresh = opened.join(incremental.file_index(files), ["repo_id", "path"])
    index = checkpointed(incremental.without(last_index, incremental.without(listed, opened, {"repo_id": "repo_id", "path": "path"}),
                                             stamp, "left_semi").select(*fresh.columns).unionByName(fresh))
    changed = checkpointed(incremental.changes(index, last_index))
    found = incremental.refreshed(files, changed, last_assets, detected)
    return {"index": index, "assets": checkpointed(found), "changes": changed}


def scan(files: DataFrame, as_of, feed_threats: DataFrame | None = None, min_priority: float = 0.0,
         max_age_days: int = 90, top_paths: int = 10, key_chars: int | None = triage.KEY_CHARS,
         found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Threat model of every repository in ``files`` (repo_id, path, content).

    Stage tables that several branches read are written once; all else stays lazy.  ``critical_paths`` are found by bounds; only
    ``paths`` and ``stats`` list all paths.  ``key_chars=None`` merges by whole titles.  ``found``: assets that are known already, see ``rescan``.
    ``stage_rows`` (stage, n) tells the rows of each stage and of triage's steps, counted while the stages are written.
    """
    rows: dict[str, int] = {}
    seen = Observation()
    languages = checkpointed(manifests.languages(files), rows, "languages")
    frameworks = checkpointed(manifests.frameworks(files, languages), rows, "frameworks")
    profiles = archetypes.profiles(archetypes.signals(files, languages), frameworks)
    inputs = classify.scan_inputs(frameworks)
    found = checkpointed(detected(files), rows, "assets") if found is None else found
    sites = checkpointed(flows.unique_sites(found), rows, "sites", by=flows.FILE)
    dependencies = manifests.dependencies(files, languages)
    raw = rules.code_threats(found, sites, as_of)
    if feed_threats is not None:
        raw = triage.union_sources(raw, feed_threats.withColumn("ord", F.lpad(F.col("ord").cast("string"), 20, "0")))
    raw = checkpointed(raw, rows, "raw threats")  # triage reads it for the rows and again for their lists
    threats = checkpointed(techniques.with_technique_ids(triage.triage(raw, as_of, min_priority, max_age_days, key_chars, seen)), rows, "threats")
    rows.update(triage.stage_rows(seen))
    flow_rows = flows.flow_summary(sites)
    affected = mapping.affected_dependencies(
        threats, triage.merged_indicators(triage.normalize(raw, as_of, key_chars), key_chars), dependencies)
    mapped = checkpointed(mapping.map_threats(threats, mapping.repository_counts(found, flow_rows), affected), rows, "mapped")
    node_rows = checkpointed(diagram.nodes(found, threats), rows, "nodes")
    edge_rows = checkpointed(diagram.edges(sites), rows, "edges")
    graph_nodes = checkpointed(paths.graph_nodes(node_rows, edge_rows, diagram.trust_zones(node_rows)))
    graph_edges = checkpointed(paths.graph_edges(edge_rows, graph_nodes))
    scored = paths.score_paths(paths.attack_paths(graph_nodes, graph_edges), graph_nodes)
    return {
        "frameworks": frameworks, "profiles": profiles, "adjustments": archetypes.adjustments(profiles),
        "maestro": classify.classify_maestro(
            inputs, F.col("description"), F.col("technologies"), {"has_agents": F.col("has_agents")}),
        "assets": found, "sites": sites, "flows": flow_rows, "dependencies": dependencies, "threats": threats,
        "mapped": mapped, "nodes": graph_nodes, "edges": edge_rows, "paths": scored,
        "critical_paths": best_paths.top_scored(graph_nodes, graph_edges, top_paths),
        "mitigations": mapping.code_mitigations(mapped, languages).unionByName(
            mapping.patch_mitigations(affected, mapped, languages)),
        "stats": reports.scan_stats(found, flow_rows, threats, mapped, scored),
        "stage_rows": files.sparkSession.createDataFrame(list(rows.items()), "stage string, n bigint"),
    }


def compliance_report(finding_rows: DataFrame, as_of, repositories: DataFrame | None = None) -> dict[str, DataFrame]:
    """PCI DSS report of static-analysis findings; ``repositories`` (repo_id) without any finding are reported as not tested."""
    threats = findings.finding_threats(findings.map_findings(finding_rows), as_of)
    mappings = checkpointed(compliance.map_requirements(threats))
    subs = compliance.sub_requirement_results(mappings, repositories)
    requirements = compliance.requirement_results(subs)
    return {
        "mappings": mappings, "sub_requirements": subs, "requirements": requirements,
        "breakdown": compliance.status_breakdown(requirements), "gaps": compliance.gaps(subs),
        "recommendations": compliance.recommendations(subs),
    }


def join_scan(rows: DataFrame) -> DataFrame:
    """Each scan as a repository of its own, so one run covers both scans of all repositories."""
    return rows.withColumn("repo_id", F.concat("scan_id", F.lit("|"), "repo_id")).drop("scan_id")


def split_scan(rows: DataFrame) -> DataFrame:
    """The scan (up to the first bar) and the repository again."""
    return rows.withColumns({
        "scan_id": F.substring_index("repo_id", "|", 1), "repo_id": F.regexp_replace("repo_id", r"^[^|]*\|", "")})


def scan_sites(asset_rows: DataFrame) -> DataFrame:
    return checkpointed(flows.unique_sites(join_scan(asset_rows)), by=flows.FILE)


def flow_diff(sites: DataFrame) -> DataFrame:
    return snapshots.diff_flows(split_scan(flows.file_counts(sites)), split_scan(flows.banded_files(sites)))


def path_pairs(asset_rows: DataFrame, threat_rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Entries and targets of each scan; which pairs are joined is all that a comparison needs."""
    node_rows = checkpointed(diagram.nodes(join_scan(asset_rows), techniques.with_technique_ids(join_scan(threat_rows))))
    edge_rows = checkpointed(diagram.edges(sites))
    graph_nodes = checkpointed(paths.graph_nodes(node_rows, edge_rows, diagram.trust_zones(node_rows)))
    return split_scan(paths.reachable_pairs(graph_nodes, paths.graph_edges(edge_rows, graph_nodes)))


def risk_stats(threat_rows: DataFrame) -> DataFrame:
    return threat_rows.groupBy("repo_id", "scan_id").agg(
        F.round(F.max("priority"), 6).alias("max_risk"), F.round(F.avg("priority"), 6).alias("avg_risk"),
        F.count("*").alias("total_threats"))


def compare(asset_rows: DataFrame, threat_rows: DataFrame, dependency_rows: DataFrame,
            repositories: DataFrame | None = None) -> dict[str, DataFrame]:
    """Comparison of the scans "base" and "head" of every repository, from tables that carry ``scan_id``.

    ``threat_rows`` are triaged.  ``repositories`` (repo_id) are those that were scanned; by default those that occur in one
    of the tables.  Every stage table is made once and shared by all results.
    """
    threats = checkpointed(threat_rows)
    sites = scan_sites(asset_rows)
    if repositories is None:
        repositories = asset_rows.select("repo_id").union(threats.select("repo_id")).union(dependency_rows.select("repo_id"))
    changes = {
        "assets": checkpointed(snapshots.diff_assets(asset_rows)), "threats": checkpointed(snapshots.diff_threats(threats)),
        "flows": checkpointed(flow_diff(sites)), "paths": checkpointed(snapshots.diff_paths(path_pairs(asset_rows, threats, sites))),
        "dependencies": checkpointed(snapshots.diff_dependencies(dependency_rows))}
    counts = snapshots.change_counts(*changes.values())
    summary = checkpointed(snapshots.diff_summary(counts, changes["threats"], snapshots.risk_delta(risk_stats(threats)), repositories))
    return {
        **changes, "change_table": snapshots.change_table(counts), "summary": summary, "verdicts": snapshots.verdicts(summary),
        "drift": snapshots.drift_score(summary)}
