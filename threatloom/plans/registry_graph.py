"""Registered queries: diagram, attack graph, attack paths."""

from pyspark.sql import functions as F

from threatloom.functions import scores
from threatloom.operators import best_paths as bp
from threatloom.operators import diagram as dg
from threatloom.operators import flows as fl
from threatloom.operators import paths as pt
from threatloom.operators import reports as rp
from threatloom.operators import techniques as te
from threatloom.plans.registry_assets import endpoints, sites
from threatloom.plans.registry_mapping import mapped, stage
from threatloom.plans.registry_triage import text, triaged
from threatloom.session import checkpointed
from threatloom.sources import sample_views as v


def threats(spark, d):
    return te.with_technique_ids(triaged(spark, d))


def nodes(spark, d):
    return dg.nodes(v.assets(spark, d), threats(spark, d))


def graph(spark, d, site_rows=None, threat_rows=None):
    """Nodes and edges of the attack graph, materialised once for the path loop."""
    node_rows = checkpointed(dg.nodes(v.assets(spark, d), te.with_technique_ids(threat_rows)) if threat_rows is not None else nodes(spark, d))
    edge_rows = checkpointed(dg.edges(sites(spark, d) if site_rows is None else site_rows))
    graph_nodes = checkpointed(pt.graph_nodes(node_rows, edge_rows, dg.trust_zones(node_rows)))
    return graph_nodes, pt.graph_edges(edge_rows, graph_nodes)


def scored(spark, d, *stages):
    graph_nodes, graph_edges = graph(spark, d, *stages)
    return pt.score_paths(pt.attack_paths(graph_nodes, graph_edges), graph_nodes), graph_nodes


def _edges(spark, d):
    return dg.edges(sites(spark, d)).select(
        "repo_id", "source", "target", "data_type", "sensitive", "encrypted", "label",
        text("protocols").alias("protocols"), text("threats").alias("threats"))


def _graph_nodes(spark, d):
    return graph(spark, d)[0].select(
        "repo_id", "node_id", "zone", "is_entry", "is_jewel", F.round("exploitability", 6).alias("exploitability"),
        F.round("jewel_value", 6).alias("jewel_value"), F.round("exposure", 6).alias("exposure"))


def _graph_edges(spark, d):
    return graph(spark, d)[1].select(
        "repo_id", "source", "target", F.round("difficulty", 6).alias("difficulty"), "privilege", "technique", "mitre_id")


def _paths(spark, d):
    return scored(spark, d)[0].select(
        "repo_id", "path_key", F.col("n_steps").cast("bigint").alias("n_steps"),
        F.round("total_difficulty", 6).alias("total_difficulty"),
        F.col("n_crossings").cast("bigint").alias("n_crossings"), text("tactics", " > ").alias("tactics"),
        F.round("composite_risk", 6).alias("composite_risk"),
        scores.path_risk_level(F.col("composite_risk")).alias("risk_level"))


def _stories(spark, d):
    graph_nodes, graph_edges = graph(spark, d)
    top = bp.top_scored(graph_nodes, checkpointed(graph_edges), 3)
    return pt.narratives(top, graph_nodes).select("repo_id", "path_key", "narrative")


def _critical(spark, d):
    graph_nodes, graph_edges = graph(spark, d)
    return bp.top_scored(graph_nodes, checkpointed(graph_edges), 5).select("repo_id", "path_key", F.col("rank").cast("bigint").alias("rank"))


def scan_stats(spark, d):
    site_rows, staged = sites(spark, d), stage(spark, d)
    flow_rows = checkpointed(fl.flow_summary(site_rows))
    paths = scored(spark, d, site_rows, staged[0])[0]
    return rp.scan_stats(v.assets(spark, d), flow_rows, staged[0], mapped(spark, d, staged, flow_rows), paths)


def _payload(spark, d):
    node_rows = checkpointed(nodes(spark, d))
    return dg.payload(node_rows, dg.edges(sites(spark, d)), dg.trust_zones(node_rows))


def _locations(spark, d):
    return dg.flow_locations(endpoints(spark, d)).select("repo_id", "location", "n_flows")


QUERIES = {
    "diagram_nodes": lambda s, d: nodes(s, d).drop("n_medium", "n_low"),
    "diagram_edges": _edges,
    "diagram_zones": lambda s, d: dg.trust_zones(nodes(s, d)).select("repo_id", "node_id", "zone_name", "zone"),
    "diagram_risk_breakdown": lambda s, d: nodes(s, d).groupBy("repo_id", "risk_level").agg(F.count("*").alias("n_nodes")),
    "diagram_node_search": lambda s, d: dg.node_search(nodes(s, d), "database").select("repo_id", "node_id"),
    "diagram_payload": _payload,
    "flow_locations": _locations,
    "graph_nodes": _graph_nodes,
    "graph_edges": _graph_edges,
    "attack_paths": _paths,
    "critical_paths": _critical,
    "easiest_paths": lambda s, d: pt.easiest_paths(*graph(s, d)).select(
        "repo_id", "entry", "target", F.round("total_cost", 6).alias("total_cost")),
    "path_narratives": _stories,
    "scan_stats": lambda s, d: scan_stats(s, d).withColumns({
        "max_risk": F.round("max_risk", 6), "avg_risk": F.round("avg_risk", 6)}),
    "scan_badges": lambda s, d: rp.badge(scan_stats(s, d)),
}
