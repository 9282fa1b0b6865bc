from threatloom.operators import paths as pt
from threatloom.operators import reports as rp
from threatloom.operators import snapshots as sn

NODE = ("repo_id string, node_id string, label string, node_type string, risk_level string, n_findings int, n_critical int, "
        "n_high int, n_medium int, n_low int, n_with_techniques int, worst_title string, worst_stride string")


def graph(spark, nodes, edges, zones=()):
    node_rows = spark.createDataFrame(
        [("r", n, label, kind, risk, 0, 0, 0, 0, 0, 0, None, None) for n, label, kind, risk in nodes], NODE)
    edge_rows = spark.createDataFrame(
        [("r", s, t, "x", list(p), sens, False) for s, t, p, sens in edges],
        "repo_id string, source string, target string, label string, protocols array<string>, sensitive boolean, encrypted boolean")
    zone_rows = spark.createDataFrame([("r", n, i, z) for i, (n, z) in enumerate(zones)],
                                      "repo_id string, node_id string, zone_order int, zone string")
    found = pt.graph_nodes(node_rows, edge_rows, zone_rows).cache()
    return found, pt.graph_edges(edge_rows, found).cache()


def line(spark):
    return graph(
        spark, [("gw", "api-gateway", "api", "high"), ("be", "backend", "service", "low"), ("db", "database", "database", "critical")],
        [("gw", "be", ["HTTP"], True), ("be", "db", ["SQL"], True)], [("gw", "internet"), ("be", "internal"), ("db", "internal")])


def test_line_graph(spark):
    nodes, edges = line(spark)
    assert {r.node_id for r in nodes.where("is_entry").collect()} == {"gw"}
    assert {r.node_id for r in nodes.where("is_jewel").collect()} == {"gw", "be", "db"}
    assert {r.source: (r.difficulty, r.technique, r.mitre_id, r.privilege) for r in edges.collect()} == {
        "gw": (0.4, "API Exploitation", "T1212", "low"), "be": (0.2, "Database Access", "", "low")}
    rows = {r.target: r for r in pt.score_paths(pt.attack_paths(nodes, edges), nodes).collect()}
    assert abs(rows["db"].total_difficulty - 0.08) < 1e-9
    assert abs(rows["db"].composite_risk - 6.42) < 1e-6
    assert abs(rows["be"].composite_risk - 4.9) < 1e-6 or abs(rows["be"].composite_risk - 5.4) < 1e-6
    assert rows["db"].tactics == ["Initial Access", "Credential Access", "Collection", "Exfiltration"]


def test_story_names_every_step(spark):
    nodes, edges = line(spark)
    scored = pt.score_paths(pt.attack_paths(nodes, edges), nodes)
    text = {r.target: r.narrative for r in pt.narratives(scored, nodes).collect()}["db"]
    assert text.startswith("A script kiddie accesses the api api-gateway (ENTRY POINT). the attacker leverages the API connection "
                           "to reach the service backend (T1212). Then, the attacker uses the database connection to reach the "
                           "database database with minimal effort. ")
    assert "(CROWN JEWEL)" in text and "Composite Risk Score: 6.4/10.0 (HIGH)" in text


def test_diamond_has_two_paths(spark):
    nodes, edges = graph(spark, [("e", "e", "api", "low"), ("p", "p", "service", "low"), ("q", "q", "service", "low"), ("t", "t", "database", "low")],
                         [("e", "p", [], False), ("e", "q", [], False), ("p", "t", [], False), ("q", "t", [], False)])
    assert sorted(r.visited for r in pt.attack_paths(nodes, edges).collect()) == [["e", "p", "t"], ["e", "q", "t"]]


def test_cycles_end_and_depth_is_bounded(spark):
    nodes, edges = graph(spark, [("e", "e", "api", "low"), ("a", "a", "service", "low"), ("b", "b", "service", "low"), ("t", "t", "database", "low")],
                         [("e", "a", [], False), ("a", "b", [], False), ("b", "a", [], False), ("b", "t", [], False)])
    assert [r.visited for r in pt.attack_paths(nodes, edges).collect()] == [["e", "a", "b", "t"]]
    assert pt.attack_paths(nodes, edges, max_depth=2).count() == 0


def test_easiest_path_prefers_the_lower_sum(spark):
    nodes, edges = graph(spark, [("e", "e", "api", "low"), ("m", "m", "service", "low"), ("t", "t", "database", "low")],
                         [("e", "t", [], False), ("e", "m", [], True), ("m", "t", [], False)], [("e", "internet"), ("m", "internet")])
    rows = {(r.entry, r.target): r for r in pt.easiest_paths(nodes, edges).collect()}
    assert rows["e", "t"].visited == ["e", "t"] and abs(rows["e", "t"].total_cost - 0.5) < 1e-9
    assert rows["m", "t"].visited == ["m", "t"]


def test_scan_stats(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    threats = spark.createDataFrame([("r", "critical"), ("r", "high"), ("r", "low")], "repo_id string, severity string")
    mapped = spark.createDataFrame([("r", 0.8), ("r", 0.6), ("r", 0.4)], "repo_id string, risk double")
    paths = spark.createDataFrame([("r", 7.5)], "repo_id string, composite_risk double")
    row = rp.scan_stats(none("repo_id string"), none("repo_id string, n_flows bigint"), threats, mapped, paths).first()
    assert (row.max_risk, round(row.avg_risk, 6), row.critical_threats, row.high_threats) == (0.8, 0.6375, 1, 1)


def test_threat_and_asset_changes(spark):
    threats = spark.createDataFrame([("r", "head", "SQL Injection", "critical"), ("r", "head", "XSS", "high")],
                                    "repo_id string, scan_id string, title string, severity string")
    changed = sn.diff_threats(threats)
    assert {(r.title, r.change) for r in changed.collect()} == {("SQL Injection", "added"), ("XSS", "added")}
    rows = [("r", "base", 1, "api", "n", "f", False, False, "d", ["b", "a"]), ("r", "head", 1, "api", "n", "f", True, True, "d", ["a", "b"])]
    assets = spark.createDataFrame(rows, "repo_id string, scan_id string, ord int, type string, name string, file string, "
                                         "sensitive boolean, exposed boolean, description string, tags array<string>")
    row = sn.diff_assets(assets).first()
    assert (row.change, row.changes) == ("modified", ["sensitivity changed: false → true", "exposure changed: false → true"])


def test_verdict_ladder(spark):
    base = dict(repo_id="r", base_max=0.5, head_max=0.5, base_avg=0.1, head_avg=0.1, threat_delta=0, direction="unchanged",
                total_changes=0, new_threats=0, resolved_threats=0, new_paths=0, new_critical=0, new_high=0, new_medium=0, new_low=0,
                new_info=0, new_high_severity=0)
    cases = [
        ({}, "default", "PASS", "No changes detected"),
        ({"new_critical": 1, "new_threats": 1}, "default", "FAIL", "1 new critical threat(s) detected"),
        ({"new_high": 2, "new_threats": 2}, "default", "WARN", "2 new high-severity threat(s) detected"),
        ({"new_high": 2, "new_threats": 2}, "high", "FAIL", "2 new high-severity threat(s) detected"),
        ({"head_max": 0.9, "direction": "increased"}, "default", "FAIL", "Risk score 9.00 exceeds threshold 8.00"),
        ({"head_max": 0.7, "direction": "increased"}, "default", "FAIL", "Risk increased by 40.0% (threshold: 20.0%)"),
        ({"head_max": 0.7, "direction": "increased"}, "any", "FAIL", "Risk increased from 5.00 to 7.00"),
        ({"new_paths": 3, "total_changes": 3}, "never", "WARN", "3 new attack path(s) detected"),
        ({"resolved_threats": 2, "total_changes": 2}, "default", "PASS", "2 threat(s) resolved, risk stable at 5.00"),
    ]
    rows = [{**base, **change, "repo_id": str(i)} for i, (change, *_) in enumerate(cases)]
    got = {(r.repo_id, r.preset): (r.verdict, r.reason) for r in sn.verdicts(spark.createDataFrame(rows)).collect()}
    for i, (_, preset, verdict, reason) in enumerate(cases):
        assert got[(str(i), preset)] == (verdict, reason)
