from checks import ask
from checks.assets import FLOWS, any_like
from checks.mapping import MAPPED
from checks.rules import case
from checks.triage import MERGE
from threatloom.catalogs import attack, code

LINK = "(VALUES " + ", ".join(f"('{w}')" for w in code.LINK_WORDS) + ") w(word)"
NODE_TYPE = "coalesce(" + case("type", {repr(k): x for k, x in code.NODE_TYPES.items()}) + ", 'service')"
LABEL = "coalesce(" + case("type", {repr(k): x for k, x in code.NODE_LABELS.items()}) + ", type)"
# Distinct (node, threat) links by brute force over the assets' distinct names.
NODES = """
th AS MATERIALIZED (SELECT *, lower(title || ' ' || description) AS txt FROM triaged),
an AS MATERIALIZED (SELECT DISTINCT repo_id, type || '-' || split_part(file, '/', 1) AS node_id, lower(name || ' ' || type) AS txt FROM v_asset),
lk AS MATERIALIZED (SELECT DISTINCT an.repo_id, an.node_id, th.id, th.ord, th.severity, th.title, th.stride_primary, th.stride_second FROM an JOIN th ON th.repo_id = an.repo_id
  JOIN """ + LINK + """ ON contains(an.txt, word) AND contains(th.txt, word)),
lc AS (SELECT repo_id, node_id, count(*) AS n_findings, count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE severity = 'medium') AS n_medium,
   count(*) FILTER (WHERE severity = 'low') AS n_low, count(*) FILTER (WHERE stride_primary IS NOT NULL) AS n_with_techniques FROM lk GROUP BY ALL),
lw AS (SELECT repo_id, node_id, title AS worst_title, CASE WHEN stride_primary IS NULL THEN '' ELSE stride_primary || CASE WHEN stride_second IS NULL THEN '' ELSE '(' || stride_second || ')' END END AS worst_stride FROM lk WHERE severity <> 'info'
   QUALIFY row_number() OVER (PARTITION BY repo_id, node_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, ord) = 1),
ag AS (SELECT repo_id, type || '-' || split_part(file, '/', 1) AS node_id, type, count(*) AS n_assets, count(DISTINCT file) AS n_files, min_by(name, ord) AS name, min_by(description, ord) AS descr,
   max(CASE WHEN sensitive AND exposed THEN 7 WHEN sensitive OR exposed THEN 5 ELSE 3 END) AS base FROM v_asset GROUP BY ALL),
nd AS MATERIALIZED (SELECT ag.repo_id, ag.node_id, CASE WHEN type = 'api' AND n_assets = 1 THEN name ELSE """ + LABEL + """ || ' (' || n_assets || ')' END AS label, """ + NODE_TYPE + """ AS node_type,
   CASE greatest(base, CASE WHEN n_critical > 0 THEN 10 WHEN n_high > 0 THEN 7 WHEN n_medium > 0 THEN 5 ELSE 0 END) WHEN 10 THEN 'critical' WHEN 7 THEN 'high' WHEN 5 THEN 'medium' ELSE 'low' END AS risk_level,
   CASE WHEN n_assets = 1 THEN descr ELSE n_assets || ' assets across ' || n_files || ' files' END AS description, n_assets, n_files, coalesce(n_findings, 0) AS n_findings, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
   coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_with_techniques, 0) AS n_with_techniques, worst_title, worst_stride
   FROM ag LEFT JOIN lc ON lc.repo_id = ag.repo_id AND lc.node_id = ag.node_id LEFT JOIN lw ON lw.repo_id = ag.repo_id AND lw.node_id = ag.node_id)"""
EDGES = """
lo AS MATERIALIZED (SELECT repo_id, file, line, min_by(type, ord) || '-' || split_part(file, '/', 1) AS node_id, bool_or(type = 'cryptography') AS enc FROM v_asset GROUP BY repo_id, file, line),
ed AS MATERIALIZED (SELECT f.repo_id, s.node_id AS source, d.node_id AS target, f.data_type, f.kind, f.sensitive, s.enc OR d.enc AS encrypted
  FROM flow f JOIN lo s ON s.repo_id = f.repo_id AND s.file = f.src_file AND s.line = f.src_line JOIN lo d ON d.repo_id = f.repo_id AND d.file = f.dst_file AND d.line = f.dst_line
  QUALIFY row_number() OVER (PARTITION BY f.repo_id, s.node_id, d.node_id ORDER BY kind_rank, src_ord, dst_ord) = 1)"""
ZONE = "CASE WHEN node_type IN ('external', 'api') THEN 'internet' WHEN node_type IN ('database', 'cache', 'queue') THEN 'secure' ELSE 'internal' END"
FLOW_THREAT = case("kind", {repr(k[0]): ",".join(k[4]) for k in code.FLOW_KINDS})
PROTOCOLS = "concat_ws(',', CASE WHEN contains(data_type, 'http') OR contains(data_type, 'api') THEN 'HTTP' END, CASE WHEN contains(data_type, 'sql') OR contains(data_type, 'database') THEN 'SQL' END, CASE WHEN contains(data_type, 'queue') OR contains(data_type, 'message') THEN 'AMQP' END)"
GRAPH = FLOWS + ",\n" + MERGE.strip() + "," + NODES + "," + EDGES + f""",
gn AS MATERIALIZED (SELECT *, {ZONE} AS zone, {ZONE} = 'internet' OR node_type IN ('external', 'user', 'api') AS is_entry,
   node_type = 'database' OR risk_level = 'critical' OR {any_like('lower(label)', code.JEWEL_WORDS)} OR EXISTS (SELECT 1 FROM ed WHERE ed.repo_id = nd.repo_id AND ed.sensitive AND (ed.source = nd.node_id OR ed.target = nd.node_id)) AS is_jewel,
   CASE WHEN n_findings = 0 THEN 0.1 ELSE least(1.0, (0.4 * n_critical + 0.3 * n_high + 0.2 * n_medium + 0.1 * n_low) / (1.0 + n_findings * 0.1)) END AS exploitability,
   least(3.0, 1.0 + CASE risk_level WHEN 'critical' THEN 1.5 WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0 END + CASE node_type WHEN 'database' THEN 1.0 WHEN 'api' THEN 0.3 ELSE 0 END + 0.3 * n_critical + 0.2 * n_high
     + CASE WHEN {any_like('lower(label)', code.VALUE_WORDS)} THEN 0.2 ELSE 0 END) AS jewel_value FROM nd),
gx AS MATERIALIZED (SELECT *, least(1.0, CASE zone WHEN 'internet' THEN 1.0 WHEN 'internal' THEN 0.3 ELSE 0.1 END + CASE WHEN is_entry THEN 0.2 ELSE 0 END + CASE WHEN node_type = 'external' THEN 0.2 ELSE 0 END) AS exposure FROM gn),
ge AS MATERIALIZED (SELECT ed.*, 0.3 + CASE WHEN encrypted THEN 0.3 ELSE 0 END + CASE WHEN s.zone <> t.zone THEN 0.2 ELSE 0 END - CASE WHEN sensitive THEN 0.1 ELSE 0 END AS difficulty, s.zone <> t.zone AS crossing, s.n_with_techniques > 0 AS known,
   CASE WHEN sensitive THEN 'low' ELSE 'none' END AS privilege, 'Lateral Movement' AS technique, 'T1021' AS mitre_id
   FROM ed JOIN gx s ON s.repo_id = ed.repo_id AND s.node_id = ed.source JOIN gx t ON t.repo_id = ed.repo_id AND t.node_id = ed.target)"""
WALK = GRAPH + """,
walk AS (SELECT repo_id, node_id AS entry, node_id AS node, [node_id] AS visited, 0 AS n, CAST(1.0 AS DOUBLE) AS diff, CAST(1.0 AS DOUBLE) AS succ, 0 AS cr, 0 AS kn, CAST(0 AS DOUBLE) AS cost FROM gx WHERE is_entry
  UNION ALL SELECT w.repo_id, w.entry, e.target, list_append(w.visited, e.target), w.n + 1, w.diff * e.difficulty, w.succ * greatest(0.1, 1 - e.difficulty), w.cr + CAST(e.crossing AS INT), w.kn + CAST(e.known AS INT), w.cost + e.difficulty
  FROM walk w JOIN ge e ON e.repo_id = w.repo_id AND e.source = w.node WHERE NOT list_contains(w.visited, e.target) AND w.n < {depth})"""
PATHS = WALK.replace("{depth}", "6") + """,
ap AS MATERIALIZED (SELECT w.repo_id, w.entry, w.node AS target, array_to_string(visited, '>') AS path_key, n, diff, cr, least(10.0, 4 * succ + t.jewel_value + s.exposure + least(1.0, 0.3 * cr) + least(1.0, 0.2 + 0.1 * kn)) AS risk
  FROM walk w JOIN gx t ON t.repo_id = w.repo_id AND t.node_id = w.node AND t.is_jewel JOIN gx s ON s.repo_id = w.repo_id AND s.node_id = w.entry WHERE n > 0)"""
VIEWS = "asset threat"
STATS = MAPPED + "," + NODES + "," + EDGES + GRAPH[GRAPH.index(",\ngn AS"):] + PATHS[len(GRAPH):] + """,
rk AS (SELECT repo_id, risk FROM mapped UNION ALL SELECT repo_id, risk / 10 FROM ap),
ids AS (SELECT repo_id FROM v_asset UNION SELECT repo_id FROM triaged),
stt AS MATERIALIZED (SELECT repo_id, (SELECT count(*) FROM v_asset x WHERE x.repo_id = ids.repo_id) AS total_assets, (SELECT count(*) FROM flow x WHERE x.repo_id = ids.repo_id) AS total_flows, (SELECT count(*) FROM triaged x WHERE x.repo_id = ids.repo_id) AS total_threats,
  (SELECT count(*) FROM triaged x WHERE x.repo_id = ids.repo_id AND severity = 'critical') AS critical_threats, (SELECT count(*) FROM triaged x WHERE x.repo_id = ids.repo_id AND severity = 'high') AS high_threats,
  (SELECT count(*) FROM ap x WHERE x.repo_id = ids.repo_id) AS total_paths, coalesce((SELECT max(risk) FROM rk x WHERE x.repo_id = ids.repo_id), 0) AS max_risk, coalesce((SELECT avg(risk) FROM rk x WHERE x.repo_id = ids.repo_id), 0) AS avg_risk FROM ids)"""
assert set(attack.PATH_TACTICS) >= {"T1021"}

SQL = {
    "diagram_nodes": ask(VIEWS, MERGE.strip() + "," + NODES + " SELECT repo_id, node_id, label, node_type, risk_level, description, n_assets, n_files, n_findings, n_critical, n_high, n_with_techniques, worst_title, worst_stride FROM nd"),
    "diagram_edges": ask("asset", FLOWS + "," + EDGES + f" SELECT repo_id, source, target, data_type, sensitive, encrypted, CASE WHEN sensitive THEN '\U0001f512 ' ELSE '' END || data_type || ' (2 threats)' AS label, {PROTOCOLS} AS protocols, {FLOW_THREAT} AS threats FROM ed"),
    "diagram_zones": ask(VIEWS, MERGE.strip() + "," + NODES + f" SELECT repo_id, node_id, {ZONE} AS zone, CASE {ZONE} WHEN 'internet' THEN 'Internet-Facing' WHEN 'secure' THEN 'Data Layer' ELSE 'Internal Services' END AS zone_name FROM nd"),
    "diagram_risk_breakdown": ask(VIEWS, MERGE.strip() + "," + NODES + " SELECT repo_id, risk_level, count(*) AS n_nodes FROM nd GROUP BY ALL"),
    "diagram_node_search": ask(VIEWS, MERGE.strip() + "," + NODES + " SELECT repo_id, node_id FROM nd WHERE contains(lower(label), 'database') OR contains(node_type, 'database') OR contains(lower(coalesce(worst_stride, '')), 'database')"),
    "flow_locations": ask("asset", FLOWS + " SELECT repo_id, file || ':' || line AS location, count(*) AS n_flows FROM (SELECT repo_id, src_file AS file, src_line AS line FROM flow UNION ALL SELECT repo_id, dst_file, dst_line FROM flow) GROUP BY ALL"),
    "graph_nodes": ask(VIEWS, GRAPH + " SELECT repo_id, node_id, zone, is_entry, is_jewel, CAST(round(exploitability, 6) AS DOUBLE) AS exploitability, CAST(round(jewel_value, 6) AS DOUBLE) AS jewel_value, CAST(round(exposure, 6) AS DOUBLE) AS exposure FROM gx"),
    "graph_edges": ask(VIEWS, GRAPH + " SELECT repo_id, source, target, CAST(round(difficulty, 6) AS DOUBLE) AS difficulty, privilege, technique, mitre_id FROM ge"),
    "attack_paths": ask(VIEWS, PATHS + """ SELECT repo_id, path_key, CAST(n AS BIGINT) AS n_steps, round(diff, 6) AS total_difficulty, CAST(cr AS BIGINT) AS n_crossings, 'Initial Access > Lateral Movement' || CASE WHEN n > 1 THEN ' > Exfiltration' ELSE '' END AS tactics,
        CAST(round(risk, 6) AS DOUBLE) AS composite_risk, CASE WHEN round(risk, 9) >= 8 THEN 'CRITICAL' WHEN round(risk, 9) >= 6 THEN 'HIGH' WHEN round(risk, 9) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM ap"""),
    "critical_paths": ask(VIEWS, PATHS + " SELECT repo_id, path_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(risk, 9) DESC, path_key) AS rank FROM ap) WHERE rank <= 5"),
    "easiest_paths": ask(VIEWS, WALK.replace("{depth}", "1000") + " SELECT w.repo_id, entry, node AS target, CAST(round(min(cost), 6) AS DOUBLE) AS total_cost FROM walk w JOIN gx t ON t.repo_id = w.repo_id AND t.node_id = w.node AND t.is_jewel WHERE n > 0 GROUP BY ALL"),
    "scan_stats": ask("asset threat dependency", STATS + " SELECT * EXCLUDE (max_risk, avg_risk), CAST(round(max_risk, 6) AS DOUBLE) AS max_risk, CAST(round(avg_risk, 6) AS DOUBLE) AS avg_risk FROM stt"),
    "scan_badges": ask("asset threat dependency", STATS + " SELECT repo_id, CASE WHEN critical_threats > 0 THEN total_threats || ' threats (' || critical_threats || ' critical)' WHEN total_threats > 0 THEN total_threats || ' threats' ELSE 'clean' END AS status, CASE WHEN critical_threats > 0 THEN 'critical' WHEN total_threats > 10 THEN 'orange' WHEN total_threats > 0 THEN 'yellow' ELSE 'brightgreen' END AS color FROM stt"),
}
