from checks import ask
from checks.assets import FLOWS, q
from checks.rules import case
from checks.triage import MERGE
from threatloom.catalogs import code, stride

BRIDGE = "bridge(category, type) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, ts in stride.ASSET_TYPES.items() for t in ts) + ")"
STRATEGY = "strat(category, pos, description) AS (VALUES " + ", ".join(
    f"('{c}', {i}, {q(x)})" for c, xs in stride.MITIGATION.items() for i, x in enumerate(xs[:2])) + ")"

AFFECTED = """
aff AS MATERIALIZED (SELECT t.repo_id, t.id AS threat_id, t.ord, t.severity, t.cve_ids AS cve_id, d.name, d.version, d.name || ' ' || d.version || ' (vulnerable to ' || t.cve_ids || ')' AS asset_name
  FROM (SELECT DISTINCT g.repo_id, g.id, g.ord, g.severity, g.cve_ids, g.dedup_key, i.value FROM triaged g JOIN (SELECT repo_id, dedup_key, unnest(string_split(indicator_values, ',')) AS value FROM keyed WHERE indicator_values <> '') i
     ON i.repo_id = g.repo_id AND i.dedup_key = g.dedup_key WHERE g.cve_ids <> '') t
  JOIN v_dependency d ON d.repo_id = t.repo_id AND d.scan_id = 'head' AND contains(lower(d.name), lower(t.value)))"""
# Every (threat, asset) pair, listed and counted.
MAPPED = FLOWS + ",\n" + BRIDGE + ",\n" + MERGE.strip() + "," + AFFECTED + """,
touch AS MATERIALIZED (SELECT t.repo_id, t.id, count(*) AS n, count(*) FILTER (WHERE exposed) AS e FROM triaged t JOIN bridge b ON b.category = t.stride_primary JOIN v_asset a2 ON a2.repo_id = t.repo_id AND a2.type = b.type GROUP BY ALL),
sens AS (SELECT repo_id, count(*) AS f FROM flow WHERE sensitive GROUP BY ALL),
dep AS (SELECT repo_id, threat_id AS id, count(*) AS p FROM aff GROUP BY ALL),
mapped AS MATERIALIZED (SELECT t.*, coalesce(n, 0) + coalesce(p, 0) AS n_assets, coalesce(e, 0) AS n_exposed, CASE WHEN stride_primary IN ('T', 'I') THEN coalesce(f, 0) ELSE 0 END AS n_flows, coalesce(p, 0) AS n_patchable,
    least(1.0, priority * (1 + 0.1 * n_assets) * (1 + 0.2 * n_exposed) * (1 + 0.15 * n_flows)) AS risk
  FROM triaged t LEFT JOIN touch c ON c.repo_id = t.repo_id AND c.id = t.id LEFT JOIN sens s ON s.repo_id = t.repo_id LEFT JOIN dep ON dep.repo_id = t.repo_id AND dep.id = t.id
  WHERE coalesce(n, 0) + coalesce(p, 0) > 0 OR (stride_primary IN ('T', 'I') AND coalesce(f, 0) > 0))"""
PRIORITY = "CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity ELSE 'low' END"
FIX = f"""CASE WHEN language = 'go' AND stride_primary = 'S' THEN {q(code.FIX_SPOOFING_GO)} WHEN language = 'go' AND stride_primary = 'T' AND type = 'database' THEN {q(code.FIX_TAMPERING_GO_DATABASE)}
  WHEN language = 'go' AND stride_primary = 'I' THEN {q(code.FIX_DISCLOSURE_GO)} ELSE {q(code.FIX_DEFAULT)} END"""
MITIGATIONS = MAPPED + ",\n" + STRATEGY + f""",
touched AS (SELECT t.repo_id, t.id, t.ord, t.severity, t.stride_primary, a2.type FROM mapped t JOIN bridge b ON b.category = t.stride_primary JOIN v_asset a2 ON a2.repo_id = t.repo_id AND a2.type = b.type
   UNION ALL SELECT t.repo_id, t.id, t.ord, t.severity, t.stride_primary, 'dependency' FROM mapped t JOIN aff ON aff.repo_id = t.repo_id AND aff.threat_id = t.id WHERE t.stride_primary IS NOT NULL),
mit AS MATERIALIZED (SELECT x.repo_id, x.id AS threat_id, x.ord, s.pos AS strategy, 'code_change' AS kind, s.description, x.type AS asset_type, {PRIORITY} AS priority, 'medium' AS effort, {FIX} AS code
   FROM touched x JOIN strat s ON s.category = x.stride_primary LEFT JOIN v_repository r ON r.repo_id = x.repo_id
   UNION ALL SELECT f.repo_id, f.threat_id, f.ord, -1, 'patch', 'Update ' || asset_name || ' to patched version', 'dependency', f.severity, 'low',
     CASE language WHEN 'go' THEN 'go get -u ' || asset_name || '@latest' WHEN 'python' THEN 'pip install --upgrade ' || asset_name WHEN 'javascript' THEN 'npm update ' || asset_name WHEN 'typescript' THEN 'npm update ' || asset_name ELSE 'Update ' || asset_name || ' to latest version' END
   FROM aff f JOIN mapped t ON t.repo_id = f.repo_id AND t.id = f.threat_id LEFT JOIN v_repository r ON r.repo_id = f.repo_id)"""
NAME = f"coalesce({case('stride_primary', {repr(k): v for k, v in stride.FULL_NAMES.items()})}, 'Unknown')"
ALL = "asset threat dependency repository"

SQL = {
    "affected_dependencies": ask("threat dependency", MERGE.strip() + "," + AFFECTED + " SELECT repo_id, threat_id, cve_id, name, version, asset_name FROM aff"),
    "mapped_threats": ask("asset threat dependency", MAPPED + " SELECT repo_id, id, title, CAST(n_assets AS BIGINT) AS n_assets, CAST(n_exposed AS BIGINT) AS n_exposed, CAST(n_flows AS BIGINT) AS n_flows, CAST(n_patchable AS BIGINT) AS n_patchable, CAST(round(risk, 6) AS DOUBLE) AS risk FROM mapped"),
    "mitigations": ask(ALL, MITIGATIONS + " SELECT repo_id, threat_id, kind, description, asset_type, count(*) AS n, priority, effort, code FROM mit WHERE kind = 'code_change' GROUP BY ALL UNION ALL SELECT repo_id, threat_id, kind, description, asset_type, 1, priority, effort, code FROM mit WHERE kind = 'patch'"),
    "mitigation_rollup": ask(ALL, MITIGATIONS + " SELECT repo_id, description, min_by(priority, (ord, strategy, priority, kind)) AS priority, min_by(kind, (ord, strategy, priority, kind)) AS kind, count(*) AS applies_to FROM mit GROUP BY repo_id, description"),
    "mitigations_by_kind": ask(ALL, MITIGATIONS + " SELECT repo_id, kind, count(*) AS n FROM mit GROUP BY ALL"),
    "threat_top_locations": ask("asset threat dependency", MAPPED + """, loc AS (SELECT t.repo_id, t.id AS threat_id, a2.file, a2.line, min(a2.ord) AS o FROM mapped t JOIN bridge b ON b.category = t.stride_primary
        JOIN v_asset a2 ON a2.repo_id = t.repo_id AND a2.type = b.type GROUP BY ALL)
        SELECT repo_id, threat_id, file, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, threat_id ORDER BY o, file, line) AS rank FROM loc) WHERE rank <= 10"""),
    "severity_breakdown": ask("threat", MERGE.strip() + """, sev(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info'))
        SELECT r.repo_id, sev.severity, count(t.id) AS n FROM (SELECT DISTINCT repo_id FROM triaged) r CROSS JOIN sev LEFT JOIN triaged t ON t.repo_id = r.repo_id AND t.severity = sev.severity GROUP BY ALL"""),
    "category_distribution": ask("threat", MERGE.strip() + f""" SELECT repo_id, stride_primary AS category, {NAME} AS category_name, {case('stride_primary', {repr(k): v for k, v in stride.QUESTIONS.items()})} AS question,
        count(*) AS n_threats, CAST(sum(CASE WHEN instance_count = 0 THEN 1 ELSE instance_count END) AS BIGINT) AS n_instances FROM triaged WHERE stride_primary IS NOT NULL GROUP BY ALL"""),
    "main_category": ask("threat", MERGE.strip() + f""", c AS (SELECT repo_id, stride_primary, count(*) AS n FROM triaged WHERE stride_primary IS NOT NULL GROUP BY ALL)
        SELECT repo_id, {NAME} AS category_name, n AS n_threats FROM c QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, strpos('STRIDELM', stride_primary)) = 1"""),
    "asset_counts": ask("asset", "SELECT repo_id, type, count(*) AS n_assets, count(*) FILTER (WHERE exposed) AS n_exposed, count(*) FILTER (WHERE sensitive) AS n_sensitive FROM v_asset GROUP BY ALL"),
    "repository_overview": ask(ALL, MAPPED + """, fa AS (SELECT repo_id, count(*) AS n FROM v_asset GROUP BY ALL), ff AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE sensitive) AS s FROM flow GROUP BY ALL),
        fm AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m,
          count(*) FILTER (WHERE severity = 'low') AS l, count(*) FILTER (WHERE severity = 'info') AS i, avg(risk) AS r FROM mapped GROUP BY ALL)
        SELECT v.repo_id, regexp_replace(string_split(url, '/')[-1], '\\.git$', '') AS name, right(url, 20) AS short_id, coalesce(fa.n, 0) AS total_assets, coalesce(ff.n, 0) AS total_flows, coalesce(ff.s, 0) AS sensitive_flows,
          coalesce(fm.n, 0) AS total_threats, coalesce(c, 0) AS n_critical, coalesce(h, 0) AS n_high, coalesce(m, 0) AS n_medium, coalesce(l, 0) AS n_low, coalesce(i, 0) AS n_info, CAST(coalesce(round(r, 6), 0) AS DOUBLE) AS average_risk
        FROM v_repository v LEFT JOIN fa USING (repo_id) LEFT JOIN ff USING (repo_id) LEFT JOIN fm USING (repo_id)"""),
    "top_threat_per_category": ask("asset threat dependency", MAPPED + " SELECT repo_id, stride_primary, id, CAST(round(risk, 6) AS DOUBLE) AS risk FROM mapped WHERE stride_primary IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_id, stride_primary ORDER BY risk DESC, ord) = 1"),
    "top_threats_by_severity": ask("threat", MERGE.strip() + " SELECT repo_id, id, severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END, ord) AS rank FROM triaged) WHERE rank <= 20"),
    "top_threats_by_priority": ask("threat", MERGE.strip() + " SELECT repo_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority DESC, ord) AS rank FROM triaged) WHERE rank <= 5"),
    "threats_high_priority": ask("threat", MERGE.strip() + " SELECT repo_id, id FROM triaged WHERE priority >= 0.5 AND priority < 0.7"),
    "threats_critical_priority": ask("threat", MERGE.strip() + " SELECT repo_id, id FROM triaged WHERE priority >= 0.7"),
    "exposed_assets_listed": ask("asset", """SELECT repo_id, rank, CASE WHEN length(name) > 12 THEN left(name, 9) || '...' ELSE name END AS name, '`' || file || ':' || line || '`' AS location
        FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord, id) AS rank FROM v_asset WHERE exposed) WHERE rank <= 20"""),
    "dependencies_listed": ask("dependency", "SELECT repo_id, name, version, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS rank FROM v_dependency WHERE scan_id = 'head') WHERE rank <= 30"),
    "recommended_actions": ask("threat", MERGE.strip() + """, top AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority DESC, ord) AS tr FROM triaged),
        act AS (SELECT repo_id, action, min(tr * 100 + p) AS o FROM (SELECT repo_id, tr, unnest(string_split(recommended, ';')) AS action, generate_subscripts(string_split(recommended, ';'), 1) AS p FROM top WHERE tr <= 20 AND recommended <> '') GROUP BY ALL)
        SELECT repo_id, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY o) AS rank FROM act) WHERE rank <= 10"""),
    "priority_actions": ask(ALL, MITIGATIONS + """, pa AS (SELECT repo_id, description, bool_or(priority IN ('critical', 'high')) AS urgent, min((ord, threat_id, strategy)) FILTER (WHERE priority IN ('critical', 'high')) AS u, min((ord, threat_id, strategy)) AS f FROM mit GROUP BY ALL)
        SELECT repo_id, description, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY urgent DESC, CASE WHEN urgent THEN u ELSE f END, description) AS rank FROM pa) WHERE rank <= 5"""),
}

