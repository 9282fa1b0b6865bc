from checks import RANK, ask
from checks.assets import any_like, q
from checks.classify import FIND, M_REPO, profile, stride_raw
from checks.rules import case
from threatloom.catalogs import attack, maestro, pci, stride


def tech_values(name, table):
    return f"{name}(code, pos, technique_id, weight, reason) AS (VALUES " + ", ".join(
        f"({q(c)}, {i}, '{t}', CAST({w} AS DOUBLE), {q(r)})" for c, rows in table.items() for i, (t, w, r) in enumerate(rows)) + ")"


ST, MT = tech_values("st", stride.TECHNIQUES), tech_values("mt", maestro.TECHNIQUES)
TECH = "tech(technique_id, name, tactic, platforms, mitigation) AS (VALUES " + ", ".join(
    f"('{t['technique_id']}', {q(t['name'])}, '{t['tactic']}', '{','.join(t['platforms'])}', {q(','.join(t['mitigation']))})" for t in attack.techniques()) + ")"
TACTIC = case("tactic", {repr(k): x for k, x in attack.TACTICS.items()})
BOTH = M_REPO + ",\n" + profile("r", "repo_id", stride_raw("description", "cw"), stride.CODES, "I").replace(
    "raw AS MAT", "raw2 AS MAT").replace("FROM raw)", "FROM raw2)").replace("scored AS", "scored2 AS").replace("FROM scored", "FROM scored2").replace(
    "unp AS", "unp2 AS").replace("FROM unp)", "FROM unp2)").replace("rnk AS", "rnk2 AS").replace("FROM rnk ", "FROM rnk2 ").replace("prof AS", "prof2 AS") + ",\n" + ST + ",\n" + MT


def mapping_rows(source, keys):
    """Candidate rows with their order: category, weakness, keyword, rule id."""
    parts = []
    for code, entries in pci.BY_STRIDE.items():
        for i, (sub, conf, reason) in enumerate(entries):
            parts.append(f"SELECT {keys}, {i} AS o, '{sub}' AS sub_id, {conf} AS conf, {q(reason)} AS reason FROM {source} WHERE stride_primary = '{code}'")
    for g, (ids, entries) in enumerate(pci.BY_CWE):
        for i, (sub, conf, reason) in enumerate(entries):
            parts.append(f"SELECT {keys}, 1000 + p * 100 + {g * 10 + i}, '{sub}', {conf}, 'CWE ' || c || ': ' || {q(reason)} FROM (SELECT *, unnest(cwe_list) AS c, generate_subscripts(cwe_list, 1) AS p FROM {source}) WHERE {any_like('lower(c)', ids)}")
    for g, (words, entries) in enumerate(pci.BY_KEYWORD):
        for i, (sub, conf, reason) in enumerate(entries):
            parts.append(f"SELECT {keys}, 5000 + {g * 10 + i}, '{sub}', {conf}, {q(reason)} FROM {source} WHERE {any_like('lower(title || chr(32) || description)', words)}")
    for g, (words, sub, conf, head) in enumerate(pci.BY_RULE_ID):
        parts.append(f"SELECT {keys}, 9000 + {g}, '{sub}', {conf}, {q(head)} || rule_id FROM {source} WHERE {any_like('lower(rule_id)', words)}")
    return " UNION ALL ".join(parts)


def merged(source, keys):
    """Fold the reasons in order with a recursive walk."""
    same = " AND ".join(f"n.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    return f"""cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys}, sub_id ORDER BY o) AS step FROM ({mapping_rows(source, keys)})),
walk AS (SELECT {keys}, sub_id, step, CAST(conf AS DOUBLE) AS confidence, reason FROM cand WHERE step = 1
  UNION ALL SELECT n.{keys.replace(', ', ', n.')}, n.sub_id, n.step, greatest(w.confidence, CAST(n.conf AS DOUBLE)), CASE WHEN contains(w.reason, n.reason) THEN w.reason ELSE w.reason || ' | ' || n.reason END
  FROM walk w JOIN cand n ON {same} AND n.sub_id = w.sub_id AND n.step = w.step + 1),
pm AS MATERIALIZED (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY {keys}, sub_id ORDER BY step DESC) = 1)"""


FT = FIND + """,
ft AS MATERIALIZED (SELECT repo_id, ord, 'threat-' || ord AS id, message AS title, message || ' (File: ' || path || ', Line: ' || start_line || ')' AS description, upper(severity) AS sev,
  CASE upper(severity) WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' WHEN 'INFO' THEN 'low' ELSE 'info' END AS severity, primary_code AS stride_primary, ['CWE-' || c for c in cids] AS cwe_list, check_id AS rule_id FROM fm),
"""
PM = FT + merged("ft", "repo_id, ord")
SUBS = "sub(req_id, sub_id, description) AS (VALUES " + ", ".join(f"('{s['req_id']}', '{s['sub_id']}', {q(s['description'])})" for s in pci.sub_requirements() if s["relevant"]) + ")"
RES = PM + ",\n" + SUBS + f""",
repo AS (SELECT repo_id FROM v_finding UNION SELECT 'repo-' || s_suppkey FROM supplier),
cnt AS (SELECT pm.repo_id, pm.sub_id, count(*) AS n, max({RANK.format('ft.severity')}) AS rank FROM pm JOIN ft ON ft.repo_id = pm.repo_id AND ft.ord = pm.ord GROUP BY ALL),
res AS MATERIALIZED (SELECT r.repo_id, s.req_id, s.sub_id, s.description, coalesce(n, 0) AS n_findings, CASE WHEN rank = 10 THEN 'critical' WHEN rank = 7 THEN 'high' WHEN rank = 5 THEN 'medium' WHEN rank = 3 THEN 'low' ELSE 'info' END AS highest_severity,
  CASE WHEN n IS NULL THEN 'Not Tested' WHEN rank >= 7 THEN 'Fail' WHEN rank = 5 THEN 'Partial' WHEN n > 5 THEN 'Partial' ELSE 'Pass' END AS status
  FROM repo r CROSS JOIN sub s LEFT JOIN cnt c ON c.repo_id = r.repo_id AND c.sub_id = s.sub_id)"""
REQ = RES + ", reqs(req_id, title) AS (VALUES " + ", ".join(f"('{r[0]}', {q(r[1])})" for r in pci.REQUIREMENTS) + """),
rq AS MATERIALIZED (SELECT r.repo_id, q.req_id, CAST(coalesce(sum(n_findings), 0) AS BIGINT) AS n_findings, CASE WHEN bool_or(status = 'Fail') THEN 'Fail' WHEN bool_or(status = 'Partial') THEN 'Partial' WHEN bool_or(status = 'Pass') THEN 'Pass' ELSE 'Not Tested' END AS status
  FROM repo r CROSS JOIN reqs q LEFT JOIN res ON res.repo_id = r.repo_id AND res.req_id = q.req_id GROUP BY ALL)"""
PRIO = "greatest(1, CASE highest_severity WHEN 'critical' THEN 10 WHEN 'high' THEN 30 WHEN 'medium' THEN 50 WHEN 'low' THEN 70 ELSE 90 END - CASE WHEN n_findings > 10 THEN 10 WHEN n_findings > 5 THEN 5 ELSE 0 END)"
ACTION = f"coalesce({case('sub_id', {repr(k): x for k, x in pci.ACTIONS.items()})}, 'Review and remediate findings for ' || sub_id || ': ' || description)"
ALL_SUBS = case("sub_id", {repr(s["sub_id"]): s["description"] for s in pci.sub_requirements()})
REQ_NAME = case("req_id", {repr(r[0]): r[1] for r in pci.REQUIREMENTS})

SQL = {
    "category_techniques": ask("threat", ST + " SELECT repo_id, ord, technique_id, round(conf_primary * weight, 9) AS technique_confidence, reason FROM v_threat JOIN st ON st.code = stride_primary"),
    "layer_techniques": ask("repository", M_REPO + ",\n" + MT + " SELECT repo_id, technique_id, round(s * weight, 9) AS technique_confidence, reason FROM rnk JOIN mt USING (code) WHERE r = 1"),
    "threat_technique_ids": ask("threat", ST + " SELECT repo_id, ord, coalesce((SELECT string_agg(technique_id, ',' ORDER BY pos) FROM st WHERE st.code = stride_primary), '') AS mitre_ids FROM v_threat"),
    "best_techniques": ask("repository", BOTH + """, al AS (SELECT repo_id, technique_id, s * CASE WHEN r = 1 THEN 1.0 ELSE 0.7 END * weight AS c, r * 10 + pos AS o, reason FROM rnk2 JOIN st USING (code) WHERE r = 1 OR s >= 0.3
        UNION ALL SELECT repo_id, technique_id, s * CASE WHEN r = 1 THEN 1.0 ELSE 0.7 END * weight, 1000 + r * 10 + pos, reason FROM rnk JOIN mt USING (code) WHERE r = 1 OR s >= 0.3)
        SELECT repo_id, technique_id, round(c, 9) AS technique_confidence, reason FROM al QUALIFY row_number() OVER (PARTITION BY repo_id, technique_id ORDER BY round(c, 12) DESC, o) = 1"""),
    "technique_details": ask("threat", ST + ",\n" + TECH + f" SELECT repo_id, ord, technique_id, name, tactic, {TACTIC} AS tactic_name, platforms, mitigation FROM v_threat JOIN st ON st.code = stride_primary JOIN tech USING (technique_id)"),
    "techniques_of_credential_access": ask("threat", ST + ",\n" + TECH + " SELECT repo_id, ord, technique_id FROM v_threat JOIN st ON st.code = stride_primary JOIN tech USING (technique_id) WHERE tactic = 'TA0006'"),
    "requirement_mappings": ask("finding", PM + " SELECT pm.repo_id, ft.id, split_part(sub_id, '.', 1) AS req_id, sub_id, round(confidence, 6) AS confidence, reason FROM pm JOIN ft ON ft.repo_id = pm.repo_id AND ft.ord = pm.ord"),
    "requirement_mappings_of_threats": ask("threat", "tt AS MATERIALIZED (SELECT *, CAST([] AS VARCHAR[]) AS cwe_list, '' AS rule_id FROM v_threat),\n" + merged("tt", "repo_id, ord") + " SELECT repo_id, ord, sub_id, round(confidence, 6) AS confidence, reason FROM pm"),
    "requirement_details": ask("finding", PM + f", d AS (SELECT *, split_part(sub_id, '.', 1) AS req_id FROM pm) SELECT req_id, {REQ_NAME} AS requirement, sub_id, {ALL_SUBS} AS sub_description, count(*) AS n FROM d GROUP BY ALL"),
    "sub_requirement_results": ask("finding", RES + " SELECT repo_id, req_id, sub_id, n_findings, highest_severity, status FROM res"),
    "requirement_results": ask("finding", REQ + " SELECT repo_id, req_id, n_findings, status FROM rq"),
    "compliance_breakdown": ask("finding", REQ + " SELECT repo_id, status, count(*) AS n_requirements, round(count(*) / 12.0 * 100, 6) AS percent FROM rq GROUP BY ALL"),
    "compliance_gaps": ask("finding", RES + " SELECT repo_id, req_id, sub_id FROM res WHERE n_findings = 0"),
    "compliance_recommendations": ask("finding", RES + f", p AS (SELECT *, {PRIO} AS priority, {ACTION} AS action FROM res WHERE n_findings > 0) SELECT repo_id, sub_id, CAST(priority AS BIGINT) AS priority, n_findings, highest_severity, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority, sub_id) AS rank FROM p) WHERE rank <= 20"),
    "top_requirements": ask("finding", PM + """, k AS (SELECT pm.repo_id, split_part(sub_id, '.', 1) || '.' || sub_id AS key, count(*) AS n FROM pm JOIN ft ON ft.repo_id = pm.repo_id AND ft.ord = pm.ord WHERE sev IN ('ERROR', 'WARNING') GROUP BY ALL)
        SELECT repo_id, key, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, key) AS rank FROM k) WHERE rank <= 5"""),
}
