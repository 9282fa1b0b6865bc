import re

from checks import AS_OF, RANK, ask
from checks.assets import any_like, q
from checks.rules import case
from threatloom.catalogs import maestro, stride
from threatloom.operators.findings import AI_GATE, AI_LAYERS


def keyword(column, words):
    hits = " + ".join(f"CAST(contains(lower({column}), {q(w)}) AND regexp_matches({column}, {q('(?i)' + chr(92) + 'b' + re.escape(w) + chr(92) + 'b')}) AS INT)" for w in words)
    return f"least(1.0, ({hits}) / 3.0)"


def cwe(column, ids):
    return f"CASE WHEN list_has_any({column}, {ids}) THEN 1.0 ELSE 0 END" if column else "0"


def profile(source, keys, raw, codes, default, separator=""):
    """raw: SQL per code.  Scale, rank and print, through an unpivoted table."""
    names = ["x" + str(i) for i in range(len(codes))]
    rows = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS o, {q(c)} AS code, CASE WHEN top > 0 THEN {n} / top ELSE {0.5 if c == default else 0.0} END AS s FROM scored"
        for i, (c, n) in enumerate(zip(codes, names)))
    pivot = ", ".join(f"CAST(round(max(s) FILTER (WHERE o = {i}), 9) AS DOUBLE) AS score_{c[0].lower()}" for i, c in enumerate(codes))
    return f"""raw AS MATERIALIZED (SELECT {keys}, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for e, n in zip(raw, names))} FROM {source}),
scored AS (SELECT *, greatest({', '.join(names)}) AS top FROM raw),
unp AS ({rows}),
rnk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, o) AS r FROM unp),
prof AS MATERIALIZED (SELECT {keys}, max(code) FILTER (WHERE r = 1) AS primary_code, coalesce(string_agg(code, '{separator}' ORDER BY r) FILTER (WHERE r > 1 AND s >= 0.3), '') AS sec, {pivot} FROM rnk GROUP BY {keys})"""


def show(keys):
    return f" SELECT * EXCLUDE (sec), primary_code || CASE WHEN sec <> '' THEN '(' || sec || ')' ELSE '' END AS profile FROM prof"


def stride_raw(text, cwes="", tactics="", context=None):
    context = context or {}
    out = []
    for code in stride.CODES:
        ids = [t for t, c in stride.TACTICS.items() if c == code]
        tactic = f"CASE WHEN list_has_any({tactics}, {ids}) THEN 0.8 ELSE 0 END" if tactics and ids else "0"
        out.append(f"0.4 * {keyword(text, stride.KEYWORDS[code])} + 0.3 * {cwe(cwes, stride.CWE_IDS[code])} + 0.2 * {tactic} + 0.1 * ({context.get(code, '0')})")
    return out


def maestro_raw(text, tech, flags, deployment="", cwes="", context=None):
    out = []
    for code in maestro.CODES:
        step, words = maestro.TECHNOLOGY_WORDS.get(code, (0, []))
        technology = f"least(1.0, {step} * len([t for t in {tech} if {any_like('lower(t)', words)}]))" if words else "0"
        arch = ["0"]
        for name, weights in maestro.ARCHITECTURE_FLAGS.items():
            if code in weights and name in flags:
                arch.append(f"CASE WHEN {flags[name]} THEN {weights[code]} ELSE 0 END")
        for model, weights in maestro.DEPLOYMENT_MODELS.items():
            if code in weights and deployment:
                arch.append(f"CASE WHEN {deployment} = '{model}' THEN {weights[code]} ELSE 0 END")
        marks = " + ".join(f"CASE WHEN {(context or {}).get(name, 'false')} THEN {w} ELSE 0 END" for name, (layer, w) in maestro.CONTEXT_FLAGS.items() if layer == code) or "0"
        out.append(f"0.3 * {keyword(text, maestro.KEYWORDS[code])} + 0.25 * {technology} + 0.25 * least(1.0, {' + '.join(arch)}) + 0.15 * {cwe(cwes, maestro.CWE_IDS[code])} + 0.05 * ({marks})")
    return out


def named(text, source):
    """Threats named in the text by layer rank, else the first three of the primary layer."""
    values = ", ".join(f"('{layer}', {i}, {q(t)})" for layer, ts in maestro.THREATS.items() for i, t in enumerate(ts))
    return f"""lt(layer, pos, threat) AS (VALUES {values}),
pr AS (SELECT repo_id, code, r FROM rnk WHERE r = 1 OR s >= 0.3),
hit AS (SELECT pr.repo_id, lt.threat, min(r * 100 + pos) AS o FROM pr JOIN lt ON lt.layer = pr.code JOIN {source} v ON v.repo_id = pr.repo_id WHERE contains(lower(v.{text}), lower(lt.threat)) GROUP BY ALL),
nt AS (SELECT v.repo_id, coalesce((SELECT string_agg(threat, '; ' ORDER BY o) FROM hit h WHERE h.repo_id = v.repo_id),
  (SELECT string_agg(threat, '; ' ORDER BY pos) FROM pr p JOIN lt ON lt.layer = p.code WHERE p.repo_id = v.repo_id AND p.r = 1 AND pos < 3)) AS maestro_threats FROM {source} v)"""


CWES = "[CAST(regexp_extract(c, '^(?:CWE-)?\\s*([+-]?\\d+)', 1) AS INT) for c in string_split(cwe, ',') if regexp_matches(c, '^(?:CWE-)?\\s*[+-]?\\d+')]"
REPO = "r AS MATERIALIZED (SELECT *, contains(description, 'agent') AS agents, [x for x in string_split(technologies, ',') if x <> ''] AS tech, [CAST(x AS INT) for x in string_split(cwe_ids, ',') if x <> ''] AS cw FROM v_repository)"
M_REPO = REPO + ",\n" + profile("r", "repo_id", maestro_raw(
    "description", "tech", {"has_agents": "agents", "has_rag": "has_rag", "has_tool_calling": "has_tool_calling", "has_multi_agent": "has_multi_agent"},
    "deployment_model", "cw", {"uses_llm": "has_rag", "has_external_integrations": "has_tool_calling", "has_data_pipeline": "has_multi_agent", "compliance_required": "has_rag"}),
    maestro.CODES, "1-Foundation", ",")
SCAN = "r AS MATERIALIZED (SELECT repo_id, language || ' ' || framework || ' application' AS description, [language, framework] AS tech, contains(lower(framework), 'agent') AS agents FROM v_repository)"
M_SCAN = SCAN + ",\n" + profile("r", "repo_id", maestro_raw("description", "tech", {"has_agents": "agents"}), maestro.CODES, "1-Foundation", ",")
LAYER = "CASE WHEN NOT " + any_like("comb", AI_GATE) + " THEN '' " + " ".join(f"WHEN {any_like('comb', w)} THEN '{c}'" for c, w in AI_LAYERS) + " ELSE '1-Foundation' END"
FIND = f"""f0 AS MATERIALIZED (SELECT *, message || CASE WHEN category <> '' THEN ' ' || category ELSE '' END || CASE WHEN vulnerability_class <> '' THEN ' ' || replace(vulnerability_class, ',', ' ') ELSE '' END AS txt, {CWES} AS cids FROM v_finding),
f1 AS MATERIALIZED (SELECT *, lower(txt) || ' ' || lower(check_id) AS comb FROM f0),
""" + profile("f1", "repo_id, ord", stride_raw("txt", "cids"), stride.CODES, "I") + f""",
fm AS MATERIALIZED (SELECT f1.*, p.primary_code, {LAYER} AS layer,
  CAST(least(1.0, 0.5 + CASE upper(severity) WHEN 'ERROR' THEN 0.3 WHEN 'WARNING' THEN 0.2 WHEN 'INFO' THEN 0.1 ELSE 0 END + CASE upper(confidence) WHEN 'HIGH' THEN 0.2 WHEN 'MEDIUM' THEN 0.1 WHEN 'LOW' THEN 0.05 ELSE 0 END + CASE WHEN cwe <> '' THEN 0.1 ELSE 0 END) AS DOUBLE) AS mapping_confidence
  FROM f1 JOIN prof p ON p.repo_id = f1.repo_id AND p.ord = f1.ord)"""
FULL = case("primary_code", {repr(k): x for k, x in stride.FULL_NAMES.items()})
LAYER_NAME = case("layer", {repr(k): x for k, x in maestro.FULL_NAMES.items()})
AV, AC, PR, UI = (f"regexp_extract(vector, '(?:.*/|^){m}:([^/]*)', 1)" for m in ("AV", "AC", "PR", "UI"))
CVE = f"""c0 AS MATERIALIZED (SELECT *, cve_id || ' ' || description_en AS txt, CASE base_severity WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low' WHEN 'NONE' THEN 'info' ELSE 'medium' END AS severity,
  [CAST(regexp_extract(w, 'CWE-(\\d+)', 1) AS INT) for w in string_split(weaknesses, ';') if regexp_matches(w, 'CWE-\\d+')] AS cids,
  CASE {AV} WHEN 'N' THEN 'internet' WHEN 'A' THEN 'internal' WHEN 'L' THEN 'isolated' WHEN 'P' THEN 'isolated' ELSE '' END AS exposure_level, {AV} = 'N' AS affects_known_assets,
  CASE {AC} WHEN 'L' THEN 'low' WHEN '' THEN '' ELSE 'high' END AS attack_complexity, CASE {PR} WHEN 'N' THEN 'none' WHEN 'L' THEN 'low' WHEN 'H' THEN 'high' ELSE '' END AS privileges_required, {UI} = 'R' AS user_interaction_required,
  coalesce(try_cast(published AS TIMESTAMP), {AS_OF}) AS pub FROM v_cve),
""" + profile("c0", "cve_id", stride_raw("txt", "cids"), stride.CODES, "I")
STRATEGIES = case("primary_code", {repr(k): ";".join(x[:2]) for k, x in stride.MITIGATION.items()})
MEAN = "(" + " + ".join("score_" + c.lower() for c in stride.CODES) + ") / 8"

SQL = {
    "stride_of_documents": "WITH " + profile("documents", "doc_id", stride_raw("text"), stride.CODES, "I") + show("doc_id"),
    "stride_of_threats": ask("threat", "t AS MATERIALIZED (SELECT *, title || ' ' || description AS txt, CASE instance_count WHEN 1 THEN ['TA0006', 'T1059'] WHEN 2 THEN ['TA0008', 'TA0040'] ELSE ['TA9999'] END AS ta FROM v_threat),\n"
        + profile("t", "repo_id, ord", stride_raw("txt", "", "ta", {
            "S": "CASE WHEN NOT affects_known_assets THEN 0.5 ELSE 0 END", "L": "CASE WHEN exposure_level = 'internet' THEN 0.3 ELSE 0 END",
            "I": "CASE WHEN severity = 'high' THEN 0.7 ELSE 0 END", "D": "CASE WHEN severity = 'low' THEN 0.6 ELSE 0 END", "E": "CASE WHEN false_positive THEN 0.8 ELSE 0 END"}), stride.CODES, "I") + show("repo_id, ord")),
    "stride_of_cves": ask("cve", CVE + show("cve_id")),
    "maestro_of_repositories": ask("repository", M_REPO + show("repo_id")),
    "maestro_named_threats": ask("repository", M_REPO + ",\n" + named("description", "r") + " SELECT repo_id, maestro_threats FROM nt"),
    "maestro_of_scans": ask("repository", M_SCAN + ",\n" + named("description", "r") + " SELECT p.repo_id, p.primary_code AS maestro_primary, p.sec AS maestro_secondary, nt.maestro_threats FROM prof p JOIN nt ON nt.repo_id = p.repo_id"),
    "findings_from_warning": ask("finding", "SELECT repo_id, ord FROM v_finding WHERE upper(severity) IN ('ERROR', 'WARNING')"),
    "findings_from_medium_confidence": ask("finding", "SELECT repo_id, ord FROM v_finding WHERE upper(confidence) IN ('HIGH', 'MEDIUM')"),
    "finding_mappings": ask("finding", FIND + f""" SELECT repo_id, ord, primary_code AS stride_primary, layer, round(mapping_confidence, 6) AS mapping_confidence, array_to_string(cids, ',') AS cwe_ids,
        message || CASE WHEN category <> '' THEN ' | Category: ' || category ELSE '' END || CASE WHEN cwe <> '' THEN ' | CWE: ' || replace(cwe, ',', ', ') ELSE '' END || ' | STRIDE-LM: ' || {FULL} || CASE WHEN layer <> '' THEN ' | MAESTRO: ' || {LAYER_NAME} ELSE '' END AS reason FROM fm"""),
    "finding_mappings_confident": ask("finding", FIND + " SELECT repo_id, ord FROM fm WHERE mapping_confidence >= 0.85"),
    "finding_groups": ask("finding", FIND + " SELECT repo_id, 'STRIDE-LM' AS framework, primary_code AS code, count(*) AS n_findings FROM fm GROUP BY ALL UNION ALL SELECT repo_id, 'MAESTRO', layer, count(*) FROM fm WHERE layer <> '' GROUP BY ALL"),
    "finding_summary": ask("finding", """SELECT f.repo_id, count(*) AS n_findings, count(*) FILTER (WHERE upper(severity) = 'ERROR') AS n_error, count(*) FILTER (WHERE upper(severity) = 'WARNING') AS n_warning, count(*) FILTER (WHERE upper(severity) = 'INFO') AS n_info,
        count(*) FILTER (WHERE upper(confidence) = 'HIGH') AS n_high, count(*) FILTER (WHERE upper(confidence) = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE upper(confidence) = 'LOW') AS n_low, count(DISTINCT check_id) AS n_rules, coalesce(any_value(c.n), 0) AS n_cwes
        FROM v_finding f LEFT JOIN (SELECT repo_id, count(DISTINCT c) AS n FROM (SELECT repo_id, unnest(string_split(cwe, ',')) AS c FROM v_finding WHERE cwe <> '') GROUP BY repo_id) c ON c.repo_id = f.repo_id GROUP BY f.repo_id"""),
    "finding_threats": ask("finding", "f0 AS (SELECT *, " + CWES + " AS cids FROM v_finding) SELECT repo_id, 'threat-' || ord AS id, message AS title, message || ' (File: ' || path || ', Line: ' || start_line || ')' AS description, CASE upper(severity) WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' WHEN 'INFO' THEN 'low' ELSE 'info' END AS severity, array_to_string(['CWE-' || c for c in cids], ',') AS cwes FROM f0"),
    "scanner_error_types": ask("finding", """SELECT repo_id, ord, CASE WHEN error_type IS NULL THEN '' WHEN starts_with(error_type, chr(34)) THEN error_type[2:-2] WHEN starts_with(error_type, '[' || chr(34)) THEN split_part(error_type, chr(34), 2) ELSE error_type END AS type FROM v_finding"""),
    "cve_threats": ask("cve", CVE + f""" SELECT c0.cve_id, c0.cve_id || ': ' || CASE WHEN length(description_en) > 100 THEN left(description_en, 100) || '...' ELSE description_en END AS title, severity, exposure_level, affects_known_assets, attack_complexity,
        privileges_required, user_interaction_required, array_to_string(cids, ',') AS cwe_ids,
        CASE WHEN severity IN ('critical', 'high') THEN 'URGENT: Prioritize patching immediately. This is a critical vulnerability.;Check for indicators of compromise in logs from the last 90 days.;' ELSE '' END || {STRATEGIES} || ';Review NVD advisory for ' || c0.cve_id || ' for full details.;Validate patches in staging before production deployment.' AS recommended,
        strftime(pub, '%Y-%m-%d') AS published, reference AS "references",
        CAST(round(least(1.0, 0.3 * {RANK.format('severity')} / 10.0 + 0.4 * (0.1 + CASE WHEN affects_known_assets THEN 0.25 ELSE 0 END + CASE exposure_level WHEN 'internet' THEN 0.2 WHEN 'isolated' THEN 0.05 ELSE 0.1 END + CASE attack_complexity WHEN 'low' THEN 0.15 WHEN 'high' THEN 0.03 ELSE 0.05 END) + 0.2 * m.mean + 0.1), 6) AS DOUBLE) AS priority
        FROM c0 JOIN prof p ON p.cve_id = c0.cve_id JOIN (SELECT cve_id, sum(s) / 8 AS mean FROM rnk GROUP BY cve_id) m ON m.cve_id = c0.cve_id"""),
    "cves_in_window": ask("cve", CVE + f" SELECT cve_id FROM c0 WHERE pub >= {AS_OF} - INTERVAL 14 DAY"),
}
