from checks import ask
from checks.assets import FLOWS, any_like, q
from threatloom.catalogs import code


def case(column, table):
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {q(str(x))}" for k, x in table.items()) + " END"


TITLE = case("rule", {n: r[0] for n, r in code.RULES.items()})
SEVERITY = case("rule", {n: r[1] for n, r in code.RULES.items()})
PRIMARY = case("rule", {n: r[2][0] for n, r in code.RULES.items()})
SECOND = case("rule", {n: ",".join(r[2][1:]) for n, r in code.RULES.items()})


def filled(rules, **slots):
    out = []
    for rule in rules:
        text = q(code.RULE_TEXTS[rule])
        for name, column in slots.items():
            text = f"replace({text}, '{{{name}}}', {column})"
        out.append(f"WHEN {rule} THEN {text}")
    return "CASE rule " + " ".join(out) + " END"


TRANSPORT = "(contains(lower(description), 'http://') AND NOT contains(lower(description), 'https://')) OR contains(lower(description), 'insecure') OR (contains(lower(description), 'skip') AND contains(lower(description), 'verify'))"
UNGUARDED = """ungu AS MATERIALIZED (SELECT * FROM v_asset x WHERE type = 'api' AND NOT EXISTS (SELECT 1 FROM v_asset y WHERE y.type = 'authentication'
    AND y.repo_id = x.repo_id AND y.file = x.file AND abs(y.line - x.line) < 50))"""
HITS = UNGUARDED + f""",
hit AS MATERIALIZED (SELECT * FROM (
  SELECT *, 1 AS rule FROM ungu
  UNION ALL SELECT *, 2 FROM v_asset WHERE type = 'database' AND {any_like('lower(description)', code.CONCAT_WORDS)}
  UNION ALL SELECT *, 3 FROM v_asset WHERE type = 'secret' AND NOT contains(file, '.env')
  UNION ALL SELECT *, 4 FROM v_asset WHERE type = 'network' AND ({TRANSPORT})
  UNION ALL SELECT *, 5 FROM v_asset WHERE type = 'filesystem' AND sensitive
  UNION ALL SELECT *, 6 FROM v_asset WHERE type = 'cryptography'
  UNION ALL SELECT *, 7 FROM v_asset WHERE type = 'authentication' AND ({any_like('lower(description)', code.INSECURE_STORAGE_WORDS)} OR {any_like('lower(name)', code.INSECURE_STORAGE_WORDS)}))
  QUALIFY row_number() OVER (PARTITION BY repo_id, file, line ORDER BY ord) = 1)"""
EXPOSURE = "CASE WHEN exposed THEN 'internet' WHEN type = 'api' THEN 'internal' ELSE 'isolated' END"
AGENTIC = "agentic AS MATERIALIZED (" + " UNION ALL ".join(
    f"(SELECT *, {rule} AS rule FROM v_asset WHERE {any_like('lower(description)', words)} OR {any_like('lower(name)', words)}"
    + (f" OR {any_like('lower(file)', words)}" if in_file else "")
    + " QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ord) = 1)"
    for rule, (words, in_file, _) in code.AGENTIC_RULES.items()) + ")"
ASSET_TEXT = filled(range(1, 8), name="name", file="file", line="CAST(line AS VARCHAR)")
AGENTIC_TEXT = filled((11, 12, 13), file="file", line="CAST(line AS VARCHAR)")
FLOW_TEXT = filled((8, 9, 10), src="src_file || ':' || src_line", dst="dst_file || ':' || dst_line")


# Marks per end are found once per distinct location, then looked up for every flow.
FLOW_HITS = FLOWS + """,
loc AS MATERIALIZED (SELECT x.repo_id, x.file, x.line, bool_or(y.type = 'network' AND y.line = x.line) AS network, bool_or(y.type = 'api' AND abs(y.line - x.line) < 10) AS api,
    bool_or(y.type = 'authentication' AND abs(y.line - x.line) < 10) AS auth, bool_or(y.type = 'cryptography' AND abs(y.line - x.line) < 20) AS crypto
  FROM (SELECT DISTINCT repo_id, file, line FROM a) x JOIN a y ON x.repo_id = y.repo_id AND x.file = y.file GROUP BY ALL),
fh AS MATERIALIZED (SELECT f.*, unnest(list_concat(CASE WHEN f.sensitive AND d.network THEN [8] ELSE [] END, CASE WHEN s.api THEN [9] ELSE [] END,
      CASE WHEN (s.auth OR d.auth) AND NOT (s.crypto OR d.crypto) THEN [10] ELSE [] END)) AS rule
  FROM flow f JOIN loc s ON s.repo_id = f.repo_id AND s.file = f.src_file AND s.line = f.src_line
              JOIN loc d ON d.repo_id = f.repo_id AND d.file = f.dst_file AND d.line = f.dst_line)"""
FLOW_THREATS = FLOW_HITS + f""",
ft AS MATERIALIZED (SELECT x.repo_id, x.data_type, x.rule, x.src_ord, src_file, src_line, dst_file, dst_line, n, CASE WHEN top = 7 THEN 'high' ELSE 'medium' END AS severity FROM
    (SELECT *, row_number() OVER (PARTITION BY repo_id, data_type ORDER BY src_ord, dst_ord, rule) AS rn, count(*) OVER (PARTITION BY repo_id, data_type) AS n,
       max(CASE WHEN rule IN (8, 10) THEN 7 ELSE 5 END) OVER (PARTITION BY repo_id, data_type) AS top FROM fh) x WHERE rn = 1)"""

# Merge of all code threats of a repository, straight from the hits.
CODE_MERGED = HITS + ",\n" + AGENTIC + ",\n" + FLOW_THREATS + f""",
ct AS (SELECT repo_id, ord, name, {TITLE} AS title, {SEVERITY} AS severity, {ASSET_TEXT} AS description, {EXPOSURE} AS exposure, {PRIMARY} AS primary_cat, {SECOND} AS second_cat FROM hit
  UNION ALL SELECT repo_id, ord, name, {TITLE}, {SEVERITY}, {AGENTIC_TEXT}, {EXPOSURE}, {PRIMARY}, {SECOND} FROM agentic),
cm AS (SELECT repo_id, title, severity, arg_min(description, ord) AS description, arg_min(exposure, ord) AS exposure, any_value(primary_cat) AS primary_cat, any_value(second_cat) AS second_cat, count(*) AS n, count(DISTINCT name) AS files FROM ct GROUP BY repo_id, title, severity),
code_triaged AS MATERIALIZED (
  SELECT repo_id, 'code:' || title AS dedup_key, title, severity,
    CASE WHEN n > 1 THEN description || ' (' || n || ' instances across ' || files || ' files)' ELSE description END AS description, n AS instance_count, files AS n_indicators,
    CAST(0.3 * CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 ELSE 5 END / 10.0
      + 0.4 * (0.05 + CASE WHEN severity IN ('critical', 'high') THEN 0.25 ELSE 0 END + CASE exposure WHEN 'internet' THEN 0.2 WHEN 'internal' THEN 0.1 ELSE 0.05 END + 0.15)
      + 0.2 * CASE WHEN second_cat = '' THEN 0.85 ELSE 0.75 END + 0.1 AS DOUBLE) AS priority, primary_cat, '' AS src FROM cm
  UNION ALL
  SELECT repo_id, 'ioc:attack_pattern:' || data_type, {TITLE}, severity, {FLOW_TEXT}, n, 1,
    CAST(0.3 * CASE severity WHEN 'high' THEN 7 ELSE 5 END / 10.0 + 0.4 * (0.05 + CASE WHEN severity = 'high' THEN 0.25 ELSE 0 END + 0.1 + 0.15) + 0.2 * 0.8 + 0.1 AS DOUBLE), {PRIMARY}, 'flow' FROM ft)"""

SQL = {
    "unguarded_apis": ask("asset", UNGUARDED + " SELECT repo_id, CAST(ord AS VARCHAR) AS ord, id FROM ungu"),
    "asset_rule_threats": ask("asset", HITS + f"""
        SELECT repo_id, 'code-threat-' || id AS id, CAST(rule AS BIGINT) AS rule, {TITLE} AS title, {ASSET_TEXT} AS description, {SEVERITY} AS severity,
          {PRIMARY} AS stride_primary, {SECOND} AS stride_secondary, {EXPOSURE} AS exposure_level, 'code-analysis,' || {SEVERITY} || ',' || type AS tags, CAST(0.85 AS DOUBLE) AS confidence FROM hit"""),
    "agentic_rule_threats": ask("asset", AGENTIC + f"""
        SELECT repo_id, {TITLE} AS title, {AGENTIC_TEXT} AS description, {SEVERITY} AS severity,
          'code-analysis,' || {SEVERITY} || ',' || type || ',' || {case('rule', {n: ','.join(r[2]) for n, r in code.AGENTIC_RULES.items()})} AS tags FROM agentic"""),
    "flow_rule_hits": ask("asset", FLOW_HITS + """
        SELECT repo_id, kind, CAST(rule AS BIGINT) AS rule, n AS n_flows, src_file, src_line, dst_file, dst_line FROM
          (SELECT *, row_number() OVER (PARTITION BY repo_id, kind, rule ORDER BY src_ord, dst_ord) AS rn, count(*) OVER (PARTITION BY repo_id, kind, rule) AS n FROM fh) WHERE rn = 1"""),
    "flow_rule_threats": ask("asset", FLOW_THREATS + f"""
        SELECT repo_id, 'flow-threat-' || data_type AS id, {TITLE} AS title, {FLOW_TEXT} AS description, severity, {PRIMARY} AS stride_primary, n AS instance_count FROM ft"""),
    "code_threats_triaged": ask("asset", CODE_MERGED + """
        SELECT repo_id, dedup_key, title, severity, description, instance_count, n_indicators, round(priority, 6) AS priority FROM code_triaged WHERE priority >= 0.3"""),
}
