from checks import ask
from checks.assets import _pairs
from checks.graph import GRAPH, PATHS
from checks.triage import AGE, MERGE
from threatloom.operators.snapshots import PRESETS
from threatloom.sources.sample_views import ASSET


def _assets(name, status):
    body = ASSET.replace("AS STRING", "AS VARCHAR").replace("AS DECIMAL(38,0)", "AS HUGEINT").replace("@lineitem", f"(SELECT * FROM lineitem WHERE l_linestatus = '{status}') li")
    return f"{name} AS MATERIALIZED ({body})"


BOTH = _assets("ab", "F") + ",\n" + _assets("ah", "O") + """,
v_asset AS MATERIALIZED (SELECT * REPLACE ('base|' || repo_id AS repo_id) FROM ab UNION ALL SELECT * REPLACE ('head|' || repo_id AS repo_id) FROM ah)"""
KEYED = """ka AS MATERIALIZED (SELECT split_part(repo_id, '|', 1) AS scan, split_part(repo_id, '|', 2) AS repo_id, type || ':' || name || '@' || file AS key, sensitive, exposed, description, list_sort(string_split(tags, ',')) AS tg
   FROM v_asset QUALIFY row_number() OVER (PARTITION BY repo_id, type || ':' || name || '@' || file ORDER BY ord DESC) = 1),
da AS MATERIALIZED (SELECT coalesce(b.repo_id, h.repo_id) AS repo_id, coalesce(b.key, h.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN h.key IS NULL THEN 'removed' ELSE 'modified' END AS change,
   concat_ws('; ', CASE WHEN b.sensitive <> h.sensitive THEN 'sensitivity changed: ' || b.sensitive || ' → ' || h.sensitive END, CASE WHEN b.exposed <> h.exposed THEN 'exposure changed: ' || b.exposed || ' → ' || h.exposed END,
     CASE WHEN b.description <> h.description THEN 'description changed' END, CASE WHEN b.tg <> h.tg THEN 'tags changed' END) AS changes
   FROM (SELECT * FROM ka WHERE scan = 'base') b FULL OUTER JOIN (SELECT * FROM ka WHERE scan = 'head') h ON b.repo_id = h.repo_id AND b.key = h.key)"""
ASSET_DIFF = BOTH + ",\n" + KEYED + ",\nad AS MATERIALIZED (SELECT * FROM da WHERE change <> 'modified' OR changes <> '')"
SPLIT = MERGE.strip().replace("FROM v_threat)", "FROM (SELECT * REPLACE (CASE WHEN discovered_at < TIMESTAMP '2024-01-16' THEN 'base|' ELSE 'head|' END || repo_id AS repo_id) FROM v_threat))").replace(
    f"{AGE} <= 25", f"{AGE} <= 90")
THREAT_DIFF = SPLIT + """,
tk AS MATERIALIZED (SELECT DISTINCT split_part(repo_id, '|', 1) AS scan, split_part(repo_id, '|', 2) AS repo_id, title, severity FROM triaged),
td AS MATERIALIZED (SELECT repo_id, title || ':' || severity AS key, severity, 'added' AS change FROM (SELECT repo_id, title, severity FROM tk WHERE scan = 'head' EXCEPT SELECT repo_id, title, severity FROM tk WHERE scan = 'base')
   UNION ALL SELECT repo_id, title || ':' || severity, severity, 'removed' FROM (SELECT repo_id, title, severity FROM tk WHERE scan = 'base' EXCEPT SELECT repo_id, title, severity FROM tk WHERE scan = 'head')),
st AS MATERIALIZED (SELECT split_part(repo_id, '|', 1) AS scan, split_part(repo_id, '|', 2) AS repo_id, round(max(priority), 6) AS mx, round(avg(priority), 6) AS av, count(*) AS n FROM triaged GROUP BY ALL),
rd AS MATERIALIZED (SELECT repo_id, coalesce(max(mx) FILTER (WHERE scan = 'base'), 0) AS base_max, coalesce(max(mx) FILTER (WHERE scan = 'head'), 0) AS head_max, coalesce(max(av) FILTER (WHERE scan = 'base'), 0) AS base_avg, coalesce(max(av) FILTER (WHERE scan = 'head'), 0) AS head_avg,
   CAST(coalesce(max(n) FILTER (WHERE scan = 'head'), 0) - coalesce(max(n) FILTER (WHERE scan = 'base'), 0) AS BIGINT) AS threat_delta, CASE WHEN head_max > base_max THEN 'increased' WHEN head_max < base_max THEN 'decreased' ELSE 'unchanged' END AS direction FROM st GROUP BY repo_id)"""
U = "a AS MATERIALIZED (SELECT * FROM v_asset QUALIFY row_number() OVER (PARTITION BY repo_id, id ORDER BY ord) = 1)"
FK = """fk AS MATERIALIZED (SELECT DISTINCT split_part(repo_id, '|', 1) AS scan, split_part(repo_id, '|', 2) AS repo_id, kind, src_file, dst_file FROM flow),
fd AS MATERIALIZED (SELECT repo_id, kind, src_file, dst_file, 'added' AS change FROM (SELECT repo_id, kind, src_file, dst_file FROM fk WHERE scan = 'head' EXCEPT SELECT repo_id, kind, src_file, dst_file FROM fk WHERE scan = 'base')
   UNION ALL SELECT repo_id, kind, src_file, dst_file, 'removed' FROM (SELECT repo_id, kind, src_file, dst_file FROM fk WHERE scan = 'base' EXCEPT SELECT repo_id, kind, src_file, dst_file FROM fk WHERE scan = 'head'))"""
FLOW_DIFF = BOTH + ",\n" + U + ",\n" + _pairs() + ",\n" + FK

PK = """pk AS MATERIALIZED (SELECT DISTINCT split_part(repo_id, '|', 1) AS scan, split_part(repo_id, '|', 2) AS repo_id, entry || ':' || target AS key FROM ap),
pd AS MATERIALIZED (SELECT repo_id, key, 'added' AS change FROM (SELECT repo_id, key FROM pk WHERE scan = 'head' EXCEPT SELECT repo_id, key FROM pk WHERE scan = 'base')
   UNION ALL SELECT repo_id, key, 'removed' FROM (SELECT repo_id, key FROM pk WHERE scan = 'base' EXCEPT SELECT repo_id, key FROM pk WHERE scan = 'head'))"""
NODES_ON = PATHS[PATHS.index("\nth AS"):]
PATH_DIFF = FLOW_DIFF + ",\n" + SPLIT + "," + NODES_ON + ",\n" + PK
DEP = """dv AS (SELECT repo_id, scan_id, name, max_by(version, ord) AS version FROM v_dependency GROUP BY ALL),
dd AS MATERIALIZED (SELECT * FROM (SELECT coalesce(b.repo_id, h.repo_id) AS repo_id, coalesce(b.name, h.name) AS name, b.version AS old_version, h.version AS new_version, CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' WHEN b.version <> h.version THEN 'updated' END AS change
   FROM (SELECT * FROM dv WHERE scan_id = 'base') b FULL OUTER JOIN (SELECT * FROM dv WHERE scan_id = 'head') h ON b.repo_id = h.repo_id AND b.name = h.name) WHERE change IS NOT NULL)"""
EVERYTHING = PATH_DIFF + ",\n" + KEYED + ",\nad AS MATERIALIZED (SELECT * FROM da WHERE change <> 'modified' OR changes <> ''),\n" + THREAT_DIFF[len(SPLIT) + 2:] + ",\n" + DEP + """,
cc AS MATERIALIZED (SELECT repo_id, 'asset' AS entity, change FROM ad UNION ALL SELECT repo_id, 'threat', change FROM td UNION ALL SELECT repo_id, 'flow', change FROM fd UNION ALL SELECT repo_id, 'path', change FROM pd UNION ALL SELECT repo_id, 'dependency', change FROM dd),
ct AS (SELECT repo_id, count(*) AS total_changes, count(*) FILTER (WHERE entity = 'threat' AND change = 'added') AS new_threats, count(*) FILTER (WHERE entity = 'threat' AND change = 'removed') AS resolved_threats, count(*) FILTER (WHERE entity = 'path' AND change = 'added') AS new_paths FROM cc GROUP BY repo_id),
sv AS (SELECT repo_id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m, count(*) FILTER (WHERE severity = 'low') AS l, count(*) FILTER (WHERE severity = 'info') AS i FROM td WHERE change = 'added' GROUP BY repo_id),
rp AS (SELECT 'repo-' || l_suppkey AS repo_id FROM lineitem UNION SELECT 'repo-' || user_id FROM events UNION SELECT 'repo-' || (p_partkey % 100) FROM part),
sm AS MATERIALIZED (SELECT rp.repo_id, coalesce(base_max, 0) AS base_max, coalesce(head_max, 0) AS head_max, coalesce(base_avg, 0) AS base_avg, coalesce(head_avg, 0) AS head_avg, coalesce(threat_delta, 0) AS threat_delta, coalesce(direction, 'unchanged') AS direction, coalesce(total_changes, 0) AS total_changes, coalesce(new_threats, 0) AS new_threats, coalesce(resolved_threats, 0) AS resolved_threats, coalesce(new_paths, 0) AS new_paths, coalesce(c, 0) AS new_critical, coalesce(h, 0) AS new_high, coalesce(m, 0) AS new_medium, coalesce(l, 0) AS new_low, coalesce(i, 0) AS new_info,
   coalesce(c, 0) + coalesce(h, 0) AS new_high_severity FROM rp LEFT JOIN rd ON rd.repo_id = rp.repo_id LEFT JOIN ct ON ct.repo_id = rp.repo_id LEFT JOIN sv ON sv.repo_id = rp.repo_id)"""
PRESET = "pre(preset, fc, fh, fi, wh, wi, mr, inc) AS (VALUES " + ", ".join("('" + k + "', " + ", ".join(str(x).lower() for x in v) + ")" for k, v in PRESETS.items()) + ")"
RULES = [
    ("new_critical > 0 AND fc", "FAIL", "printf('%d new critical threat(s) detected', new_critical)"),
    ("new_high > 0 AND fh", "FAIL", "printf('%d new high-severity threat(s) detected', new_high)"),
    ("head_max > base_max AND fi", "FAIL", "printf('Risk increased from %.2f to %.2f', base_max * 10, head_max * 10)"),
    ("mr > 0 AND head_max > mr", "FAIL", "printf('Risk score %.2f exceeds threshold %.2f', head_max * 10, CAST(mr * 10 AS DOUBLE))"),
    ("inc > 0 AND base_max > 0 AND (head_max - base_max) / base_max > inc", "FAIL", "printf('Risk increased by %.1f%% (threshold: %.1f%%)', (head_max - base_max) / base_max * 100, CAST(inc * 100 AS DOUBLE))"),
    ("new_high > 0 AND wh", "WARN", "printf('%d new high-severity threat(s) detected', new_high)"),
    ("head_max > base_max AND wi", "WARN", "printf('Risk increased from %.2f to %.2f', base_max * 10, head_max * 10)"),
    ("new_threats > 0", "WARN", "printf('%d new threat(s) detected', new_threats)"),
    ("new_paths > 0", "WARN", "printf('%d new attack path(s) detected', new_paths)"),
    ("resolved_threats > 0 AND head_max <= base_max", "PASS", "printf('%d threat(s) resolved, risk stable at %.2f', resolved_threats, head_max * 10)"),
    ("direction = 'decreased'", "PASS", "printf('Risk decreased from %.2f to %.2f', base_max * 10, head_max * 10)"),
    ("total_changes = 0", "PASS", "'No changes detected'"),
]
VERDICT = "CASE " + " ".join(f"WHEN {t} THEN '{x}'" for t, x, _ in RULES) + " ELSE 'PASS' END"
REASON = "CASE " + " ".join(f"WHEN {t} THEN {r}" for t, _, r in RULES) + " ELSE printf('No new threats detected. Risk stable at %.2f', head_max * 10) END"
MOVED = "printf('%.1f', base_max * 10) || ' → ' || printf('%.1f', head_max * 10)"
LINE = f"""CASE verdict WHEN 'PASS' THEN '✅ PASS: ' || CASE WHEN resolved_threats > 0 THEN resolved_threats || ' threat(s) resolved. Risk stable at ' || printf('%.1f', head_max * 10) WHEN direction = 'decreased' THEN 'Risk decreased ' || {MOVED} ELSE 'No new threats. Risk stable at ' || printf('%.1f', head_max * 10) END
  WHEN 'WARN' THEN '⚠️ WARN: ' || CASE WHEN new_high_severity > 0 THEN '+' || new_high_severity || ' new high-severity threat(s). Risk: ' || {MOVED} WHEN direction = 'increased' THEN 'Risk increased. Risk: ' || {MOVED} ELSE '+' || new_threats || ' new threat(s). Risk: ' || printf('%.1f', head_max * 10) END
  ELSE '❌ FAIL: ' || reason END"""
DAILY = "dy AS MATERIALIZED (SELECT repo_id, date_trunc('day', discovered_at) AS day, max(CASE severity WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.7 ELSE 0.4 END)::DOUBLE AS r, count(*) AS n FROM v_threat GROUP BY ALL)"
assert GRAPH


def on_threats(body):
    return ask("threat", body)


SQL = {
    "diff_assets": "WITH " + ASSET_DIFF + " SELECT repo_id, key, change, CASE WHEN change = 'modified' THEN changes ELSE '' END AS changes FROM ad",
    "diff_critical_modifications": "WITH " + ASSET_DIFF + " SELECT repo_id, key FROM ad WHERE change = 'modified' AND (contains(changes, 'exposed') OR contains(changes, 'sensitivity'))",
    "diff_threats": on_threats(THREAT_DIFF + " SELECT repo_id, key, severity, change FROM td"),
    "diff_flows": "WITH " + FLOW_DIFF + " SELECT repo_id, kind, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'removed') AS n_removed FROM fd GROUP BY ALL",
    "diff_paths": on_threats(PATH_DIFF + " SELECT repo_id, key, change FROM pd"),
    "diff_dependencies": ask("dependency", DEP + " SELECT repo_id, name, old_version, new_version, change FROM dd"),
    "diff_change_table": ask("threat dependency", EVERYTHING + " SELECT repo_id, entity, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change IN ('modified', 'updated')) AS modified FROM cc GROUP BY ALL"),
    "diff_risk_delta": on_threats(THREAT_DIFF + " SELECT * FROM rd"),
    "diff_summary": ask("threat dependency", EVERYTHING + " SELECT * FROM sm"),
    "diff_verdicts": ask("threat dependency", EVERYTHING + ",\n" + PRESET + f", vv AS (SELECT *, {VERDICT} AS verdict, {REASON} AS reason FROM sm CROSS JOIN pre) SELECT repo_id, preset, verdict, reason, CAST(CASE verdict WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END AS BIGINT) AS exit_code, {LINE} AS line FROM vv"),
    "diff_drift": ask("threat dependency", EVERYTHING + ", dr AS (SELECT repo_id, CAST(round(least(100.0, greatest(0.0, 20 * new_critical + 10 * new_high + 5 * new_medium - 5 * resolved_threats + 100 * greatest(0.0, head_max - base_max))), 4) AS DOUBLE) AS drift FROM sm) SELECT repo_id, drift, CAST(CASE WHEN drift >= 70 THEN 2 WHEN drift >= 50 THEN 1 ELSE 0 END AS BIGINT) AS drift_level FROM dr"),
    "content_ids": ask("asset", "SELECT repo_id, type || ':' || name || '@' || file AS id, count(*) AS n FROM v_asset GROUP BY ALL"),
    "risk_trend": on_threats(DAILY + """ SELECT repo_id, count(*) AS n_scans, min_by(r, day) AS old_risk, max_by(r, day) AS new_risk, round((max_by(r, day) - min_by(r, day)) / min_by(r, day) * 100, 6) AS percent_change,
        CASE WHEN max_by(r, day) > min_by(r, day) THEN 'degrading' WHEN max_by(r, day) < min_by(r, day) THEN 'improving' ELSE 'stable' END AS direction, max_by(n, day) - min_by(n, day) AS threat_change FROM dy GROUP BY repo_id"""),
    "risk_windows": on_threats(DAILY + """, wn AS (SELECT unnest([7, 30, 90])::BIGINT AS days),
        jn AS (SELECT x.repo_id, x.day, days, y.r, date_diff('day', x.day::DATE, y.day::DATE) AS gap FROM dy x, wn, dy y
               WHERE y.repo_id = x.repo_id AND y.day <= x.day AND y.day >= x.day - to_days(days::INT)),
        ag AS (SELECT repo_id, day, days, count(*) AS n_scans, avg(r) AS mean_risk, max(r) AS highest_risk,
               (count(*) * sum(gap * r) - sum(gap) * sum(r)) / nullif(count(*) * sum(gap * gap) - sum(gap) * sum(gap), 0) AS slope FROM jn GROUP BY ALL)
        SELECT repo_id, strftime(day, '%Y-%m-%d') AS day, days, n_scans, round(mean_risk, 6) AS mean_risk, highest_risk, round(round(slope, 10), 6) + 0.0 AS slope,
          CASE WHEN round(slope, 9) > 0 THEN 'degrading' WHEN round(slope, 9) < 0 THEN 'improving' ELSE 'stable' END AS direction FROM ag"""),
    "risk_steps": on_threats(DAILY + " SELECT repo_id, strftime(day, '%Y-%m-%d') AS day, round(r - lag(r) OVER (PARTITION BY repo_id ORDER BY day), 6) AS risk_step FROM dy"),
}
