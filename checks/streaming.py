from checks import AS_OF, ask
from checks.compliance import ST

EV = """ev AS (SELECT 'repo-' || user_id AS repo_id, event_id AS ord, 'title:' || event_type || ' ' || (CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 16) AS dedup_key,
  CASE WHEN value >= 80 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS severity, ts FROM events)"""

SQL = {
    "feed_records": "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) - 1 AS place FROM events",
    "stream_severity_windows": "WITH " + EV + " SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, severity, count(*) AS n FROM ev GROUP BY ALL",
    "stream_first_sightings": "WITH " + EV + " SELECT DISTINCT repo_id, dedup_key FROM ev",
    "stream_merged": "WITH " + EV + " SELECT repo_id, dedup_key, 'threat-' || min(ord) AS id, count(*) AS instances FROM ev GROUP BY ALL",
    "stream_merged_lists": "WITH " + EV + """, ls AS (SELECT repo_id, dedup_key, ord, 'tag' AS kind, split_part(substr(dedup_key, 7), ' ', 1) AS value, 1 AS pos FROM ev
  UNION ALL SELECT repo_id, dedup_key, ord, 'tag', severity, 2 FROM ev UNION ALL SELECT repo_id, dedup_key, ord, 'feed', 'feed-' || ord % 3, 1 FROM ev
  UNION ALL SELECT repo_id, dedup_key, ord, 'feed', 'list-' || CAST(regexp_extract(dedup_key, '[0-9]+$', 0) AS BIGINT) % 2, 2 FROM ev)
  SELECT repo_id, dedup_key, kind, value, min(ord) AS ord, CAST(min_by(pos, ord) AS BIGINT) AS pos FROM ls GROUP BY ALL""",
    "stream_age_split": """WITH e AS (SELECT event_id, event_id % 3 AS batch, ts FROM events), m AS (SELECT batch, max(ts) AS top FROM e GROUP BY batch),
  b AS (SELECT x.batch, max(m.top) AS before FROM (SELECT DISTINCT batch FROM e) x LEFT JOIN m ON m.batch < x.batch GROUP BY x.batch)
  SELECT event_id, batch, coalesce(ts < before - INTERVAL 10 DAY, false) AS late FROM e JOIN b USING (batch)""",
    "intake_log": ask("finding", "SELECT severity AS source, count(*) AS n_records, count(*) FILTER (WHERE NOT regexp_matches(error_type, '^\\[[0-9]')) AS n_errors FROM v_finding GROUP BY severity"),
    "intake_bad_records": ask("finding", "SELECT severity AS source, error_type AS record FROM v_finding WHERE NOT regexp_matches(error_type, '^\\[[0-9]')"),
    "technique_sets": ask("threat", ST + " SELECT DISTINCT repo_id, technique_id FROM v_threat JOIN st ON st.code = stride_primary"),
    "threats_still_fresh": ask("threat", f"SELECT repo_id, ord FROM v_threat WHERE discovered_at >= {AS_OF} - INTERVAL 20 DAY"),
}
