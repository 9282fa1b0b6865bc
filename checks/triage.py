from checks import AS_OF, RANK, ask

URGENCY = """CAST(least(1.0, CASE exploitation_status WHEN 'active' THEN 0.4 WHEN 'weaponized' THEN 0.3 WHEN 'poc_public' THEN 0.2 WHEN 'theoretical' THEN 0.05 ELSE 0.1 END
  + CASE WHEN {known} THEN 0.25 ELSE 0 END
  + CASE exposure_level WHEN 'internet' THEN 0.2 WHEN 'internal' THEN 0.1 WHEN 'isolated' THEN 0.05 ELSE 0.1 END
  + CASE attack_complexity WHEN 'low' THEN 0.15 WHEN 'medium' THEN 0.08 WHEN 'high' THEN 0.03 ELSE 0.05 END) AS DOUBLE)"""
CONF = "CASE WHEN stride_primary IS NULL THEN 0.5 WHEN stride_second IS NULL THEN conf_primary ELSE (conf_primary + conf_second) / 2 END"
AGE = f"(epoch_us({AS_OF}) - epoch_us(discovered_at)) / 86400000000.0"


def priority(severity: str, known: str) -> str:
    return (f"least(1.0, 0.3 * {RANK.format(severity)} / 10.0 + 0.4 * {URGENCY.format(known=known)}"
            f" + 0.2 * ({CONF}) + 0.1 * greatest(0.0, 1.0 - {AGE} / 30.0))")


# Brute-force merge over the whole threats view; reused by later checks.
MERGE = f"""
norm AS MATERIALIZED (SELECT * EXCLUDE (title, tags, affects_known_assets),
    CASE WHEN title <> '' THEN title WHEN description <> '' THEN description[:100] ELSE 'Untitled Threat' END AS title,
    lower(tags) AS tags, {RANK.format('severity')} >= 7 AS affects_known_assets FROM v_threat),
keyed AS MATERIALIZED (SELECT *, CASE
    WHEN list_contains(string_split(tags, ','), 'code-analysis') THEN 'code:' || title[:100]
    WHEN cve_ids <> '' THEN 'cve:' || cve_ids
    WHEN indicator_values <> '' THEN 'ioc:' || indicator_type || ':' || string_split(indicator_values, ',')[1]
    ELSE 'title:' || title[:100] END AS dedup_key FROM norm),
grp AS (SELECT repo_id, dedup_key, count(*) AS n_rows, min(ord) AS first_ord, max({RANK.format('severity')}) AS top_rank FROM keyed GROUP BY ALL),
ind AS (SELECT repo_id, dedup_key, count(DISTINCT v) AS n_indicators
        FROM (SELECT repo_id, dedup_key, unnest(string_split(indicator_values, ',')) AS v FROM keyed WHERE indicator_values <> '') GROUP BY ALL),
tag AS (SELECT repo_id, dedup_key, string_agg(v, ',' ORDER BY o, p) AS tag_text FROM
        (SELECT repo_id, dedup_key, v, min(ord) AS o, min_by(p, ord) AS p FROM
           (SELECT repo_id, dedup_key, ord, unnest(string_split(tags, ',')) AS v, generate_subscripts(string_split(tags, ','), 1) AS p FROM keyed WHERE tags <> '')
         GROUP BY ALL) GROUP BY ALL),
feed AS (SELECT repo_id, dedup_key, string_agg(v, ',' ORDER BY o) AS feed_text FROM
        (SELECT repo_id, dedup_key, source_feeds AS v, min(ord) AS o FROM keyed GROUP BY ALL) GROUP BY ALL),
merged0 AS (SELECT k.* EXCLUDE (severity, instance_count), g.n_rows, coalesce(i.n_indicators, 0) AS n_indicators,
    coalesce(tag_text, '') AS tag_text, feed_text,
    CASE top_rank WHEN 10 THEN 'critical' WHEN 7 THEN 'high' WHEN 5 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
    greatest(k.instance_count, 1) + g.n_rows - 1 AS instance_count
  FROM grp g JOIN keyed k ON k.repo_id = g.repo_id AND k.dedup_key = g.dedup_key AND k.ord = g.first_ord
  LEFT JOIN ind i ON i.repo_id = g.repo_id AND i.dedup_key = g.dedup_key
  LEFT JOIN tag t ON t.repo_id = g.repo_id AND t.dedup_key = g.dedup_key
  LEFT JOIN feed f ON f.repo_id = g.repo_id AND f.dedup_key = g.dedup_key),
merged AS MATERIALIZED (SELECT * EXCLUDE (description), {priority('severity', 'affects_known_assets')} AS priority,
    CASE WHEN dedup_key LIKE 'code:%' AND n_rows > 1
      THEN regexp_replace(description, '^(.*) \\(.*$', '\\1', 's') || ' (' || instance_count || ' instances across ' || n_indicators || ' files)'
      ELSE description END AS description FROM merged0),
triaged AS MATERIALIZED (SELECT * FROM merged WHERE NOT false_positive AND priority >= 0.3 AND {AGE} <= 25)
"""

SQL = {
    "threat_scores": ask("threat", f"""
        SELECT repo_id, ord, CAST({RANK.format('severity')} AS BIGINT) AS severity_rank,
          round({URGENCY.format(known='affects_known_assets')}, 6) AS urgency,
          round({priority('severity', 'affects_known_assets')}, 6) AS priority FROM v_threat"""),
    "threats_normalized": ask("threat", """
        SELECT repo_id, ord, CASE WHEN title <> '' THEN title WHEN description <> '' THEN left(description, 100) ELSE 'Untitled Threat' END AS title,
          lower(tags) AS tags FROM v_threat"""),
    "threats_enriched": ask("threat", """
        SELECT repo_id, ord, severity IN ('critical', 'high') AS affects_known_assets,
          CASE WHEN stride_primary = 'S' THEN 'Monitor authentication failures; Track credential usage patterns; Validate token integrity' ELSE '' END AS detection_rules
        FROM v_threat"""),
    "threat_dedup_keys": ask("threat", MERGE + " SELECT repo_id, ord, dedup_key FROM keyed"),
    "threats_merged": ask("threat", MERGE + """
        SELECT repo_id, dedup_key, ord, title, description, severity, CAST(instance_count AS BIGINT) AS instance_count,
          CAST(n_indicators AS BIGINT) AS n_indicators, tag_text AS tags, feed_text AS source_feeds, round(priority, 6) AS priority FROM merged"""),
    "merged_indicators": ask("threat", MERGE + """
        SELECT repo_id, dedup_key, v AS value, min(ord) AS ord FROM
          (SELECT repo_id, dedup_key, ord, unnest(string_split(indicator_values, ',')) AS v FROM keyed WHERE indicator_values <> '') GROUP BY ALL"""),
    "threats_triaged": ask("threat", MERGE + """
        SELECT repo_id, dedup_key, title, severity, CAST(instance_count AS BIGINT) AS instance_count, round(priority, 6) AS priority FROM triaged"""),
    "triage_stage_counts": ask("threat", MERGE + f"""
        SELECT repo_id, CAST(sum(n_rows) AS BIGINT) AS normalized, CAST(sum(n_rows) AS BIGINT) AS enriched, count(*) AS deduplicated,
          count(*) AS prioritized, count(*) FILTER (WHERE NOT false_positive AND priority >= 0.3 AND {AGE} <= 25) AS filtered
        FROM merged GROUP BY repo_id"""),
    "triage_observed": ask("threat", MERGE + f""", c AS (SELECT CAST(sum(n_rows) AS BIGINT) AS n_read, count(*) AS n_merged,
          count(*) FILTER (WHERE NOT false_positive AND priority >= 0.3 AND {AGE} <= 25) AS n_kept FROM merged)
        SELECT unnest(['normalized', 'enriched', 'deduplicated', 'prioritized', 'filtered']) AS stage,
          unnest([n_read, n_read, n_merged, n_merged, n_kept]) AS n FROM c"""),
}
