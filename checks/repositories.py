from checks import ask
from checks.assets import any_like, first, q
from threatloom.catalogs import architecture as ar

LANG = "lang AS MATERIALIZED (SELECT repo_id, min_by(language, rank) AS language FROM (" + " UNION ALL ".join(
    f"SELECT repo_id, '{language}' AS language, {rank} AS rank FROM v_file WHERE path IN ({', '.join(q(m) for m in markers)})" + (" OR path LIKE 'node_modules/%'" if "node_modules" in markers else "")
    for rank, (language, markers) in enumerate(ar.LANGUAGE_MARKERS.items())) + " UNION ALL SELECT repo_id, 'unknown', 99 FROM v_file) GROUP BY repo_id)"
FRAME = LANG + ",\nfw AS MATERIALIZED (SELECT l.repo_id, l.language, CASE " + " ".join(
    f"WHEN l.language = '{language}' THEN CASE " + " ".join(f"WHEN contains(f.content, {q(t)}) THEN '{name}'" for t, name in tests) + f" ELSE '{default}' END"
    for language, (manifest, tests, default) in ar.FRAMEWORK_TESTS.items()) + " ELSE 'unknown' END AS framework FROM lang l LEFT JOIN v_file f ON f.repo_id = l.repo_id AND f.path = CASE " + " ".join(
    f"WHEN l.language = '{language}' THEN '{manifest}'" for language, (manifest, _, _) in ar.FRAMEWORK_TESTS.items()) + " END)"




# Dependencies: lines by position, section state by the last opener or closer before the line.
DEPS = LANG + """,
ml AS MATERIALIZED (SELECT f.repo_id, f.path, CASE WHEN f.path IN ('Pipfile', 'build.gradle') THEN 1 ELSE 0 END AS rank, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS pos
  FROM v_file f JOIN lang l ON l.repo_id = f.repo_id WHERE (l.language = 'go' AND path = 'go.mod') OR (l.language = 'python' AND path IN ('requirements.txt', 'Pipfile')) OR (l.language IN ('javascript', 'typescript') AND path = 'package.json')
    OR (l.language = 'ruby' AND path = 'Gemfile') OR (l.language = 'java' AND path IN ('pom.xml', 'build.gradle')) OR (l.language = 'rust' AND path = 'Cargo.toml')),
mt AS MATERIALIZED (SELECT *, trim(raw) AS t FROM ml),
mo AS MATERIALIZED (SELECT *, CASE WHEN path = 'go.mod' AND t LIKE 'require%(%' THEN 1 WHEN path = 'go.mod' AND t = ')' THEN 0 WHEN path = 'Pipfile' AND t LIKE '[packages]%' THEN 1 WHEN path = 'Cargo.toml' AND t LIKE '[dependencies]%' THEN 1
   WHEN path IN ('Pipfile', 'Cargo.toml') AND t LIKE '[%' THEN 0 WHEN path = 'package.json' AND (contains(t, '"dependencies"') OR contains(t, '"devDependencies"')) THEN 1 WHEN path = 'package.json' AND t = '}' THEN 0 END AS mark FROM mt),
ms AS MATERIALIZED (SELECT *, coalesce((SELECT arg_max(b.mark, b.pos) FROM mo b WHERE b.repo_id = a.repo_id AND b.path = a.path AND b.pos < a.pos AND b.mark IS NOT NULL), 0) AS inside FROM mo a),
dp AS MATERIALIZED (
  SELECT repo_id, rank, regexp_split_to_array(t, '\\s+')[1] AS name, regexp_split_to_array(t, '\\s+')[2] AS version FROM ms WHERE path = 'go.mod' AND inside = 1 AND mark IS NULL AND t <> '' AND t NOT LIKE '//%' AND len(regexp_split_to_array(t, '\\s+')) >= 2
  UNION ALL SELECT repo_id, rank, trim(string_split(t, sep)[1]), CASE WHEN sep = '@none@' THEN '' ELSE trim(string_split(t, sep)[2]) END FROM (SELECT *, CASE WHEN contains(t, '==') THEN '==' WHEN contains(t, '>=') THEN '>=' WHEN contains(t, '<=') THEN '<=' WHEN contains(t, '~=') THEN '~=' WHEN contains(t, '>') THEN '>' WHEN contains(t, '<') THEN '<' ELSE '@none@' END AS sep FROM ms WHERE path = 'requirements.txt' AND t <> '' AND t NOT LIKE '#%')
  UNION ALL SELECT repo_id, rank, trim(string_split(t, '=')[1]), trim(trim(string_split(t, '=')[2]), '"''{}') FROM ms WHERE path IN ('Pipfile', 'Cargo.toml') AND inside = 1 AND mark IS NULL AND contains(t, '=')
  UNION ALL SELECT repo_id, rank, trim(trim(string_split(t, ':')[1]), '",'), trim(trim(string_split(t, ':')[2]), '",^~') FROM ms WHERE path = 'package.json' AND inside = 1 AND mark IS NULL AND contains(t, ':')
  UNION ALL SELECT repo_id, rank, string_split(t, '''')[2], regexp_replace(coalesce(string_split(t, '''')[4], ''), '^~> ', '') FROM ms WHERE path = 'Gemfile' AND t LIKE 'gem %'
  UNION ALL SELECT repo_id, rank, split_part(c, ':', 1) || ':' || split_part(c, ':', 2), split_part(c, ':', 3) FROM (SELECT *, regexp_extract(t, '[''"]([^''"]*)[''"]', 1) AS c FROM ms WHERE path = 'build.gradle' AND (contains(t, 'implementation') OR contains(t, 'compile') OR contains(t, 'api'))) WHERE contains(c, ':')
  UNION ALL SELECT repo_id, 0, regexp_extract(b, '<artifactId>(.*?)</artifactId>', 1), regexp_extract(b, '<version>(.*?)</version>', 1) FROM (SELECT f.repo_id, unnest(regexp_extract_all(content, '(?s)<dependency>\\n(.*?)</dependency>', 1)) AS b FROM v_file f JOIN lang l ON l.repo_id = f.repo_id WHERE l.language = 'java' AND path = 'pom.xml'))"""


def has(where):
    return f"SELECT DISTINCT repo_id FROM v_file WHERE {where}"


def signal(kind, evidence, weight, arch, source):
    return f"SELECT repo_id, '{kind}' AS type, {evidence} AS evidence, CAST({weight} AS DOUBLE) AS weight, '{arch}' AS arch_type FROM ({source})"


def _signals():
    out = []
    dep = "dependency"
    first_dir = lambda group: "SELECT repo_id, CASE " + " ".join(f"WHEN bool_or(path LIKE '{n}/%') THEN '{n}/ directory'" for n in group) + " END AS e FROM v_file GROUP BY repo_id"
    cmd = "SELECT repo_id, count(DISTINCT d) AS n FROM (SELECT repo_id, regexp_extract(path, '^(.*/)?cmd/', 0) AS d FROM v_file WHERE regexp_matches(path, '(^|/)cmd/')) GROUP BY repo_id"
    out.append(signal("project-structure", "'multiple cmd directories'", 0.8, "microservices", f"SELECT * FROM ({cmd}) WHERE n > 1"))
    out.append(signal("project-structure", "'single cmd directory'", 0.3, "monolith", f"SELECT * FROM ({cmd}) WHERE n = 1"))
    out.append(signal("project-structure", "'services/ directory'", 0.8, "microservices", has("path LIKE 'services/%'")))
    out.append(signal("project-structure", "'pkg or lib directory without main'", 0.7, "library", "SELECT repo_id FROM v_file GROUP BY repo_id HAVING bool_or(path LIKE 'pkg/%' OR path LIKE 'lib/%') AND NOT bool_or(path IN ('main.go', 'main.py', 'index.js', 'index.ts'))"))
    out.append(signal("project-structure", "'serverless function directories'", 0.7, "serverless", has("path LIKE 'lambda/%' OR path LIKE 'functions/%'")))
    out.append(signal("project-structure", "e", 0.6, "web-app", f"SELECT * FROM ({first_dir(ar.FRONTEND_DIRS)}) WHERE e IS NOT NULL"))
    out.append(signal("project-structure", "e", 0.7, "data-pipeline", f"SELECT * FROM ({first_dir(ar.DATA_DIRS)}) WHERE e IS NOT NULL"))
    ml = " + ".join(f"CAST(bool_or(path LIKE '{n}/%') AS INT)" for n in ar.ML_DIRS)
    out.append(signal("project-structure", "'multiple ML directories'", 0.6, "ai-ml", f"SELECT repo_id FROM v_file GROUP BY repo_id HAVING {ml} >= 2"))
    m = lambda words: any_like("mtext", words)
    out.append(signal(dep, "'gRPC'", 0.8, "microservices", f"SELECT * FROM man WHERE {m(['grpc', 'protobuf', 'proto'])}"))
    out.append(signal(dep, "'gRPC'", 0.7, "api-service", f"SELECT * FROM man WHERE {m(['grpc', 'protobuf', 'proto'])}"))
    for name, words in ar.WEB_FRAMEWORKS.items():
        out.append(signal(dep, q(name), 0.7, "web-app" if name in ar.PAGE_FRAMEWORKS else "api-service", f"SELECT * FROM man WHERE {m(words)}"))
    for words, weight, arch in ((ar.SERVERLESS_DEPS, 0.9, "serverless"), (ar.QUEUE_DEPS, 0.7, "microservices"), (ar.QUEUE_DEPS, 0.6, "data-pipeline"), (ar.ML_DEPS, 0.9, "ai-ml"), (ar.DATA_DEPS, 0.8, "data-pipeline"), (ar.MOBILE_DEPS, 0.7, "mobile-backend")):
        out.append(signal(dep, first("mtext", words), weight, arch, f"SELECT * FROM man WHERE {m(words)}"))
    out.append(signal(dep, first("mtext", ar.CLI_DEPS), 0.8, "cli", f"SELECT * FROM man WHERE {m(ar.CLI_DEPS)} AND NOT {m(ar.CLI_BLOCKERS)}"))
    out.append(signal("file-pattern", "'multiple Dockerfiles'", 0.8, "microservices", "SELECT repo_id FROM v_file WHERE path LIKE '%Dockerfile' GROUP BY repo_id HAVING count(*) > 2"))
    out.append(signal("file-pattern", "'docker-compose with multiple services'", 0.9, "microservices", "SELECT * FROM comp WHERE n >= 3"))
    out.append(signal("file-pattern", "'docker-compose.yml'", 0.4, "monolith", "SELECT * FROM comp WHERE n < 3"))
    out.append(signal("file-pattern", "'kubernetes configuration'", 0.8, "microservices", has("path LIKE 'kubernetes/%' OR path LIKE 'k8s/%' OR path LIKE 'helm/%'")))
    sf = "SELECT repo_id, CASE " + " ".join(f"WHEN bool_or(path = '{n}') THEN '{n}'" for n in ar.SERVERLESS_FILES) + " END AS e FROM v_file GROUP BY repo_id"
    out.append(signal("config", "e", 0.9, "serverless", f"SELECT * FROM ({sf}) WHERE e IS NOT NULL"))
    out.append(signal("config", "'terraform serverless'", 0.9, "serverless", has("path LIKE 'terraform/%.tf' AND " + any_like("lower(content)", ar.TERRAFORM_FUNCTIONS))))
    out.append(signal("file-pattern", "'.ipynb files'", 0.6, "ai-ml", has("path LIKE '%.ipynb'")))
    out.append(signal("file-pattern", "'.proto files'", 0.7, "microservices", has("path LIKE '%.proto'")))
    rows = ", ".join(f"('{lang}', '{n}')" for lang, names in ar.MAIN_FILES.items() for n in names)
    main = f"""SELECT l.repo_id, bool_or({any_like('lower(f.content)', ar.HTTP_TEXTS)}) AS http, bool_or({any_like('lower(f.content)', ar.CLI_TEXTS)}) AS cli FROM lang l JOIN (VALUES {rows}) x(language, name) ON x.language = l.language
      JOIN v_file f ON f.repo_id = l.repo_id AND (f.path = x.name OR (f.path = 'cmd/' || x.name AND NOT EXISTS (SELECT 1 FROM v_file g WHERE g.repo_id = l.repo_id AND g.path = x.name))) GROUP BY l.repo_id"""
    out.append(signal("code-pattern", "'HTTP server code'", 0.6, "api-service", f"SELECT * FROM ({main}) WHERE http AND NOT cli"))
    out.append(signal("code-pattern", "'CLI parser code'", 0.7, "cli", f"SELECT * FROM ({main}) WHERE cli AND NOT http"))
    out.append(signal("config", "'serverless Makefile targets'", 0.6, "serverless", has("path = 'Makefile' AND content LIKE '%deploy-lambda%'")))
    out.append(signal("config", "'CI/CD patterns'", 0.5, "microservices", has("path LIKE '.github/workflows/%' AND content LIKE '%docker/build-push-action%' AND len(string_split(content, 'docker build')) > 3")))
    out.append(signal("config", "'CI/CD patterns'", 0.7, "serverless", has("path LIKE '.github/workflows/%' AND content LIKE '%serverless deploy%'")))
    return ", ".join(f"s{i} AS (SELECT {i} AS o, * FROM ({x}))" for i, x in enumerate(out)) + ", sig AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(out))) + ")"


MAN = "man AS MATERIALIZED (SELECT l.repo_id, lower(arg_min(f.content, x.rank)) AS mtext FROM lang l JOIN (VALUES " + ", ".join(
    f"('{lang}', '{n}', {i})" for lang, names in ar.SIGNAL_MANIFESTS.items() for i, n in enumerate(names)) + ") x(language, name, rank) ON x.language = l.language JOIN v_file f ON f.repo_id = l.repo_id AND f.path = x.name GROUP BY l.repo_id)"
COMP = """comp AS MATERIALIZED (SELECT repo_id, len([x for x in string_split(split_part(content, 'services:', 2), chr(10)) if ends_with(trim(x), ':')]) AS n FROM v_file WHERE path IN ('docker-compose.yml', 'docker-compose.yaml')
   QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path DESC) = 1)"""
SIG = FRAME + ",\n" + MAN + ",\n" + COMP + ",\n" + _signals()
ORDER = "CASE arch_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(ar.NAMES)) + " END"
NAME = "CASE p " + " ".join(f"WHEN '{k}' THEN {q(x)}" for k, x in ar.NAMES.items()) + " END"
PROFILE = SIG + f""",
vt AS MATERIALIZED (SELECT repo_id, arch_type, round(sum(weight), 9) AS vote, {ORDER} AS o FROM sig GROUP BY repo_id, arch_type),
pr AS MATERIALIZED (SELECT fw.*, CASE WHEN (SELECT max(vote) FROM vt WHERE vt.repo_id = fw.repo_id) >= 0.5 THEN (SELECT arch_type FROM vt WHERE vt.repo_id = fw.repo_id ORDER BY vote DESC, o LIMIT 1) WHEN EXISTS (SELECT 1 FROM vt WHERE vt.repo_id = fw.repo_id AND arch_type = 'api-service') THEN 'monolith' ELSE 'unknown' END AS p FROM fw),
ft AS (SELECT repo_id, list(evidence ORDER BY o) AS f FROM (SELECT repo_id, evidence, min(o) AS o FROM sig WHERE type = 'dependency' AND weight >= 0.7 GROUP BY ALL) GROUP BY repo_id),
px AS MATERIALIZED (SELECT pr.repo_id, p, coalesce((SELECT string_agg(arch_type, ',' ORDER BY vote DESC, o) FROM vt WHERE vt.repo_id = pr.repo_id AND arch_type <> p AND vote >= 0.4), '') AS sec,
   CAST(coalesce(round((SELECT sum(vote) FILTER (WHERE arch_type = p) / sum(vote) FROM vt WHERE vt.repo_id = pr.repo_id), 6), 0) AS DOUBLE) AS confidence,
   CASE WHEN language = 'unknown' THEN '' ELSE language || ' ' END || {NAME} || CASE WHEN framework IN ('unknown', 'stdlib') THEN '' ELSE ' using ' || framework END || coalesce(' with ' || CASE len(f) WHEN 1 THEN f[1] WHEN 2 THEN f[1] || ' and ' || f[2] ELSE f[1] || ', ' || f[2] || 'and ' || f[3] END || CASE WHEN len(f) > 3 THEN ' and more' ELSE '' END, '') AS description
   FROM pr LEFT JOIN ft ON ft.repo_id = pr.repo_id)"""
ADJ = "adj(a, n, controls, recs, mult) AS (VALUES " + ", ".join(f"('{k}', {len(v[0])}, {q(';'.join(v[3]))}, {q(';'.join(v[2]))}, {sum(v[1].values())})" for k, v in ar.ADJUSTMENTS.items()) + ")"

SQL = {
    "repository_names": ask("repository", "SELECT repo_id, regexp_replace(string_split(url, '/')[-1], '\\.git$', '') AS name, right(url, 20) AS short_id FROM v_repository"),
    "repository_languages": ask("file", LANG + " SELECT repo_id, language FROM lang"),
    "repository_frameworks": ask("file", FRAME + " SELECT repo_id, language, framework FROM fw"),
    "dependencies_parsed": ask("file", DEPS + " SELECT dp.repo_id, name, version FROM dp WHERE rank = (SELECT min(rank) FROM dp x WHERE x.repo_id = dp.repo_id)"),
    "architecture_signals": ask("file", SIG + " SELECT repo_id, type, evidence, weight, arch_type FROM sig"),
    "architecture_profiles": ask("file", PROFILE + ' SELECT repo_id, p AS "primary", sec AS secondary, confidence, description FROM px'),
    "architecture_adjustments": ask("file", PROFILE + ",\n" + ADJ + """ SELECT repo_id, CAST(coalesce(n, 0) + len([x for x in string_split(sec, ',') if x IN ('ai-ml', 'data-pipeline')]) AS BIGINT) AS n_threats, coalesce(controls, '') AS controls, coalesce(recs, '') AS recommendations,
        CAST(round(mult, 6) AS DOUBLE) AS multiplier_sum FROM px LEFT JOIN adj ON adj.a = px.p"""),
}
