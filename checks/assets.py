

from checks import ask
from threatloom.catalogs import code

BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)"
TRIM = f"trim(line, {BLANKS})"
IS_CODE = f"({TRIM} <> '' AND {TRIM} NOT LIKE '//%' AND {TRIM} NOT LIKE '#%')"


def q(text):
    return "'" + text.replace("'", "''") + "'"


def any_like(column, words):
    return "(" + " OR ".join(f"contains({column}, {q(w.lower())})" for w in words) + ")"


def first(column, words):
    return "CASE " + " ".join(f"WHEN contains({column}, {q(w.lower())}) THEN {q(w.lower())}" for w in words) + " END"


def doc_lines(table="documents", key="doc_id", column="text"):
    return (f"lines AS MATERIALIZED (SELECT {key}, unnest(string_split({column}, chr(10))) AS line, "
            f"generate_subscripts(string_split({column}, chr(10)), 1) - 1 AS line_no FROM {table})")


NAMES = {
    "api": "coalesce({0}, 'unknown')".format("coalesce(" + ", ".join(
        f"[x for x in string_split(line, {s}) if starts_with(x, '/')][1]" for s in ("chr(34)", "chr(39)", "chr(96)")) + ")"),
    "db": "CASE WHEN contains(lower(line), 'select') THEN 'Database Query (SELECT)' WHEN contains(lower(line), 'insert') THEN 'Database Insert' WHEN contains(lower(line), 'update') THEN 'Database Update' WHEN contains(lower(line), 'delete') THEN 'Database Delete' WHEN contains(lower(line), 'connect') THEN 'Database Connection' ELSE 'Database Operation' END",
    "auth": "CASE WHEN contains(line, 'jwt') THEN 'JWT Authentication' WHEN contains(line, 'oauth') THEN 'OAuth Authentication' WHEN contains(line, 'bcrypt') THEN 'Password Hashing (bcrypt)' WHEN contains(line, 'session') THEN 'Session Management' ELSE 'Authentication' END",
    "file": "'File Operation'", "extapi": "'External API Call'",
    "env": "CASE WHEN contains(line, chr(34)) THEN 'ENV: ' || string_split(line, chr(34))[2] ELSE 'Environment Variable' END",
    "secret": "'Secret: ' || " + first("lower(line)", code.PATTERNS["secret"]),
    "queue": "'Message Queue: ' || " + first("lower(line)", code.PATTERNS["queue"]),
    "cache": "'Cache Operation'", "crypto": "'Cryptographic Operation'",
}


def detect(source):
    parts = []
    for rank, (family, words) in enumerate(code.PATTERNS.items()):
        kind, prefix, tags = code.FAMILIES[family]
        sensitive = {"api": any_like("lower(line)", code.SENSITIVE_WORDS), "extapi": any_like("lower(line)", code.SENSITIVE_WORDS),
                     "file": any_like("lower(line)", ["upload", "write"]), "queue": "false", "cache": "false"}.get(family, "true")
        extra = " AND (contains(line, '=') OR contains(line, ':'))" if family == "secret" else ""
        parts.append(f"""SELECT repo_id, ord * 16 + {rank} AS ord, '{family}-' || file || '-' || line_no AS id, '{kind}' AS type, {NAMES[family]} AS name,
          file, CAST(line_no + 1 AS BIGINT) AS line, {"''" if prefix is None else q(prefix) + ' || ' + TRIM} AS description, {sensitive} AS sensitive,
          {'true' if family == 'api' else 'false'} AS exposed, {q(','.join(tags))} AS tags FROM {source} WHERE {IS_CODE} AND {any_like('lower(line)', words)}{extra}""")
    key = f"trim(split_part(line, '=', 1), {BLANKS})"
    parts.append(f"""SELECT repo_id, ord * 16 + 10 AS ord, 'envvar-' || file || '-' || {key} AS id, 'secret' AS type, 'ENV: ' || {key} AS name, file,
          CAST(line_no + 1 AS BIGINT) AS line, 'Environment variable: ' || {key} AS description, true AS sensitive, false AS exposed, 'environment,config,secret' AS tags
          FROM {source} WHERE (file LIKE '%.env' OR contains(file, '.env.')) AND contains(line, '=') AND {TRIM} NOT LIKE '#%'""")
    return " UNION ALL ".join(parts)


def hits(source, columns):
    return " UNION ALL ".join(
        f"SELECT {columns}, '{rule}' AS rule_id, '{severity}' AS severity, '{cwe}' AS cwe, '{sub}' AS sub_id FROM {source} WHERE regexp_matches(line, {q(pattern)})"
        for rule, pattern, severity, cwe, sub in code.REGEX_RULES)


SUFFIX = "|".join(code.CODE_SUFFIXES)

# All flows as pairs, by brute force.
UNIQUE = "a AS MATERIALIZED (SELECT * FROM v_asset QUALIFY row_number() OVER (PARTITION BY repo_id, id ORDER BY ord) = 1)"


def _pairs():
    out = []
    for rank, (kind, source, target, data_type, _) in enumerate(code.FLOW_KINDS):
        on = "s.repo_id = t.repo_id AND s.file = t.file"
        where_s = "s.sensitive AND s.type <> 'cryptography'" if source == "+" else f"s.type = '{source}'"
        where_t = "t.type <> 'secret'" if target == "*" else f"t.type = '{target}'"
        if kind == "auth-api":
            on += " AND abs(s.line - t.line) < 50"
        if kind == "env-svc":
            on = "s.repo_id = t.repo_id AND (s.file = t.file OR contains(t.file, 'config') OR contains(t.file, 'setup'))"
        sens = {"api-ext": "s.sensitive OR t.sensitive", "db-cache": "s.sensitive", "api-queue": "s.sensitive"}.get(kind, "true")
        out.append(f"""SELECT s.repo_id, {rank} AS kind_rank, '{kind}' AS kind, '{data_type}' AS data_type, s.id AS src_id, t.id AS dst_id, s.ord AS src_ord, t.ord AS dst_ord,
          s.file AS src_file, s.line AS src_line, t.file AS dst_file, t.line AS dst_line, {sens} AS sensitive FROM a s JOIN a t ON {on} WHERE {where_s} AND {where_t}""")
    return "flow AS MATERIALIZED (" + " UNION ALL ".join(out) + ")"


FLOWS = UNIQUE + ",\n" + _pairs()

SQL = {
    "code_files": ask("file", f"""SELECT repo_id, path FROM v_file WHERE regexp_matches(path, '\\.({SUFFIX})$')
        AND len([d for d in string_split(path, '/')[:-2] if starts_with(d, '.') OR d IN ('vendor', 'node_modules')]) = 0"""),
    "source_lines": "WITH " + doc_lines() + f" SELECT doc_id, line_no, line FROM lines WHERE {IS_CODE}",
    "sensitive_lines": "WITH " + doc_lines() + f" SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {any_like('lower(line)', code.SENSITIVE_WORDS)}) AS n_sensitive FROM lines WHERE {IS_CODE} GROUP BY doc_id",
    "rule_hits_documents": "WITH " + doc_lines() + f", code AS (SELECT * FROM lines WHERE {IS_CODE}) " + hits("code", "doc_id, line_no"),
    "rule_hits_pages": "WITH " + doc_lines("pages", "page_id", "html") + ", h AS (" + hits("lines", "page_id, line_no") + ") SELECT page_id, rule_id, sub_id, count(*) AS n_lines FROM h GROUP BY ALL",
    "assets_detected": ask("code_line", detect("v_code_line")),
    "assets_of_documents": "WITH " + doc_lines() + ", src AS (SELECT CAST(doc_id AS VARCHAR) AS repo_id, 'notes.py' AS file, line_no AS ord, line_no, line FROM lines), r AS (" + detect("src") + ") SELECT repo_id, id, type, name FROM r",
    "assets_rescanned": "WITH " + doc_lines() + ", src AS (SELECT CAST(doc_id AS VARCHAR) AS repo_id, 'notes.py' AS file, line_no AS ord, line_no, line FROM lines), r AS (" + detect("src") + ") SELECT repo_id, id, type, name FROM r",
    "assets_by_type_filter": ask("asset", "SELECT repo_id, CAST(ord AS VARCHAR) AS ord, id, name FROM v_asset WHERE type = 'api'"),
    "flow_summary": ask("asset", FLOWS + " SELECT repo_id, src_file AS file, kind, count(*) AS n_flows, count(*) FILTER (WHERE sensitive) AS n_sensitive FROM flow GROUP BY ALL"),
    "flow_endpoints": ask("asset", FLOWS + """ SELECT repo_id, src_id AS id, kind, 'source' AS role, count(*) AS n_flows FROM flow GROUP BY ALL
        UNION ALL SELECT repo_id, dst_id AS id, kind, 'destination' AS role, count(*) AS n_flows FROM flow GROUP BY ALL"""),
    "line_neighbourhood": ask("asset", """
        n AS (SELECT x.repo_id, x.file, x.line, y.type, abs(x.line - y.line) AS gap FROM (SELECT DISTINCT repo_id, file, line FROM v_asset) x
              JOIN v_asset y ON x.repo_id = y.repo_id AND x.file = y.file)
        SELECT repo_id, file, line, count(*) FILTER (WHERE type = 'authentication' AND gap < 50) AS auth_50, count(*) FILTER (WHERE type = 'api' AND gap < 50) AS api_50,
          count(*) FILTER (WHERE type = 'authentication' AND gap < 10) AS auth_10, count(*) FILTER (WHERE type = 'api' AND gap < 10) AS api_10,
          count(*) FILTER (WHERE type = 'cryptography' AND gap < 20) AS crypto_20 FROM n GROUP BY ALL"""),
}

