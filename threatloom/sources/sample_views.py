"""Adapters that derive engine tables from the TPC-H-like sample tables.

The sample data holds no source code or threat tables, so each engine input is
derived row by row from a sample table.  The bodies below are plain SELECTs in
the subset of SQL that Spark and DuckDB share: ``@name`` marks a base table.
They only shape inputs; no operator logic lives here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSET = """
SELECT repo_id, ord, type || '-' || file || '-' || CAST(line AS STRING) AS id, type, name, file, line,
       description, sensitive, exposed, tags
FROM (
  SELECT repo_id, ord, type, file, line, sensitive, type = 'api' AS exposed,
    CASE type
      WHEN 'api' THEN CASE WHEN v = 6 THEN 'unknown' ELSE '/v1/items/' || CAST(pk % 50 AS STRING) END
      WHEN 'database' THEN split_part('Database Query (SELECT)|Database Insert|Database Update|Database Delete|Database Connection|Database Operation|Database Query (SELECT)', '|', v + 1)
      WHEN 'authentication' THEN split_part('JWT Authentication|OAuth Authentication|Session Management|Authentication|Session cookie|Password Hashing (bcrypt)|Authentication', '|', v + 1)
      WHEN 'secret' THEN 'Secret: ' || split_part('password|token|api_key|secret|client_secret|credentials|pwd', '|', v + 1)
      WHEN 'filesystem' THEN 'File Operation'
      WHEN 'network' THEN 'External API Call'
      WHEN 'cryptography' THEN 'Cryptographic Operation'
      WHEN 'cache' THEN 'Cache Operation'
      ELSE 'Message Queue: ' || split_part('kafka|sqs|sns|pubsub|amqp|kafka|eventbus', '|', v + 1) END AS name,
    CASE type
      WHEN 'api' THEN split_part('HTTP endpoint: router.GET handler|HTTP endpoint: openai proxy|HTTP endpoint: load plugin|HTTP endpoint: grpc gateway|HTTP endpoint: app.post|HTTP endpoint: Route(list)|HTTP endpoint: websocket upgrade', '|', v + 1)
      WHEN 'database' THEN split_part('Database operation: db.Query("SELECT 1 WHERE id=" + id)|Database operation: stmt.Exec(args)|Database operation: fmt.Sprintf("DELETE")|Database operation: gorm.Save|Database operation: concat(a, b)|Database operation: sqlx.Get|Database operation: db.Prepare', '|', v + 1)
      WHEN 'authentication' THEN split_part('Authentication: jwt.verify|Authentication: save to localStorage|Authentication: session.get|Authentication: passport|Authentication: set it|Authentication: bcrypt|Authentication: oauth2', '|', v + 1)
      WHEN 'network' THEN split_part('External call: http.Get("http://a")|External call: http.Get("https://a")|External call: insecure client|External call: skip tls verify|External call: axios.get|External call: skip it|External call: fetch', '|', v + 1)
      WHEN 'secret' THEN 'Potential secret: value'
      WHEN 'cache' THEN ''
      ELSE 'Operation on ' || type END AS description,
    CASE WHEN type = 'api' THEN 'http,endpoint,api' WHEN type = 'secret' THEN 'secret,credential' ELSE type || ',code' END AS tags
  FROM (
    SELECT 'repo-' || CAST(l_suppkey AS STRING) AS repo_id,
      CAST(CAST(l_orderkey * 8 + l_linenumber AS DECIMAL(38,0)) * 1000000000000 + l_partkey AS DECIMAL(38,0)) AS ord,
      split_part('api|database|authentication|secret|filesystem|network|cryptography|cache|queue', '|', CAST((l_orderkey + 3 * l_linenumber + l_partkey) % 9 AS INT) + 1) AS type,
      'svc' || CAST(l_partkey % 3 AS STRING) || '/' || CASE WHEN l_partkey % 60 = 0 THEN 'config' ELSE 'mod' END
        || CAST(l_partkey % 20 AS STRING) || CASE WHEN l_partkey % 41 = 3 THEN '.env.js' ELSE '.go' END AS file,
      CAST(l_orderkey % 400 + 1 AS BIGINT) AS line, CAST(l_partkey % 7 AS INT) AS v, l_partkey AS pk,
      l_returnflag = 'R' AS sensitive
    FROM @lineitem) a0 ) a1
"""

LINE = """
SELECT 'repo-' || CAST(l_suppkey AS STRING) AS repo_id,
  'svc' || CAST(l_partkey % 3 AS STRING) || '/' || CASE WHEN l_partkey % 41 = 3 THEN '.env.local.js' ELSE 'mod' || CAST(l_partkey % 20 AS STRING) || '.go' END AS file,
  CAST(CAST(l_orderkey * 8 + l_linenumber AS DECIMAL(38,0)) * 1000000000000 + l_partkey AS DECIMAL(38,0)) AS ord,
  CAST(l_orderkey % 400 AS BIGINT) AS line_no,
  replace(split_part('  router.GET("/v1/items/#", handler)~app.post(''/login/#'', auth.Authenticate)~rows := db.Query("SELECT * FROM t" + id)~cursor.execute("INSERT INTO logs VALUES (#)")~token := jwt.sign(claims)~f, err := os.Open(path#)~multipart upload(write)~resp := http.Get("http://svc/#")~key := os.Getenv("API_KEY_#")~password = "hunter#"~kafka.produce(topic#)~redis.get(k#)~cipher := aes.Encrypt(data)~// router.GET("/x")~  # note password = x~~return nil~x := hash(password): y~@app.route(''/admin/#'')~passport.use(oauth)~client_secret: value#~sns.publish(msg)~@Cacheable(name)~fetch(url, credential)~UPDATE users SET a = #~session.get(id)~process.env.TOKEN~conn = psycopg2.connect(dsn)~`/raw/path` Route(x)~func main() ~FOO_#=bar=baz~print(total)', '~', CAST((l_orderkey + 3 * l_linenumber + l_partkey) % 32 AS INT) + 1), '#', CAST(l_partkey % 50 AS STRING)) AS line
FROM @lineitem
"""

THREAT = """
SELECT repo_id, ord, id,
  CASE WHEN k % 25 = 7 THEN '' ELSE split_part('Unauthenticated API Endpoint|Potential SQL Injection|Hardcoded Credential Detected|Insecure External API Call|Path Traversal Risk|Cryptographic Error Leakage|Insecure Token Storage|Sensitive Data Exposure|Unvalidated Trust Boundary Crossing|Authentication Data in Cleartext|Prompt Injection Risk|Tool Poisoning Risk|Audit log tampering|Denial of service by regex flood|Privilege escalation via sudo|Ransomware persistence implant', '|', CAST(k % 16 AS INT) + 1) END AS title,
  CASE WHEN k % 25 = 7 AND k % 2 = 0 THEN '' ELSE split_part('Database credential handling at module (legacy) path|API endpoint may lack authentication checks (see notes)|Secret token exposed in clear text|Lateral movement over the internal network with credential reuse|Operation may leak errors and sensitive data to the caller while the session token stays valid for every other login', '|', CAST(k % 5 AS INT) + 1) END AS description,
  CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN k % 9 = 8 THEN NULL ELSE split_part('S|T|R|I|D|E|L|M', '|', CAST(k % 9 AS INT) + 1) END AS stride_primary,
  CASE WHEN k % 9 = 8 OR k % 3 = 0 THEN NULL ELSE split_part('E|I|S|T|M|D|R|L', '|', CAST(k % 9 AS INT) + 1) END AS stride_second,
  0.5 + CAST(k % 5 AS DOUBLE) / 10 AS conf_primary, 0.3 + CAST(k % 4 AS DOUBLE) / 10 AS conf_second,
  split_part('active|weaponized|poc_public|theoretical|unknown', '|', CAST(user_id % 5 AS INT) + 1) AS exploitation_status,
  split_part('internet|internal|isolated|other', '|', CAST(k % 4 AS INT) + 1) AS exposure_level,
  split_part('low|medium|high|other', '|', CAST((user_id + k) % 4 AS INT) + 1) AS attack_complexity,
  k % 2 = 0 AS affects_known_assets, ts AS discovered_at,
  CASE k % 4 WHEN 0 THEN 'Code-Analysis,' || event_type || ',API' WHEN 1 THEN 'CVE,nvd' WHEN 2 THEN 'Dataflow,' || event_type ELSE '' END AS tags,
  CASE WHEN k % 4 = 1 THEN 'CVE-2024-' || CAST(1000 + k % 12 AS STRING) ELSE '' END AS cve_ids,
  CASE k % 4 WHEN 0 THEN '/v1/items/' || CAST(k % 10 AS STRING) WHEN 1 THEN split_part('ring|widget|bolt|gear', '|', CAST(floor((k % 16) / 4) AS INT) + 1) WHEN 2 THEN split_part('user_data|forwarded_request', '|', CAST(k % 2 AS INT) + 1) || ',' || event_type ELSE '' END AS indicator_values,
  CASE k % 4 WHEN 1 THEN 'cve' ELSE 'attack_pattern' END AS indicator_type,
  event_type AS source_feeds, k = 13 AS false_positive, CAST(k % 3 AS BIGINT) AS instance_count,
  CASE WHEN k % 6 = 5 THEN '' ELSE split_part('Rotate all exposed credentials|Use HTTPS for all external API calls|Review access control policies for this endpoint|Sign all code and data|Enable audit logs', '|', CAST(k % 5 AS INT) + 1) || ';Monitor ' || event_type END AS recommended
FROM (SELECT 'repo-' || CAST(user_id AS STRING) AS repo_id, event_id AS ord, 'threat-' || CAST(event_id AS STRING) AS id,
        CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, user_id, event_type, value, ts FROM @events) t0
"""

FINDING = """
SELECT 'repo-' || CAST(user_id AS STRING) AS repo_id, event_id AS ord,
  split_part('python.sqli.raw-query|go.hardcoded-credential|pci-cardholder-pan-detected|pci-auth-missing|js.llm.prompt-use|generic.crypto.md5|pci-logging-gap|pci-crypto-weak|java.sql-injection.jdbc|generic.container.root', '|', CAST(k % 10 AS INT) + 1) AS check_id,
  'svc' || CAST(user_id % 3 AS STRING) || '/f' || CAST(k AS STRING) || '.py' AS path, k + 1 AS start_line,
  split_part('SQL injection through string concatenation|Hardcoded password in code|Prompt injection in the LLM agent call|Missing authentication for admin endpoint|Use of weak crypto md5 hash|Session token written to logs|Container runs as root with docker resource limits missing|Card number kept in plaintext|Unsafe deserialization of user input|AI credential token leak', '|', CAST((k + user_id) % 10 AS INT) + 1) AS message,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'OTHER' ELSE 'INFO' END AS severity,
  CASE k % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'LOW' ELSE '' END AS confidence,
  CASE WHEN k % 3 = 0 THEN 'security' ELSE '' END AS category,
  CASE k % 8 WHEN 0 THEN 'CWE-89: SQL Injection' WHEN 1 THEN 'CWE-798,CWE-259' WHEN 2 THEN '327' WHEN 3 THEN 'CWE-284,bad' WHEN 4 THEN 'CWE-532' WHEN 5 THEN 'CWE-778' WHEN 6 THEN 'CWE-94,CWE-200' ELSE '' END AS cwe,
  CASE WHEN k % 4 = 0 THEN 'Injection' WHEN k % 4 = 1 THEN 'Improper Authentication,Access Control' ELSE '' END AS vulnerability_class,
  CASE k % 4 WHEN 0 THEN '"Other syntax error"' WHEN 1 THEN '["PartialParsing", 3]' WHEN 2 THEN '[1, 2]' ELSE NULL END AS error_type
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM @events) f0
"""

CVE = """
SELECT 'CVE-2024-' || CAST(10000 + p_partkey AS STRING) AS cve_id, p_partkey AS ord, p_name AS product,
  CASE WHEN p_partkey % 9 = 4 THEN '' ELSE 'Product ' || p_name || ' of ' || p_brand || ' ' || split_part('allows sql injection through the login form|exposes credentials and secrets in log output, so that any local user with read access can collect them later|has an authentication bypass with a forged token in the session|lets a remote attacker flood memory and cpu (denial of service)|permits privilege escalation to root via setuid|stores a backdoor for command and control|writes audit logging data with a wrong timestamp|allows lateral movement over smb and rdp', '|', CAST(p_partkey % 8 AS INT) + 1) END AS description_en,
  'Produit ' || p_name AS description_fr,
  CASE WHEN p_partkey % 13 = 5 THEN '' WHEN p_partkey % 13 = 6 THEN 'not a time' ELSE '2024-01-' || lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0') || 'T00:00:00Z' END AS published,
  CASE WHEN p_partkey % 11 = 3 THEN '' ELSE 'CVSS:3.1/AV:' || split_part('N|A|L|P', '|', CAST(p_size % 4 AS INT) + 1) || '/AC:' || split_part('L|H', '|', CAST(p_partkey % 2 AS INT) + 1) || '/PR:' || split_part('N|L|H', '|', CAST(p_size % 3 AS INT) + 1) || '/UI:' || split_part('N|R', '|', CAST(p_size % 2 AS INT) + 1) || CASE WHEN p_partkey % 17 = 2 THEN '/AV:L' ELSE '' END END AS vector,
  split_part('CRITICAL|HIGH|MEDIUM|LOW|NONE|', '|', CAST(p_partkey % 6 AS INT) + 1) AS base_severity,
  split_part('CWE-89|NVD-CWE-Other|CWE-287 and CWE-20|CWE-400|CWE-269|CWE-506|CWE-778|CWE-653', '|', CAST(p_partkey % 8 AS INT) + 1) || CASE WHEN p_partkey % 5 = 0 THEN ';CWE-200' ELSE '' END AS weaknesses,
  'https://example.org/' || CAST(p_partkey AS STRING) AS reference
FROM @part
"""

DEPENDENCY = """
SELECT 'repo-' || CAST(p_partkey % 100 AS STRING) AS repo_id, scan_id, p_partkey * 2 + d AS ord,
  p_name || CASE WHEN p_partkey % 3 = 0 THEN '-core' ELSE '' END AS name,
  CAST(p_size + CASE WHEN d = 1 AND p_partkey % 5 = 0 THEN 1 ELSE 0 END AS STRING) AS version
FROM (SELECT *, 'base' AS scan_id, 0 AS d FROM @part WHERE p_size > 5
      UNION ALL SELECT *, 'head' AS scan_id, 1 AS d FROM @part WHERE p_size < 45) d0
"""

FILE = """
SELECT repo_id, path,
  CASE
    WHEN path = 'go.mod' THEN replace('module svc;require (;  github.com/gin-gonic/gin v1.9.1;  // note v0;  google.golang.org/grpc v1.6' || CAST(s % 10 AS STRING) || ' // indirect;  bad;);replace x => y', ';', chr(10))
    WHEN path = 'requirements.txt' AND s % 20 = 11 THEN replace('# nothing pinned;;', ';', chr(10))
    WHEN path = 'requirements.txt' THEN replace('# deps;flask==2.' || CAST(s % 7 AS STRING) || ';openai>=1.0;pandas~=2.1;celery; numpy < 2 ;torch>1,<3', ';', chr(10))
    WHEN path = 'Pipfile' THEN replace('[[source]];url = "x";[packages];django = "==4.' || CAST(s % 5 AS STRING) || '";requests = ''*'';[dev-packages];pytest = "*"', ';', chr(10))
    WHEN path = 'package.json' THEN replace('{;"name": "web",;"dependencies": {;  "express": "^4.1' || CAST(s % 9 AS STRING) || '",;  "react": "~18.2";},;"devDependencies": {;  "jest": "^29.0";};}', ';', chr(10))
    WHEN path = 'Gemfile' THEN replace('source ''https://rubygems.org'';gem ''rails'', ''~> 7.' || CAST(s % 4 AS STRING) || ''';gem ''sidekiq'';# gem ''x''', ';', chr(10))
    WHEN path = 'pom.xml' AND s % 20 = 15 THEN replace('<project>;<version>1</version>;</project>', ';', chr(10))
    WHEN path = 'pom.xml' THEN replace('<project>;<version>1</version>;<dependency>;<groupId>org.springframework</groupId>;<artifactId>spring-core</artifactId>;<version>6.' || CAST(s % 3 AS STRING) || '</version>;</dependency>;<dependency>;<artifactId>kafka-clients</artifactId>;</dependency>;<dependency><artifactId>one-line</artifactId></dependency>;</project>', ';', chr(10))
    WHEN path = 'build.gradle' THEN replace('dependencies {;  implementation ''org.springframework.boot:spring-boot:3.' || CAST(s % 4 AS STRING) || ''';  api "com.example:util";  testImplementation ''x:y:1'';  compileOnly "single";}', ';', chr(10))
    WHEN path = 'Cargo.toml' THEN replace('[package];name = "x";[dependencies];clap = "4.' || CAST(s % 5 AS STRING) || '";serde = { version = "1.0" };[dev-dependencies];rand = "0.8"', ';', chr(10))
    WHEN path LIKE 'docker-compose%' THEN replace('version: "3";services:;  web:;    image: a;  db:;    image: b' || CASE WHEN s % 2 = 0 THEN ';  cache:;    image: c' ELSE '' END, ';', chr(10))
    WHEN path LIKE 'terraform/%' THEN CASE WHEN s % 2 = 0 THEN 'resource "aws_lambda_function" "f" {}' ELSE 'resource "aws_vpc" "v" {}' END
    WHEN path = 'Makefile' THEN CASE WHEN s % 3 = 0 THEN 'deploy-lambda:' ELSE 'build:' END
    WHEN path LIKE '.github/%' THEN CASE WHEN s % 3 = 0 THEN 'uses: docker/build-push-action docker build a docker build b docker build c' WHEN s % 3 = 1 THEN 'run: serverless deploy' ELSE 'run: make' END
    WHEN path IN ('main.go', 'cmd/api/main.go') THEN CASE WHEN s % 2 = 0 THEN 'http.ListenAndServe(":80", nil)' ELSE 'flag.Parse()' END
    WHEN path IN ('app.py', 'main.py') THEN CASE WHEN s % 2 = 0 THEN 'app.run()' ELSE 'argparse.ArgumentParser()' END
    WHEN path IN ('index.js', 'server.js', 'cmd/server.js') THEN 'app.listen(80)'
    ELSE 'x' END AS content
FROM (
  SELECT DISTINCT 'repo-' || CAST(l_suppkey AS STRING) AS repo_id, l_suppkey AS s,
    split_part('main.go~cmd/api/main.go~tools/cmd/run.go~services/user/app.py~pkg/core/core.go~lambda/handler.py~frontend/index.js~dags/daily.py~models/net.py~training/train.py~notebooks/a.ipynb~Dockerfile~svc1/Dockerfile~svc2/api.Dockerfile~docker-compose.yml~k8s/deploy.yaml~serverless.yml~terraform/main.tf~proto/api.proto~Makefile~.github/workflows/ci.yml~app.py~index.js~cmd/server.js~vendor/lib/x.go~node_modules/a/index.js~web/ui.ts~data/readme.md~lib/util.rb~main.py~.hidden/secret.py~src/Main.java~docker-compose.yaml~functions/f.js~etl/job.py~helm/chart.yaml~firebase.json~public/site.css~tsconfig.json~server.js', '~', CAST((l_suppkey * 7 + (l_partkey % 9) * (1 + l_suppkey % 4)) % 40 AS INT) + 1) AS path
  FROM @lineitem
  UNION
  SELECT DISTINCT 'repo-' || CAST(l_suppkey AS STRING) AS repo_id, l_suppkey AS s,
    split_part('go.mod~requirements.txt~Pipfile~package.json~Gemfile~pom.xml~build.gradle~Cargo.toml~composer.json~none.txt', '~', CAST((l_suppkey + CASE WHEN l_suppkey % 10 IN (1, 5) THEN l_linenumber % 2 ELSE 0 END) % 10 AS INT) + 1) AS path
  FROM @lineitem
) f0
"""

REPOSITORY = """
SELECT 'repo-' || CAST(s_suppkey AS STRING) AS repo_id, 'https://git.example.org/team' || CAST(s_suppkey % 7 AS STRING) || '/' || replace(s_name, '#', '-') || CASE WHEN s_suppkey % 2 = 0 THEN '.git' ELSE '' END AS url,
  split_part('go|python|javascript|typescript|java|ruby|rust|', '|', CAST(s_suppkey % 8 AS INT) + 1) AS language,
  split_part('gin|flask|express|agent-langchain|spring|unknown|stdlib', '|', CAST(s_suppkey % 7 AS INT) + 1) AS framework,
  split_part('gpt-4,pinecone|langchain,docker|claude api,aws|mcp plugin,vector store|postgres', '|', CAST(s_suppkey % 5 AS INT) + 1) AS technologies,
  split_part('cloud|on-prem|hybrid|edge', '|', CAST(s_suppkey % 4 AS INT) + 1) AS deployment_model,
  s_suppkey % 3 = 0 AS has_rag, s_suppkey % 4 = 1 AS has_tool_calling, s_suppkey % 6 = 2 AS has_multi_agent,
  split_part('agent workflow with tool calling and memory|customer portal with audit compliance logging for gdpr|rag poisoning test bed with vector database and embedding index|docker kubernetes deployment pipeline with resource exhaustion (dos) limits|plain storefront', '|', CAST(s_suppkey % 5 AS INT) + 1) AS description,
  split_part('89,94|798|400,502|778|', '|', CAST(s_suppkey % 5 AS INT) + 1) AS cwe_ids
FROM @supplier
"""

BASES = {
    "asset": ASSET, "code_line": LINE, "threat": THREAT, "finding": FINDING, "cve": CVE,
    "dependency": DEPENDENCY, "file": FILE, "repository": REPOSITORY,
}


def sql_for_spark(spark: SparkSession, name: str, sf_dir: str) -> str:
    text = BASES[name]
    for table in ("lineitem", "events", "part", "supplier"):
        if f"@{table}" in text:
            text = text.replace(f"@{table}", dealt(spark, f"{sf_dir}/{table}.parquet"))
    return text


def dealt(spark: SparkSession, path: str) -> str:
    """FROM item of a sample table.  The small samples are one row group each, which one task would read and shape alone, so such a
    table is dealt out over the session's shuffle partitions.  One whose files already come in shares for all cores is read where it
    lies.  Jobs take tables of their own and do not pass here."""
    if read_in_shares(spark, path):
        return f"(SELECT * FROM parquet.`{path}`)"
    return f"(SELECT /*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}) */ * FROM parquet.`{path}`)"


# How the tables of a session come, by session and path: it decides where rows are read, never which.
_SHARES: dict[tuple[str, str], bool] = {}


def read_in_shares(spark: SparkSession, path: str) -> bool:
    """Whether no task that reads the table gets more than twice the share of a core."""
    context = spark.sparkContext
    key = (context.applicationId, path)
    if key not in _SHARES:
        tasks = spark.read.parquet(path).groupBy("_metadata.file_path", "_metadata.file_block_start").agg(F.count(F.lit(1)).alias("n"))
        seen = tasks.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
        _SHARES[key] = bool(seen.rows) and seen.largest * context.defaultParallelism <= 2 * seen.rows
    return _SHARES[key]


def sql_for_check(name: str) -> str:
    """The same SELECT over the pre-registered views, for the SQL check."""
    text = BASES[name].replace("AS STRING", "AS VARCHAR").replace("AS DECIMAL(38,0)", "AS HUGEINT")
    for table in ("lineitem", "events", "part", "supplier"):
        text = text.replace(f"@{table}", table)
    return text


def _items(column: str, separator: str = ","):
    """Delimited text to an array without empty items."""
    return F.filter(F.split(column, separator), lambda item: item != "")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for_spark(spark, "asset", sf_dir)).withColumn("tags", _items("tags"))


def asset_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of every repository, in one pass: the line status tells the scan."""
    body = ASSET.replace("@lineitem", dealt(spark, f"{sf_dir}/lineitem.parquet"))
    for before, after in (
        ("sensitive, exposed, tags\nFROM", "sensitive, exposed, tags, scan_id\nFROM"),
        ("  SELECT repo_id, ord, type,", "  SELECT scan_id, repo_id, ord, type,"),
        ("    SELECT 'repo-'", "    SELECT CASE l_linestatus WHEN 'F' THEN 'base' WHEN 'O' THEN 'head' END AS scan_id, 'repo-'"),
    ):
        body = body.replace(before, after)
    return spark.sql(body).where(F.col("scan_id").isNotNull()).withColumn("tags", _items("tags"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for_spark(spark, "code_line", sf_dir))


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.sql(sql_for_spark(spark, "threat", sf_dir))
    has_second = F.col("stride_second").isNotNull()
    scores = F.when(
        has_second,
        F.map_from_arrays(F.array("stride_primary", "stride_second"), F.array("conf_primary", "conf_second")),
    ).when(
        F.col("stride_primary").isNotNull(),
        F.map_from_arrays(F.array("stride_primary"), F.array("conf_primary")),
    )
    indicator = lambda value: F.struct(
        F.col("indicator_type").alias("type"), value.alias("value"), F.lit(0.85).alias("confidence")
    )
    return (
        flat.withColumn("stride_secondary", F.array_compact(F.array("stride_second")))
        .withColumn("stride_scores", scores)
        .withColumn("indicators", F.transform(_items("indicator_values"), indicator))
        .withColumn("tags", _items("tags"))
        .withColumn("cve_ids", _items("cve_ids"))
        .withColumn("source_feeds", _items("source_feeds"))
        .withColumn("recommended", _items("recommended", ";"))
        .withColumn("discovered_at", F.col("discovered_at").cast("timestamp"))
        .drop("stride_second", "conf_primary", "conf_second", "indicator_values", "indicator_type")
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.sql(sql_for_spark(spark, "finding", sf_dir))
    return flat.withColumn("cwe", _items("cwe")).withColumn("vulnerability_class", _items("vulnerability_class"))


def cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVE records in the nested feed shape."""
    flat = spark.sql(sql_for_spark(spark, "cve", sf_dir))
    text = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    weakness = lambda value: F.struct(F.array(text("en", value)).alias("description"))
    return flat.select(
        "ord",
        F.struct(
            F.col("cve_id").alias("id"),
            F.when(
                F.col("description_en") == "", F.array(text("fr", F.col("description_fr")))
            ).otherwise(
                F.array(text("fr", F.col("description_fr")), text("en", F.col("description_en")))
            ).alias("descriptions"),
            F.col("published"),
            F.array(F.struct(F.col("reference").alias("url"))).alias("references"),
            F.transform(F.split("weaknesses", ";"), weakness).alias("weaknesses"),
        ).alias("cve"),
        F.struct(
            F.array(
                F.struct(
                    F.struct(
                        F.col("base_severity").alias("baseSeverity"), F.col("vector").alias("vectorString")
                    ).alias("cvssData")
                )
            ).alias("cvssMetricV31")
        ).alias("metrics"),
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for_spark(spark, "dependency", sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql_for_spark(spark, "file", sf_dir))


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.sql(sql_for_spark(spark, "repository", sf_dir))
    return flat.withColumn("technologies", _items("technologies")).withColumn(
        "cwe_ids", F.transform(_items("cwe_ids"), lambda c: c.cast("int"))
    )
