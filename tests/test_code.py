import random

import pytest
from helpers import AS_OF, asset, assets
from pyspark.sql import functions as F
from threatloom.catalogs import code
from threatloom.operators import assets as a
from threatloom.operators import flows as fl
from threatloom.operators import rules as r


def lines(spark, *texts, file="m.go"):
    rows = [("r", i, file, i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "repo_id string, ord bigint, file string, line_no int, line string")


def test_line_scan_finds_one_asset_per_family(spark):
    rows = a.detect_assets(lines(spark, '  router.GET("/v1/users", h)', "// router.GET(x)", "", "# password = x",
                                 'password = os.Getenv("KEY")', "redis.publish(kafka)")).orderBy("ord").collect()
    assert [(x.type, x.name, x.line) for x in rows] == [
        ("api", "/v1/users", 1), ("secret", "ENV: KEY", 5), ("secret", "Secret: password", 5),
        ("queue", "Message Queue: kafka", 6), ("cache", "Cache Operation", 6)]
    assert rows[0].exposed and rows[0].id == "api-m.go-0"


def test_env_files_give_key_rows(spark):
    rows = a.detect_assets(lines(spark, "FOO = a=b", "#X=1", "nothing", file="conf/.env.local.js")).collect()
    assert [(x.id, x.name) for x in rows] == [("envvar-conf/.env.local.js-FOO", "ENV: FOO")]


@pytest.mark.parametrize("path, kept", [
    ("a/b.go", True), ("a.b/c.py", True), (".git/x.go", False), ("a/vendor/x.go", False), ("node_modules/x.js", False),
    ("a/.hidden.go", True), ("x.md", False), ("a.gox", False), ("a/x.h", True)])
def test_code_paths(spark, path, kept):
    df = spark.createDataFrame([("r", path, "")], "repo_id string, path string, content string")
    assert a.code_files(df).count() == int(kept)


def test_code_rules_of_a_small_service(spark):
    rows = assets(
        spark, asset(1, "api", "users.go", 42, "/api/users"),
        asset(2, "database", "users.go", 50, "Database Operation", 'db.Query("SELECT " + id)', True),
        asset(3, "secret", "config.go", 10, "Secret: password", "password = x", True))
    found = r.asset_threats(r.asset_rule_hits(rows), AS_OF).collect()
    assert {(t.title, t.severity) for t in found} == {
        ("Unauthenticated API Endpoint", "high"), ("Potential SQL Injection", "critical"),
        ("Hardcoded Credential Detected", "critical")}
    flow_hits = r.flow_rule_counts(fl.line_sites(rows.where("type <> 'secret'"))).collect()
    assert [(h.kind, h.rule, h.n_flows) for h in flow_hits] == [("api-db", 9, 1)]
    threat = r.flow_threats(r.flow_rule_counts(fl.line_sites(rows.where("type <> 'secret'"))), AS_OF).first()
    assert threat.title == "Unvalidated Trust Boundary Crossing" and threat.severity == "medium"


def test_authentication_near_by_guards_an_endpoint(spark):
    rows = assets(spark, asset(1, "api", line=100), asset(2, "authentication", line=149), asset(3, "api", line=199),
                  asset(4, "api", "b.go", 149))
    assert sorted(x.ord for x in r.unguarded_apis(rows).collect()) == [3, 4]


def test_secrets_in_env_files_are_configuration(spark):
    assert r.asset_rule_hits(assets(spark, asset(1, "secret", "conf/.env"))).count() == 0


def test_first_hit_speaks_for_its_line(spark):
    rows = assets(spark, asset(2, "secret", line=5), asset(1, "cryptography", line=5))
    assert [x.rule for x in r.asset_rule_hits(rows).collect()] == [6]


def random_assets(seed, n=120):
    rng = random.Random(seed)
    kinds = ["api", "database", "authentication", "secret", "filesystem", "network", "cryptography", "cache", "queue"]
    # Two thirds of all rows sit in one file of one repository.
    return [asset(i, rng.choice(kinds), "hot.go" if rng.random() < 0.66 else rng.choice(["app/config.go", "b.go", "setup.py"]),
                  rng.randint(1, 160), sensitive=rng.random() < 0.4, repo="r" if rng.random() < 0.8 else "q", id_=f"id{i}")
            for i in range(n)]


def brute_flows(rows):
    """All flows as pairs: (kind, source row, destination row, sensitive)."""
    out = []
    for kind, source, target, *_ in code.FLOW_KINDS:
        for s in rows:
            if not (s[8] and s[3] != "cryptography" if source == "+" else s[3] == source):
                continue
            for d in rows:
                if s[0] != d[0] or not (d[3] != "secret" if target == "*" else d[3] == target):
                    continue
                config = kind == "env-svc" and ("config" in d[5] or "setup" in d[5])
                if s[5] != d[5] and not config:
                    continue
                if kind == "auth-api" and abs(s[6] - d[6]) >= 50:
                    continue
                sensitive = {"api-ext": s[8] or d[8], "db-cache": s[8], "api-queue": s[8]}.get(kind, True)
                out.append((kind, s, d, sensitive))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_factored_flows_equal_all_pairs(spark, seed):
    rows = random_assets(seed)
    df = assets(spark, *rows)
    sites = fl.line_sites(df)
    pairs = brute_flows(rows)
    want, ends = {}, {}
    for kind, s, d, sensitive in pairs:
        key = (s[0], s[5], kind)
        n, m = want.get(key, (0, 0))
        want[key] = (n + 1, m + sensitive)
        for role, end in (("source", s), ("destination", d)):
            ends[(end[0], end[2], kind, role)] = ends.get((end[0], end[2], kind, role), 0) + 1
    assert {(x.repo_id, x.file, x.kind): (x.n_flows, x.n_sensitive) for x in fl.flow_summary(sites).collect()} == want
    got = fl.flow_endpoints(df, sites).collect()
    assert {(x.repo_id, x.id, x.kind, x.role): x.n_flows for x in got} == ends


def test_flow_rules_equal_all_pairs(spark):
    rows = random_assets(3)
    near = lambda e, kind, width: any(x[0] == e[0] and x[5] == e[5] and x[3] == kind and abs(x[6] - e[6]) < width for x in rows)
    want = {}
    for kind, s, d, sensitive in brute_flows(rows):
        rules = []
        if sensitive and near(d, "network", 1):
            rules.append(8)
        if near(s, "api", 10):
            rules.append(9)
        if (near(s, "authentication", 10) or near(d, "authentication", 10)) and not (
                near(s, "cryptography", 20) or near(d, "cryptography", 20)):
            rules.append(10)
        for rule in rules:
            want[(s[0], kind, rule)] = want.get((s[0], kind, rule), 0) + 1
    got = r.flow_rule_counts(fl.line_sites(assets(spark, *rows))).collect()
    assert {(x.repo_id, x.kind, x.rule): x.n_flows for x in got} == want


def test_drill_down_lists_the_flows_of_chosen_assets(spark):
    rows = random_assets(4)
    df = assets(spark, *rows)
    chosen = df.where("type = 'api'").orderBy("id").limit(3)
    names = {x.id for x in chosen.collect()}
    want = sorted(f"flow-api-db-{s[2]}-{d[2]}" for k, s, d, _ in brute_flows(rows) if k == "api-db" and s[2] in names)
    assert sorted(x.id for x in fl.flows_of_assets(df, chosen, "api-db").collect()) == want


def test_card_numbers_in_lines(spark):
    df = spark.createDataFrame([(1, "pay 4111111111111111 now"), (2, "nothing")], "n int, line string")
    assert [x.rule_id for x in a.rule_hits(df).where(F.col("sub_id") == "3.5.1").collect()] == ["pci-pan-hardcoded"]
