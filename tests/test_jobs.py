import json
import subprocess
import sys
from pathlib import Path

import pytest
from helpers import AS_OF, ASSET, asset, threats
from pyspark.sql import functions as F
from threatloom.operators import findings as fi
from threatloom.plans import jobs
from threatloom.sources import files as fs
from threatloom.sources import snapshots as sp

ROOT = Path(__file__).resolve().parents[1]


def tree(tmp_path):
    repo = tmp_path / "trees" / "shop"
    (repo / "vendor").mkdir(parents=True)
    (repo / "users.go").write_text('router.GET("/users", h)\nrows := db.Query("SELECT " + id)\npassword = "x"\nfetch("http://a")\n')
    (repo / "vendor" / "x.go").write_text('router.GET("/no")\n')
    (repo / "notes.md").write_text("router.GET")
    (repo / ".github" / "workflows").mkdir(parents=True)
    (repo / ".github" / "workflows" / "ci.yml").write_text("run: serverless deploy")
    (repo / ".hidden").mkdir()
    (repo / ".hidden" / "go.mod").write_text("module no")
    (repo / "go.mod").write_text("module shop\nrequire (\n github.com/gin-gonic/gin v1.9.1\n)\n")
    (tmp_path / "trees" / "empty").mkdir()
    (tmp_path / "trees" / "empty" / "a.c").write_text("int x;\n")
    return str(tmp_path / "trees")


def test_source_tree_to_threat_model(spark, tmp_path):
    files = fs.read_trees(spark, tree(tmp_path))
    assert sorted((r.repo_id, r.path) for r in files.select("repo_id", "path").collect()) == [
        ("empty", "a.c"), ("shop", ".github/workflows/ci.yml"), ("shop", "go.mod"), ("shop", "users.go")]
    out = jobs.scan(files, AS_OF)
    assert {r.repo_id: (r.language, r.framework) for r in out["frameworks"].collect()} == {"shop": ("go", "gin"), "empty": ("unknown", "unknown")}
    assert [r.name for r in out["dependencies"].collect()] == ["github.com/gin-gonic/gin"]
    assert {r.repo_id for r in out["profiles"].collect()} == {r.repo_id for r in out["maestro"].collect()} == {"shop", "empty"}
    assert out["assets"].orderBy("ord").first().file == "users.go"
    titles = {r.title for r in out["threats"].collect()}
    assert {"Unauthenticated API Endpoint", "Potential SQL Injection", "Hardcoded Credential Detected", "Insecure External API Call"} <= titles
    stats = out["stats"].first()
    assert stats.total_assets == out["assets"].count() and stats.total_paths == out["paths"].count() > 0
    assert out["mitigations"].count() > 0 and stats.max_risk > 0
    rows = {r.stage: r.n for r in out["stage_rows"].collect()}
    assert all(rows[name] == out[name].count() for name in ("frameworks", "assets", "sites", "threats", "mapped"))
    assert rows["normalized"] == rows["enriched"] == rows["raw threats"] and rows["filtered"] == rows["threats"] > 0


def test_snapshots_replace_one_partition_and_reject_other_schemas(spark, tmp_path):
    folder = str(tmp_path / "snap")
    rows = spark.createDataFrame([("s1", "r1", 1), ("s1", "r2", 2)], "scan_id string, repo_id string, n int")
    sp.save(rows, folder, "assets")
    sp.save(spark.createDataFrame([("s1", "r2", 9)], rows.schema), folder, "assets")
    back = sp.load(spark, folder, "assets", rows.schema)
    assert sorted((r.repo_id, r.n) for r in back.collect()) == [("r1", 1), ("r2", 9)]
    with pytest.raises(Exception):
        sp.load(spark, folder, "nothing", rows.schema).collect()


def test_scanner_documents(spark, tmp_path):
    doc = {"results": [{"check_id": "c", "path": "a.py", "start": {"line": 7}, "extra": {
        "message": "m", "severity": "ERROR", "metadata": {"confidence": "HIGH", "cwe": ["CWE-89"]}}}],
        "errors": [{"message": "e", "type": ["Partial", 1]}, {"message": "f", "type": "Other"}]}
    (tmp_path / "shop.json").write_text(json.dumps(doc, indent=1))
    row = fs.read_findings(spark, str(tmp_path / "shop.json")).first()
    assert (row.repo_id, row.start_line, row.cwe, row.category) == ("shop", 7, ["CWE-89"], "")
    errors = fs.read_finding_errors(spark, str(tmp_path / "shop.json")).select(fi.error_type(F.col("type")).alias("t"))
    assert [r.t for r in errors.collect()] == ["Partial", "Other"]


def test_unreadable_feed_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"cve": {"id": "CVE-1"}}\n{broken\n')
    rows = fs.read_cves(spark, str(tmp_path / "feed.json")).cache()
    assert [r._corrupt_record for r in rows.where("_corrupt_record is not null").collect()] == ["{broken"]


def test_compliance_job(spark):
    rows = spark.createDataFrame(
        [("r", 1, "x", "a.py", 3, "SQL injection", "ERROR", "HIGH", "", ["CWE-89"], [])],
        "repo_id string, ord bigint, check_id string, path string, start_line bigint, message string, severity string, "
        "confidence string, category string, cwe array<string>, vulnerability_class array<string>")
    out = jobs.compliance_report(rows, AS_OF)
    status = {r.req_id: r.status for r in out["requirements"].collect()}
    assert len(status) == 12 and status["6"] == "Fail" and status["9"] == "Not Tested"
    assert out["gaps"].count() + out["sub_requirements"].where("n_findings > 0").count() == 58


def test_compliance_of_a_repository_without_findings(spark):
    rows = spark.createDataFrame(
        [], "repo_id string, ord bigint, check_id string, path string, start_line bigint, message string, severity string, "
        "confidence string, category string, cwe array<string>, vulnerability_class array<string>")
    out = jobs.compliance_report(rows, AS_OF, spark.createDataFrame([("quiet",)], "repo_id string"))
    assert [r.status for r in out["requirements"].collect()] == ["Not Tested"] * 12 and out["gaps"].count() == 58


def test_comparison_of_scans(spark):
    made = [("base", asset(1, "api", line=3)), ("head", asset(1, "api", line=3)), ("head", asset(2, "secret", file="b.go", name="key"))]
    assets_of = spark.createDataFrame([(*a, scan) for scan, a in made], f"{ASSET}, scan_id string")
    none = threats(spark).withColumns({"priority": F.lit(0.0), "scan_id": F.lit("base")})
    dependencies = spark.createDataFrame([("r", "head", 1, "gin", "1")], "repo_id string, scan_id string, ord bigint, name string, version string")
    out = jobs.compare(assets_of, none, dependencies, spark.createDataFrame([("r",), ("still",)], "repo_id string"))
    summary = {r.repo_id: r for r in out["summary"].collect()}
    assert summary["r"].total_changes == 2 and summary["still"].total_changes == 0 and summary["r"].head_max == 0
    verdicts = {(r.repo_id, r.preset): r.verdict for r in out["verdicts"].collect()}
    assert len(verdicts) == 10 and set(verdicts.values()) == {"PASS"}
    assert out["drift"].count() == 2


def test_named_checkpoint_folder_is_used(tmp_path):
    """In its own process, because a session keeps its first folder."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from threatloom.session import local_session, checkpointed\n"
        "s = local_session('1', 1, spark__checkpoint__dir=sys.argv[2])\n"
        "print('rows', checkpointed(s.range(3)).count())\n"
        "from pathlib import Path; print('stages', len(list(Path(sys.argv[2]).rglob('stage-*'))))\n")
    out = subprocess.run([sys.executable, "-c", script, str(ROOT), str(tmp_path / "shared")], capture_output=True, text=True, timeout=200)
    assert "rows 3" in out.stdout and "stages 1" in out.stdout
