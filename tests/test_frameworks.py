import pytest
from helpers import AS_OF
from pyspark.sql import functions as F
from threatloom.operators import archetypes as at
from threatloom.operators import classify as c
from threatloom.operators import compliance as pc
from threatloom.operators import cves as cv
from threatloom.operators import findings as fi
from threatloom.operators import manifests as mf
from threatloom.operators import techniques as te


def test_tactic_decides_for_spoofing(spark):
    df = spark.createDataFrame([("Credential dumping technique", ["TA0006"])], "t string, ta array<string>")
    assert c.classify_stride(df, F.col("t"), None, F.col("ta")).first().stride_primary == "S"


def test_no_text_means_disclosure_at_half(spark):
    row = c.classify_stride(spark.createDataFrame([("",)], "t string"), F.col("t")).first()
    assert row.stride_primary == "I" and row.stride_scores["I"] == 0.5 and sum(row.stride_scores.values()) == 0.5


def test_word_boundaries_are_ascii(spark):
    df = spark.createDataFrame([(1, "étoken"), (2, "tokens"), (3, "a TOKEN!")], "n int, t string")
    rows = c.classify_stride(df, F.col("t")).orderBy("n").collect()
    assert [r.stride_primary for r in rows] == ["S", "I", "S"]


def test_agent_system_is_a_framework_layer(spark):
    df = spark.createDataFrame([("LangChain agent workflow", ["langchain"], True)], "t string, tech array<string>, a boolean")
    row = c.classify_maestro(df, F.col("t"), F.col("tech"), {"has_agents": F.col("a")}).first()
    assert row.maestro_primary == "3-Frameworks" and row.maestro_scores["3-Frameworks"] == 1.0
    assert row.maestro_threats[0] == "Insecure Tool/Function Calling"


def finding(spark, severity="ERROR", confidence="HIGH", cwe=("CWE-89",), message="SQL injection", check="x"):
    return spark.createDataFrame(
        [("r", 1, check, "a.py", 3, message, severity, confidence, "security", list(cwe), [])],
        "repo_id string, ord bigint, check_id string, path string, start_line bigint, message string, severity string, "
        "confidence string, category string, cwe array<string>, vulnerability_class array<string>")


def test_finding_maps_to_tampering_with_full_confidence(spark):
    row = fi.map_findings(finding(spark)).first()
    assert (row.stride_primary, row.cwe_ids, row.mapping_confidence, row.layer) == ("T", [89], 1.0, "")


def test_error_types_of_all_shapes(spark):
    df = spark.createDataFrame([('"Other"',), ('["Partial", 1]',), ("[1]",), ('{"a":1}',), (None,)], "t string")
    assert [r.x for r in df.select(fi.error_type(F.col("t")).alias("x")).collect()] == ["Other", "Partial", "[1]", '{"a":1}', ""]


@pytest.mark.parametrize("cwe, subs", [
    ("CWE-89", {"6.2.4", "6.4.1"}), ("CWE-798", {"8.2.1", "3.6.1", "6.2.4", "6.4.1"}), ("CWE-327", {"4.2.1", "3.5.1"}),
    ("CWE-284", {"7.2.1", "7.3.1"}), ("CWE-200", {"3.3.1", "10.3.1"})])
def test_weaknesses_map_by_substring(spark, cwe, subs):
    df = spark.createDataFrame([("", "", None, [cwe], [])],
                               "title string, description string, stride_primary string, cwes array<string>, rule_ids array<string>")
    assert {r.sub_id for r in pc.map_requirements(df).collect()} == subs
    if cwe == "CWE-798":
        assert {r.sub_id for r in pc.map_requirements(df, strict=True).collect()} == {"8.2.1", "3.6.1"}


def test_requirement_merge_keeps_the_highest_confidence_and_joins_reasons(spark):
    rows = [("6.2.4", 0.8, "a"), ("6.2.4", 0.9, "b"), ("8.2.1", 0.85, "c"), ("6.2.4", 0.1, "a")]
    df = spark.createDataFrame([(rows,)], "m array<struct<sub_id:string,confidence:double,reason:string>>")
    got = {r.sub_id: (r.m.confidence, r.m.reason) for r in df.select(F.inline(pc.merged(F.col("m")))).collect()}
    assert got == {"6.2.4": (0.9, "a | b"), "8.2.1": (0.85, "c")}


def test_compliance_status_ladder(spark):
    rows = [("critical", 1, "Fail"), ("medium", 1, "Partial"), ("low", 6, "Partial"), ("info", 5, "Pass"), ("info", 0, "Not Tested")]
    df = spark.createDataFrame(rows, "s string, n int, want string")
    from threatloom.functions.scores import severity_rank
    assert all(r.x == r.want for r in df.select("want", pc.status_of(severity_rank(F.col("s")), F.col("n")).alias("x")).collect())


def test_techniques_merge_to_the_best(spark):
    df = spark.createDataFrame(
        [("r", "S", ["E"], {"S": 1.0, "E": 1.0}, "4-Tooling", [], {"4-Tooling": 0.5})],
        "id string, stride_primary string, stride_secondary array<string>, stride_scores map<string,double>, "
        "maestro_primary string, maestro_secondary array<string>, maestro_scores map<string,double>")
    got = {r.technique_id: round(r.technique_confidence, 6) for r in te.best_techniques(df, ["id"]).collect()}
    assert got == {"T1078": 0.9, "T1110": 0.7, "T1566": 0.8, "T1068": 0.63, "T1555": 0.45, "T1021": 0.35}


def test_cve_records(spark):
    df = spark.createDataFrame(
        [(1, ("CVE-1", [("fr", "x"), ("en", "SQL injection in login")], "2024-01-15T10:00:00Z", [("u",)], [([("en", "CWE-89")],)]),
          ([(("CRITICAL", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R"),)],))],
        "ord bigint, cve struct<id:string,descriptions:array<struct<lang:string,value:string>>,published:string,"
        "references:array<struct<url:string>>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>>,"
        "metrics struct<cvssMetricV31:array<struct<cvssData:struct<baseSeverity:string,vectorString:string>>>>")
    row = cv.cve_threats(df, AS_OF).first()
    assert (row.severity, row.exposure_level, row.attack_complexity, row.privileges_required, row.user_interaction_required) == (
        "critical", "internet", "low", "none", True)
    assert row.title == "CVE-1: SQL injection in login" and row.cwe_ids == [89] and row.stride_primary == "T"
    assert len(row.recommended) == 6 and row.recommended[0].startswith("URGENT")


@pytest.mark.parametrize("rows, primary, confidence", [
    ([("microservices", 0.9), ("microservices", 0.8), ("microservices", 0.7)], "microservices", 1.0),
    ([("microservices", 0.6), ("api-service", 0.5), ("web-app", 0.4)], "microservices", 0.4),
    ([("api-service", 0.3)], "monolith", 0.0), ([], "unknown", 0.0)])
def test_architecture_votes(spark, rows, primary, confidence):
    signals = spark.createDataFrame(
        [("r", i, "file-pattern", "e", w, a) for i, (a, w) in enumerate(rows)],
        "repo_id string, ord int, type string, evidence string, weight double, arch_type string")
    repos = spark.createDataFrame([("r", "go", "gin")], "repo_id string, language string, framework string")
    row = at.profiles(signals, repos).first()
    assert row.primary == primary and abs(row.confidence - confidence) < 1e-6


def test_manifest_fallback_and_single_requires(spark):
    files = spark.createDataFrame([
        ("p", "requirements.txt", "# none"), ("p", "Pipfile", '[packages]\nflask = "*"\n[dev-packages]\nx = "1"'),
        ("g", "go.mod", "module m\nrequire example.com/one v1.0.0\nrequire (\n  example.com/two v2\n  // c d\n)\nreplace a => b")],
        "repo_id string, path string, content string")
    got = mf.dependencies(files, mf.languages(files)).collect()
    assert {(r.repo_id, r.name, r.version) for r in got} == {
        ("p", "flask", "*"), ("g", "example.com/one", "v1.0.0"), ("g", "example.com/two", "v2")}
