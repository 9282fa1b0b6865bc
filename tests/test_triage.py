from helpers import AS_OF, threat, threats
from pyspark.sql import Observation
from threatloom.functions import scores
from threatloom.operators import triage as t


def merged(spark, *rows):
    return {r.dedup_key: r for r in t.merge_duplicates(t.normalize(threats(spark, *rows), AS_OF), AS_OF).collect()}


def test_priority_of_an_active_critical_threat(spark):
    df = threats(spark, threat(1, severity="critical", exploitation="active", exposure="internet", complexity="low", known=True))
    assert abs(df.select(scores.threat_priority(t.moment(AS_OF)).alias("p")).first().p - 0.98) < 1e-9


def test_recency_lowers_priority(spark):
    df = threats(spark, threat(1), threat(2, at="2024-01-10 00:00:00"), threat(3, at="2023-01-01 00:00:00"))
    p = [r.p for r in df.select("ord", scores.threat_priority(t.moment(AS_OF)).alias("p")).orderBy("ord").collect()]
    assert p[0] > p[1] > p[2] and abs(p[0] - p[2] - 0.1) < 1e-9


def test_merge_unions_lists_and_takes_the_higher_severity(spark):
    rows = merged(spark, threat(1, "x", "medium", ["i1"], ["Tag1"], ["f1"], ["CVE-1"]),
                  threat(2, "y", "high", ["i2", "i1"], ["tag2", "TAG1"], ["f2"], ["CVE-1"]))
    row = rows["cve:CVE-1"]
    assert (row.severity, row.tags, row.source_feeds, row.n_indicators, row.instance_count, row.title) == (
        "high", ["tag1", "tag2"], ["f1", "f2"], 2, 2, "x")


def test_dedupe_by_cve_then_indicator_then_title(spark):
    rows = merged(spark, threat(1, cves=["CVE-1"]), threat(2, cves=["CVE-1"]), threat(3, indicators=["1.2.3.4"]),
                  threat(4, indicators=["1.2.3.4"]), threat(5, "solo"))
    assert {k: r.instance_count for k, r in rows.items()} == {"cve:CVE-1": 2, "ioc:ip:1.2.3.4": 2, "title:solo": 1}


def test_code_threats_count_instances_in_the_description(spark):
    rows = merged(spark, *[threat(i, "Leak", description=f"found (at {i}) here (now)", indicators=[f"v{i % 2}"], tags=["Code-Analysis"])
                           for i in range(1, 6)])
    assert rows["code:Leak"].description == "found (at 1) here (5 instances across 2 files)"


def test_first_row_counts_its_own_instances_others_count_once(spark):
    rows = merged(spark, threat(1, count=4), threat(2, count=9))
    assert rows["title:t"].instance_count == 5


def test_indicators_repeated_in_their_first_row_all_count(spark):
    rows = merged(spark, threat(1, cves=["C"], indicators=["a", "a"]), threat(2, cves=["C"], indicators=["a", "b", "b"]))
    assert rows["cve:C"].n_indicators == 4


def test_titles_default_from_the_description(spark):
    df = threats(spark, threat(1, ""), threat(2, "", description="x" * 150), threat(3, "", description=""))
    assert [r.title for r in t.normalize(df, AS_OF).orderBy("ord").collect()] == ["d", "x" * 100, "Untitled Threat"]


def test_filter_drops_false_positives_low_priority_and_old_rows(spark):
    df = threats(spark, threat(1, "a"), threat(2, "b", false_positive=True), threat(3, "c", at="2023-06-01 00:00:00"))
    assert [r.title for r in t.triage(df, AS_OF, 0.1, 90).collect()] == ["a"]
    assert t.triage(df, AS_OF, 0.99, 900).count() == 0


def test_stage_counts(spark):
    df = threats(spark, threat(1), threat(2), threat(3, "b", false_positive=True))
    row = t.stage_counts(df, AS_OF).first()
    assert (row.normalized, row.deduplicated, row.filtered) == (3, 2, 1)


def test_observed_stages_equal_the_counted_ones(spark):
    df = threats(spark, threat(1, "a"), threat(2, "a"), threat(3, "b", at="2020-01-01 00:00:00"), threat(4, "c", repo="other", false_positive=True))
    counted = t.stage_counts(df, AS_OF).groupBy().sum().first().asDict()
    seen, empty = Observation(), Observation()
    t.triage(df, AS_OF, seen=seen).write.format("noop").mode("overwrite").save()
    assert t.stage_rows(seen) == {name: counted[f"sum({name})"] for name in t.STAGES}
    t.triage(df.where("false"), AS_OF, seen=empty).write.format("noop").mode("overwrite").save()
    assert set(t.stage_rows(empty).values()) == {0}
