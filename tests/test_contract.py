import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
LIGHT = ["threats_triaged", "assets_detected", "flow_summary", "finding_groups", "cve_threats", "sub_requirement_results",
         "architecture_profiles", "diff_threats", "stream_merged"]


def test_every_check_has_its_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", LIGHT)
def test_query_runs_on_the_small_tables(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0
