"""Streams over tables of one file and of several, windows at the end of a run, merge over batches."""

import pytest
from helpers import threat, threats
from pyspark.sql import functions as F
from threatloom.plans import registry_streaming as rs
from threatloom.streaming import intake as st
from threatloom.streaming import late

SMALL = "/root/testdata/sf0.001"


def folder_of_files(spark, tmp_path):
    target = str(tmp_path / "many")
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{target}/events.parquet")
    return target


def test_one_file_and_several_give_the_same(spark, tmp_path):
    many = folder_of_files(spark, tmp_path)
    for name in ("stream_merged", "stream_merged_lists", "stream_first_sightings", "stream_severity_windows"):
        one, several = (sorted(map(str, rs.QUERIES[name](spark, d).collect())) for d in (SMALL, many))
        assert one == several and one


def test_windows_add_up_to_all_events(spark):
    rows = rs.QUERIES["stream_severity_windows"](spark, SMALL)
    assert rows.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_rows_past_the_age_limit_are_dropped(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), threats(spark).schema
    for number, at in enumerate(["2024-02-01 00:00:00", "2024-02-02 00:00:00", "2024-01-02 00:00:00"]):
        threats(spark, threat(number, at=at)).write.mode("append").parquet(folder)
        stream = st.not_too_old(st.read_stream(spark, folder, schema), 10)
        st.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()] == ["th-0", "th-1"]


def test_every_row_is_in_one_of_two_outputs(spark, tmp_path):
    folder, schema, out = str(tmp_path / "in"), threats(spark).schema, str(tmp_path / "out")
    assert late.read(spark, out, schema).count() == 0
    days = [["2024-02-01", "2023-01-01"], ["2024-02-20", "2024-01-22", "2024-01-21", "2024-01-21", None], ["2024-02-10", "2024-02-09", "2024-02-01"]]
    number = 0
    for batch in days:
        rows = [threat(number + i, at=day and f"{day} 00:00:00") for i, day in enumerate(batch)]
        number += len(rows)
        threats(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
        # Every run is a restart from the state on disk.
        late.start(st.read_stream(spark, folder, schema), out, str(tmp_path / "state"), 10).awaitTermination()
    assert sorted((r.batch, r.ord) for r in late.in_time(spark, out, schema).collect()) == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 6), (2, 7)]
    assert sorted((r.batch, r.ord) for r in late.too_late(spark, out, schema).collect()) == [(1, 4), (1, 5), (2, 8), (2, 9)]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch):
    out, put = str(tmp_path / "out"), late.splitter(str(tmp_path / "out"), 10)
    first, second = (threats(spark, *[threat(n, at=f"{day} 00:00:00")]) for n, day in enumerate(["2024-02-01", "2024-01-01"]))
    put(first, 0)
    with monkeypatch.context() as broken:
        broken.setattr(late.Observation, "get", property(lambda _: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            put(second, 1)
    assert late.read(spark, out, first.schema).count() == 1, "rows of an unfinished batch are not shown"
    for _ in range(2):
        put(second, 1)
        put(first, 0)
    assert [(r.ord, r.late) for r in late.read(spark, out, first.schema).orderBy("ord").collect()] == [(0, False), (1, True)]
    put(first.where("false"), 2)
    put(second, 3)
    assert late.too_late(spark, out, first.schema).count() == 2, "an empty batch passes the mark on"


def test_names_of_the_split_are_not_overwritten(spark, tmp_path):
    rows = st.read_stream(spark, str(tmp_path), "late boolean, discovered_at timestamp")
    with pytest.raises(ValueError):
        late.start(rows, str(tmp_path / "out"), str(tmp_path / "state"), 10)
