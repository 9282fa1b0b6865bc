"""The paged feed as a batch and a streaming source."""

import json

from threatloom.plans import registry_streaming as rs
from threatloom.sources import feed

DDL = "id string, severity string"
SMALL = "/root/testdata/sf0.001"


def page(folder, number, *items, text=None):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{number:06}.json").write_text(text if text is not None else json.dumps({"items": list(items)}))


def item(number, severity="low"):
    return {"id": f"th-{number}", "severity": severity}


def test_pages_are_read_in_partitions_and_bad_ones_logged(spark, tmp_path):
    spark.dataSource.register(feed.PagedFeed)
    folder = tmp_path / "feed"
    page(folder, 1, item(1), item(2, "high"))
    page(folder, 2, text='{"items": [')
    page(folder, 3, text='{"entries": []}')
    page(folder, 4, item(3), "no record", 7)
    page(folder, 5)
    (folder / "_SUCCESS").write_text("")
    pages = spark.read.format("threat_feed").option("pages_per_partition", 2).load(str(folder))
    assert pages.rdd.getNumPartitions() == 3
    assert {(r.page, r.place, r.id, r.severity) for r in feed.records(pages, DDL).collect()} == {
        ("page-000001.json", 0, "th-1", "low"), ("page-000001.json", 1, "th-2", "high"), ("page-000004.json", 0, "th-3", "low")}
    log = {r.page[5:11]: r for r in feed.page_log(pages, DDL).collect()}
    assert {k: (r.n_records, r.n_bad) for k, r in log.items()} == {"000001": (2, 0), "000002": (0, 0), "000003": (0, 0), "000004": (3, 2)}
    assert log["000002"].error.startswith("JSONDecodeError") and log["000003"].error.startswith("KeyError") and log["000001"].error is None


def test_stream_goes_on_behind_its_offset(spark, tmp_path):
    spark.dataSource.register(feed.PagedFeed)
    folder = tmp_path / "feed"
    counts = []
    for run in range(3):
        for number in range(2 * run, 2 * run + 2):
            page(folder, number, item(number), item(100 + number))
        stream = spark.readStream.format("threat_feed").load(str(folder))
        query = feed.records(stream, DDL).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        counts.append(sum(p["numInputRows"] for p in query.recentProgress))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert counts == [4, 4, 4]  # each run reads the new pages alone
    assert sorted(r.id for r in rows) == sorted(f"th-{n}" for i in range(6) for n in (i, 100 + i))


def test_feed_query_gives_every_event(spark):
    assert rs.QUERIES["feed_records"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").count()
