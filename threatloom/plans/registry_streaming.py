"""Registered queries: streams run over what is there, intake log, technique sets."""

import uuid

from pyspark.sql import functions as F

from threatloom.operators import techniques as te
from threatloom.plans import AS_OF
from threatloom.session import work_folder
from threatloom.sources import feed as fd
from threatloom.sources import files as fs
from threatloom.sources import sample_views as v
from threatloom.streaming import intake as st
from threatloom.streaming import late
from threatloom.streaming import merge as mg


def event_stream(spark, d):
    """The events table as a file stream, shaped as findings."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # A glob finds the table as one file and as a folder of files.
    rows = st.read_stream(spark, f"{d}/[e]vents.parquet", schema)
    k = F.get_json_object("props", "$.k").cast("bigint")
    severity = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 40, "medium").otherwise("low")
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id"), F.col("event_id").alias("ord"),
        F.concat(F.lit("threat-"), F.col("event_id").cast("string")).alias("id"),
        F.concat("event_type", F.lit(" "), (k % 16).cast("string")).alias("title"), F.lit("").alias("description"),
        severity.alias("severity"), none.alias("tags"), none.alias("cve_ids"),
        F.array().cast("array<struct<type:string,value:string>>").alias("indicators"),
        F.lit(0).cast("bigint").alias("instance_count"), F.col("ts").cast("timestamp").alias("discovered_at"))


def run(spark, stream, mode="append"):
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    st.start(stream, f"{folder}/out", f"{folder}/state", mode=mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def event_threats(spark, d):
    """The same stream with tags and feeds to merge."""
    k = F.regexp_extract("title", "[0-9]+$", 0).cast("bigint")
    return event_stream(spark, d).withColumns({
        "tags": F.array(F.split_part("title", F.lit(" "), F.lit(1)), "severity"),
        "source_feeds": F.array(F.concat(F.lit("feed-"), (F.col("ord") % 3).cast("string")), F.concat(F.lit("list-"), (k % 2).cast("string")))})


def merged(spark, d):
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    mg.start(event_threats(spark, d), f"{folder}/merged", f"{folder}/state").awaitTermination()
    return mg.state(spark, f"{folder}/merged")


def merged_heads(spark, d):
    instances = F.greatest("first.instance_count", F.lit(1)) + F.col("n_rows") - 1
    return mg.heads(merged(spark, d)).select("repo_id", "dedup_key", "first.id", instances.alias("instances"))


def windows(spark, d):
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = st.severity_windows(event_stream(spark, d))
    keys = ["window_start", "severity"]
    st.start_updates(stream, f"{folder}/out", f"{folder}/state", keys).awaitTermination()
    return st.latest(spark, f"{folder}/out", keys)


def age_split(spark, d, days=10):
    """The events arrive in three shares, one batch each; every run goes on from the state that the last one left."""
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for share in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == share).write.mode("append").parquet(f"{folder}/in")
        stream = st.read_stream(spark, f"{folder}/in", events.schema)
        late.start(stream, f"{folder}/out", f"{folder}/state", days, "ts").awaitTermination()
    return late.read(spark, f"{folder}/out", events.schema)


def feed_records(spark, d, size=500):
    """The events as a vendor's feed would leave them, ``size`` to a page, read back through the feed source."""
    folder = f"{work_folder(spark)}/feed-{uuid.uuid4().hex}"
    item = F.struct("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("item"))
    number = F.floor(F.col("event_id") / size)
    pages = spark.read.parquet(f"{d}/events.parquet").groupBy(F.format_string("%010d", number).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda e: e["item"]).alias("items"))
    text = F.concat(F.lit('{"items": ['), F.array_join("items", ", "), F.lit("]}"))
    pages.select("page", text.alias("value")).write.partitionBy("page").text(folder)
    spark.dataSource.register(fd.PagedFeed)
    return fd.records(spark.read.format(fd.NAME).load(folder), "event_id bigint, user_id bigint, event_type string")


QUERIES = {
    "feed_records": lambda s, d: feed_records(s, d).select("event_id", "user_id", "event_type", F.col("place").cast("bigint").alias("place")),
    "stream_severity_windows": lambda s, d: windows(s, d).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "severity", "n"),
    "stream_first_sightings": lambda s, d: run(s, st.first_sightings(event_stream(s, d), "40 days")).select(
        "repo_id", "dedup_key"),
    "stream_merged": merged_heads,
    "stream_merged_lists": lambda s, d: mg.values(merged(s, d)).select(
        "repo_id", "dedup_key", "kind", "value", F.col("first.ord").alias("ord"), F.col("first.pos").cast("bigint").alias("pos")),
    "stream_age_split": lambda s, d: age_split(s, d).select("event_id", "batch", "late"),
    "intake_log": lambda s, d: fs.intake_log(v.findings(s, d), "severity", "error_type", "array<int>"),
    "intake_bad_records": lambda s, d: fs.bad_records(v.findings(s, d), "severity", "error_type", "array<int>"),
    "technique_sets": lambda s, d: te.with_technique_ids(v.threats(s, d)).select(
        "repo_id", F.explode("mitre_ids").alias("technique_id")).distinct(),
    "threats_still_fresh": lambda s, d: st.still_fresh(v.threats(s, d), AS_OF, 20).select("repo_id", "ord"),
}
