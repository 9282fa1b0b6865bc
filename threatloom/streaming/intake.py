"""Streaming intake of findings: scheduled reads, deduplication, age limit, severity windows, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.functions import scores
from threatloom.operators.triage import moment, with_key
from threatloom.streaming import log


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as they arrive; ``folder`` may be a glob, so several collectors are several folders."""
    return spark.readStream.format(fmt).schema(schema).load(folder)


def start(stream: DataFrame, target: str, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Write a stream to parquet: on a fixed interval ("6 hours"), or once over what is there."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_sightings(findings: DataFrame, delay: str) -> DataFrame:
    """Each dedupe key once per watermark span; the state of a key expires with the watermark."""
    return with_key(findings).withWatermark("discovered_at", delay).dropDuplicatesWithinWatermark(["repo_id", "dedup_key"])


def not_too_old(findings: DataFrame, max_age_days: int) -> DataFrame:
    """Age limit as the late-data rule: rows behind the newest of earlier batches by more than the limit are dropped.

    A watermark alone drops nothing; the stateful operator behind it does, and keeps one state entry per id of the span.
    """
    return findings.withWatermark("discovered_at", f"{max_age_days} days").dropDuplicatesWithinWatermark(["repo_id", "id"])


def severity_windows(findings: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Threats per time window and severity.

    In append mode a window comes out when the watermark has passed it; ``start_updates`` writes every window as it grows.
    """
    return (
        findings.withWatermark("discovered_at", delay).groupBy(F.window("discovered_at", width), "severity")
        .agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "severity", "n")
    )


def start_updates(stream: DataFrame, target: str, checkpoint: str, keys: list[str], every: str | None = None) -> StreamingQuery:
    """Write what a stateful stream changes, batch by batch; ``latest`` reads the newest state of each key.

    A batch that is run again after a failure replaces its own part.
    """
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(log.writer_to(target, keys))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Newest row of each key that ``start_updates`` wrote, open windows included."""
    return log.read(spark, target, keys)


def still_fresh(findings: DataFrame, as_of, max_age_days: int) -> DataFrame:
    return findings.where(scores.age_days(F.col("discovered_at"), moment(as_of)) <= max_age_days)
