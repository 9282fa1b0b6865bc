"""Scan results as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(rows: DataFrame, folder: str, entity: str, fmt: str = "parquet") -> None:
    """Write one entity of one or many scans; a scan written again replaces its own partition only."""
    (rows.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("scan_id", "repo_id").save(f"{folder}/{entity}"))


def load(spark: SparkSession, folder: str, entity: str, schema, fmt: str = "parquet") -> DataFrame:
    """Read one entity; a missing table or an unreadable record is an error.

    Filters on ``scan_id`` and ``repo_id`` prune partitions.
    """
    return spark.read.format(fmt).schema(schema).option("mode", "FAILFAST").load(f"{folder}/{entity}")


def save_text(rows: DataFrame, folder: str) -> None:
    """JSON text rows (``value``) per repository."""
    rows.select("repo_id", "value").write.mode("overwrite").partitionBy("repo_id").text(folder)
