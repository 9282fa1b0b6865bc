"""Merged threats as keyed state of a stream, with a log of the entries that change.

The state holds one entry per merged threat and one per distinct tag, feed and indicator of it, so a hot key spreads over its
values.  A batch changes the entries it touches, and only these are written: the cost of a batch follows the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.functions import scores
from threatloom.operators import triage
from threatloom.streaming import log

ENTRY = [*triage.KEY, "kind", "value"]
ROW = "row"


def entries(threats: DataFrame, key_chars: int | None = triage.KEY_CHARS) -> DataFrame:
    """Mergeable entries of a table or stream of threats: per key its first row, row count and highest severity (kind ``row``), and
    per distinct list value where it appears first.  On a stream this aggregate is the keyed state."""
    keyed = triage.with_key(threats, key_chars)
    head = F.struct(*triage.carried(keyed))
    one = F.array(F.struct(F.lit(ROW).alias("kind"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("pos"), F.lit(1).alias("copies")))
    flat = keyed.select(
        *triage.KEY, "ord", head.alias("head"), scores.severity_rank(F.col("severity")).alias("rank"),
        F.explode(F.concat(one, triage.list_values())).alias("item"))
    is_row = F.col("item.kind") == ROW
    return flat.select(
        *triage.KEY, "item.kind", "item.value", "ord", F.struct("ord", "item.pos", "item.copies").alias("at"),
        F.when(is_row, F.col("head")).alias("head"), F.when(is_row, F.col("rank")).alias("rank"),
    ).groupBy(*ENTRY).agg(
        F.min("at").alias("first"), F.min_by("head", "ord").alias("head"), F.count("*").alias("n_rows"), F.max("rank").alias("top_rank"))


def start(threats: DataFrame, folder: str, checkpoint: str, every: str | None = None, fold: int = log.FOLD,
          key_chars: int | None = triage.KEY_CHARS) -> StreamingQuery:
    """Keep the merged threats of a stream in ``folder``: on a fixed interval, or once over what is there.

    State is never forgotten, as a merge over all time wants it; on a cluster set the RocksDB state store, which keeps it on disk.
    """
    writer = entries(threats, key_chars).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(log.writer_to(folder, ENTRY, fold))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def state(spark: SparkSession, folder: str, fold: int = log.FOLD) -> DataFrame:
    """All entries as of the last batch."""
    return log.read(spark, folder, ENTRY, fold)


def heads(rows: DataFrame) -> DataFrame:
    """First row, row count and highest severity of every key, from entries."""
    return rows.where(F.col("kind") == ROW).select(*triage.KEY, F.col("head").alias("first"), "n_rows", "top_rank")


def values(rows: DataFrame) -> DataFrame:
    """Distinct list values of every key with their first appearance, from entries."""
    return rows.where(F.col("kind") != ROW).select(*ENTRY, "first")


def merged(spark: SparkSession, folder: str, as_of, fold: int = log.FOLD) -> DataFrame:
    """Merged threats as ``triage.merge_duplicates`` gives them for all rows of the stream so far."""
    rows = state(spark, folder, fold)
    return triage.assembled(heads(rows), values(rows), as_of)


def merged_indicators(spark: SparkSession, folder: str, fold: int = log.FOLD) -> DataFrame:
    return triage.indicator_rows(values(state(spark, folder, fold)))
