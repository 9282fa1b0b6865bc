"""Age limit on a stream with two outputs: every row is written once, marked as in time or late.

The limit looks back from the newest row of all earlier batches, as a watermark does.  What a batch has to know of the earlier ones
is one number, which it takes from the mark its predecessor left; no state per row or key is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructType

from threatloom.streaming import log

_DAY = 86_400_000_000


def _mark(folder: str, epoch: int) -> str:
    return f"{folder}/marks/batch={epoch}"


def _micros(time_col: str) -> Column:
    return F.unix_micros(F.col(time_col).cast("timestamp"))


def splitter(folder: str, max_age_days: int, time_col: str = "discovered_at"):
    """foreachBatch function: writes a batch with ``late``, then the newest time so far as its mark.

    A batch without a mark is written anew when it is run again; one with a mark is left as it is.
    """
    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if log.complete(spark, _mark(folder, epoch)):
            return
        before = spark.read.parquet(_mark(folder, epoch - 1)).first()["newest"] if epoch else None
        late = F.lit(False) if before is None else F.coalesce(_micros(time_col) < F.lit(before - max_age_days * _DAY), F.lit(False))
        seen = Observation()
        marked = batch.withColumn("late", late).observe(seen, F.max(_micros(time_col)).alias("newest"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={epoch}")
        newest = max((t for t in (before, seen.get.get("newest")) if t is not None), default=None)
        spark.range(1, numPartitions=1).select(F.lit(newest).cast("bigint").alias("newest")).write.mode("overwrite").parquet(_mark(folder, epoch))

    return put


def start(stream: DataFrame, folder: str, checkpoint: str, max_age_days: int, time_col: str = "discovered_at",
          every: str | None = None) -> StreamingQuery:
    """Split a stream into ``folder``: on a fixed interval, or once over what is there.

    Rows older than ``max_age_days`` before the newest row of earlier batches are late.  Rows without a time are in time;
    repeated rows are kept.  A column named ``late`` or ``batch`` would clash and is an error.
    """
    clashing = {"late", "batch"} & {c.lower() for c in stream.columns}
    if clashing:
        raise ValueError(f"columns of these names are written by the split: {sorted(clashing)}")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(splitter(folder, max_age_days, time_col))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows of finished batches with ``batch`` and ``late``; a filter on ``late`` reads that output only."""
    whole = StructType([*schema.fields]).add("batch", LongType()).add("late", BooleanType())
    done = log.numbered(spark, f"{folder}/marks", "batch=")
    if not done:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{folder}/rows").where(F.col("batch") <= max(done))


def in_time(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return read(spark, folder, schema).where("NOT late")


def too_late(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return read(spark, folder, schema).where("late")
