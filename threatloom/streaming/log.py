"""Log of the rows that a stream changes: a part per batch, folded level by level.

A batch writes only what it changed.  Every ``fold`` parts of a level become one part of the next, so a row is rewritten once per
level, and a reader opens at most ``fold`` parts per level, however long the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD = 8


def _part(folder: str, level: int, number: int) -> str:
    return f"{folder}/level={level}/part={number}"


def writer_to(folder: str, keys: list[str], fold: int = FOLD):
    """foreachBatch function: appends the changed rows of a batch and folds full levels.

    A batch that is run again writes the same parts again.  Parts that went into a fold stay until the next fold of
    their level, for readers that have chosen them and for a batch that is run again.
    """
    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(_part(folder, 0, epoch))
        level, number = 0, epoch
        while (number + 1) % fold == 0:
            parts = [_part(folder, level, i) for i in range(number + 1 - fold, number + 1)]
            level, number = level + 1, number // fold
            newest(spark.read.parquet(*parts), keys).write.mode("overwrite").parquet(_part(folder, level, number))
            for i in range((number - 1) * fold, number * fold):
                _remove(spark, _part(folder, level - 1, i))
    return put


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last written row of every key."""
    held = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*held), "batch").alias("last")).select(*keys, "last.*")


def read(spark: SparkSession, folder: str, keys: list[str], fold: int = FOLD) -> DataFrame:
    """The newest row of every key as of the last batch."""
    return newest(spark.read.parquet(*live_parts(spark, folder, fold)), keys).drop("batch")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def complete(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, f"{name}/_SUCCESS")
    return files.exists(path)


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished tables ``<prefix><number>`` in a folder."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    numbers = [int(s.getPath().getName().removeprefix(prefix)) for s in files.listStatus(path)]
    return [n for n in numbers if complete(spark, f"{folder}/{prefix}{n}")]


def live_parts(spark: SparkSession, folder: str, fold: int = FOLD) -> list[str]:
    """Parts that together hold the newest state: as few of the highest levels as cover all batches, in a number that is
    logarithmic in the batches."""
    numbers = numbered(spark, f"{folder}/level=0", "part=")
    if not numbers:
        return []
    end, out, at = max(numbers) + 1, [], 0
    while at < end:
        level = 0
        while at % fold ** (level + 1) == 0 and at + fold ** (level + 1) <= end:
            level += 1
        # A crash can come between a batch and its fold: then the parts below it still stand.
        while level and not complete(spark, _part(folder, level, at // fold**level)):
            level -= 1
        out.append(_part(folder, level, at // fold**level))
        at += fold**level
    return out
