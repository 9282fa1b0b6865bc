"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("threatloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Shared folder for stage tables and stream state: the one named in ``spark.checkpoint.dir``.

    A temporary folder is used in local mode alone, where driver and executors share the machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            context.setCheckpointDir(named)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="threatloom-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        # This session's own folder below the one named: stage tables are of no use after it.
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame, rows: dict[str, int] | None = None, name: str = "", by: list[str] | None = None,
                 placed: bool = False) -> DataFrame:
    """Write a stage table to the shared folder as Parquet and go on from there: lineage is cut, a lost executor costs a
    re-read only, and later readers prune columns.  The folder goes when the session ends.

    Stage tables of repeated names are a small fraction on disk of what they are in memory.  The size of the files, by which
    Spark would choose to send a table through the driver to all executors, says nothing about that: joins with a stage table are
    therefore by sorted shares.

    ``rows[name]`` is set to the number of rows, counted while they are written.  ``by`` names columns by whose hash the rows are
    written in buckets: what is grouped, joined or repartitioned by these columns later is not moved again.  ``placed`` says that the rows come in these shares
    already, out of a join or grouping by these columns, so they are written where they are.
    """
    spark = df.sparkSession
    stage = uuid.uuid4().hex
    path = f"{work_folder(spark)}/stage-{stage}"
    seen = Observation()
    counted = df if rows is None else df.observe(seen, F.count(F.lit(1)).alias("n"))
    if by is None:
        counted.write.option("compression", "zstd").parquet(path)
        written = spark.read.schema(df.schema).parquet(path)
    else:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"stage_{stage}"
        dealt = counted if placed else counted.repartition(buckets, *by)
        dealt.write.format("parquet").option("compression", "zstd").bucketBy(buckets, *by).option("path", path).saveAsTable(table)
        written = spark.table(table)
        # The catalogue keeps no entry; the files of a table with a path of its own stay.
        spark.sql(f"DROP TABLE {table}")
    if rows is not None:
        rows[name] = seen.get.get("n", 0)
    return written.hint("merge")


def checkpointed_by(df: DataFrame, by: list[str]) -> DataFrame:
    """``checkpointed`` in buckets by the columns that later steps join by."""
    return checkpointed(df, by=by)
